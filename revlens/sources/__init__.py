"""Readers, writers and the durable table store.  The functions of this
package are pickled by value, so executors need no copy of it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
