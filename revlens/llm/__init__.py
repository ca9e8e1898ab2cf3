"""Operators for training-data pipelines over very large text corpora.

One module per operator; ``registry`` names the queries that apply them to
the given tables.  Nothing else in the library imports this package.  Its
functions are pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
