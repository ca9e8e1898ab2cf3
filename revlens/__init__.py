"""revlens: customer-review analytics on Spark DataFrames.

Layout
------
- ``functions``  Column-level building blocks (text cleaning, exact rounding,
  the keyword classifier, reply rules, date parsing).
- ``operators``  DataFrame -> DataFrame building blocks (keep-first dedup,
  schema conforming, share-of-partition, reshaping, top-N per group).
- ``sources``    readers / writers and the durable table store.
- ``plans``      the product surface: cleaning (bronze -> silver -> gold),
  quality checks, landing jobs and the report family.
- ``streaming``  incremental landing of raw review files.
"""

from revlens.params import FIXTURE, REFERENCE, Params

__all__ = ["Params", "REFERENCE", "FIXTURE"]
