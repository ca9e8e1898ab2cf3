"""Drop folder of raw CSV files -> bronze Parquet, incrementally.

``trigger(availableNow=True)`` processes every file not yet seen and stops,
so the same job serves a scheduled batch run and a continuous one.  Each
micro-batch is written with ``foreachBatch`` to ``<bronze>/batch=<id>`` in
overwrite mode: a batch retried after a failure replaces its own output, so
the table holds every file exactly once.  That needs the checkpoint and the
bronze folder to live and die together: keep the checkpoint inside the bronze
folder (``<bronze>/_checkpoint``, which readers of the table skip), never a new
output folder beside an old checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.sources.files import _CSV_READ


def _tagger(tags: dict[str, tuple[str, str]] | None):
    """File name -> (app, data_source) as a literal map column (the
    manifest is a handful of files)."""
    if not tags:
        return None
    keys = [F.lit(k) for k in tags]
    apps = F.map_from_arrays(F.array(*keys), F.array(*[F.lit(a) for a, _ in tags.values()]))
    srcs = F.map_from_arrays(F.array(*keys), F.array(*[F.lit(s) for _, s in tags.values()]))
    return apps, srcs


def land_files(spark: SparkSession, source_dir: str, bronze_dir: str, checkpoint_dir: str,
               schema: T.StructType, tags: dict[str, tuple[str, str]] | None = None,
               max_files_per_trigger: int | None = 1000) -> None:
    """Land every new CSV file under ``source_dir`` and return when done.
    ``availableNow`` drains the backlog in batches of at most
    ``max_files_per_trigger`` files, so a failed batch redoes little."""
    r = spark.readStream.schema(schema)
    for k, v in _CSV_READ.items():
        r = r.option(k, v)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = r.csv(source_dir).withColumn("_source_file", F.col("_metadata.file_name"))
    tag = _tagger(tags)
    if tag:
        apps, srcs = tag
        stream = stream.withColumns({"app": apps[F.col("_source_file")],
                                     "data_source": srcs[F.col("_source_file")]})

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # position within a file: multiLine CSV files are read whole by one
        # task, so the id rises within a file
        (batch.withColumn("_pos", F.monotonically_increasing_id())
              .write.mode("overwrite").parquet(f"{bronze_dir}/batch={batch_id}"))

    q = (stream.writeStream.foreachBatch(write_batch)
               .option("checkpointLocation", checkpoint_dir)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def read_bronze(spark: SparkSession, bronze_dir: str, schema: T.StructType) -> DataFrame:
    """The landed rows (``batch`` is the micro-batch that landed them)."""
    full = T.StructType(list(schema.fields) + [T.StructField("_source_file", T.StringType()),
                                               T.StructField("_pos", T.LongType()),
                                               T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(bronze_dir)
