"""Durable derived tables in the shared checkpoint folder.

The gold table and the classified-negatives table are derived once per input
snapshot and written as Parquet under ``spark.checkpoint.dir`` (the shared
folder the cluster names).  Reports then read only the columns they need
and prune ``year`` partitions, and a lost executor costs a task retry rather
than a recompute of the whole lineage.

Writes go to a unique temporary sibling and are renamed into place, so a
half-written table is never read and two concurrent builders do not clash.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder.  Read from the session; only a local
    session (tests) without one gets a fresh local folder, set for the session."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="revlens-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _status(spark: SparkSession, path: str) -> list:
    """(path below ``path``, length, mtime) of a file or of every file in a
    directory, at any depth, so a same-size overwrite in a partition folder
    also changes the key."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return [path, None]
    root = fs.getFileStatus(p).getPath().toString()
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        s = files.next()
        found.append((s.getPath().toString()[len(root):], s.getLen(), s.getModificationTime()))
    return sorted(found)


def fingerprint(spark: SparkSession, inputs: list[str], *extra) -> str:
    """Content-ish key of the inputs: file names, sizes and modification
    times, plus any parameters that change the derived table."""
    h = hashlib.sha256()
    for path in inputs:
        h.update(path.encode())
        h.update(json.dumps(_status(spark, path), default=str).encode())
    h.update(json.dumps(extra, default=str, sort_keys=True).encode())
    return h.hexdigest()[:20]


def mark_done(spark: SparkSession, path: str) -> None:
    """Write the ``_SUCCESS`` marker for outputs not written by one job."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    fs.create(p, True).close()


def materialize_with(spark: SparkSession, writer, name: str, key: str, inputs: tuple[str, ...] | list[str] = ()) -> str:
    """Run ``writer(path)`` once for ``<checkpoint>/revlens/<name>/<key>`` and
    return the path; later calls with the same key reuse the output.  Shuffles
    of the writing have as many partitions as the size of ``inputs`` asks for."""
    root = f"{checkpoint_root(spark)}/revlens/{name}"
    final = f"{root}/{key}"
    if path_exists(spark, f"{final}/_SUCCESS"):
        return final
    tmp = f"{root}/_tmp-{key}-{uuid.uuid4().hex[:8]}"
    try:
        with _conf(spark, write_conf(spark, inputs)):
            writer(tmp)
    except BaseException:
        fs, src = _fs(spark, tmp)
        fs.delete(src, True)   # ours alone; another builder's may be in use
        raise
    if not path_exists(spark, f"{tmp}/_SUCCESS"):
        mark_done(spark, tmp)   # writers of several sub-folders (report suites)
    fs, src = _fs(spark, tmp)
    _, dst = _fs(spark, final)
    if fs.exists(dst) and not path_exists(spark, f"{final}/_SUCCESS"):
        fs.delete(dst, True)   # an unmarked leftover (older layout): replace it
    # (a directory rename onto an existing directory would nest it, so check)
    if fs.exists(dst) or not fs.rename(src, dst):
        # another builder won the race; theirs is complete, drop ours
        fs.delete(src, True)
    return final


def run_token(spark: SparkSession) -> str:
    """Part of the key of files that are written to be read back: a bench run
    sets a new one, so that the writing is timed each time."""
    return spark.conf.get("revlens.run", "")


# A task of a durable write sorts what it gets, with its text, several times
# over (joins, clustering): its memory is some ten times that.  So it gets
# TASK_BYTES of a shuffle at most, however large the input: there are enough
# partitions to start with, and small ones are joined up to that.
TASK_BYTES = 32 * 1024 * 1024
#: Bytes of (compressed) input for each partition to start with.
INPUT_BYTES = 8 * 1024 * 1024


def write_conf(spark: SparkSession, inputs: tuple[str, ...] | list[str]) -> dict[str, str]:
    """Settings for a durable write made from the files or folders ``inputs``."""
    size = sum(s[1] for path in inputs for s in _status(spark, path) if isinstance(s, tuple))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // INPUT_BYTES))
    return {"spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts)}


class _conf:
    """Temporarily set runtime SQL confs."""

    def __init__(self, spark: SparkSession, conf: dict):
        self.spark, self.conf, self.old = spark, conf, {}

    def __enter__(self):
        for k, v in self.conf.items():
            self.old[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, v)

    def __exit__(self, *exc):
        for k, v in self.old.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def materialize(spark: SparkSession, df_builder, name: str, key: str,
                partition_by: tuple[str, ...] = (), sort_within: tuple[str, ...] = (),
                inputs: tuple[str, ...] | list[str] = ()) -> str:
    """Write ``df_builder()`` once as Parquet (zstd) and return the path."""
    def write(path: str) -> None:
        df: DataFrame = df_builder()
        if sort_within:
            # rows of one partition value land in few, well-clustered files
            # with tight row-group statistics; no shuffle, so a hot
            # partition value is not sent to one task
            df = df.sortWithinPartitions(*sort_within)
        w = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
    return materialize_with(spark, write, name, key, inputs)


def bucketed(spark: SparkSession, df: DataFrame, name: str, key: str, column: str) -> DataFrame:
    """``df``, written once in buckets of ``column`` (as many as a shuffle has
    partitions), as a table that Spark knows to be laid out so: joins and
    groupings on the column need no exchange."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def declare(table: str, path: str) -> None:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
                  f"CLUSTERED BY (`{column}`) SORTED BY (`{column}`) INTO {n} BUCKETS LOCATION '{path}'")

    def write(path: str) -> None:
        table = f"revlens_{uuid.uuid4().hex}"
        declare(table, path)
        try:
            # a task writes one bucket's file
            df.repartition(n, column).write.mode("append").format("parquet").bucketBy(n, column).sortBy(column).saveAsTable(table)
        finally:
            spark.sql(f"DROP TABLE {table}")  # the files stay

    path = materialize_with(spark, write, name, f"{key}-{n}")
    table = f"revlens_{name}_{key}_{n}"
    declare(table, path)
    return spark.table(table)
