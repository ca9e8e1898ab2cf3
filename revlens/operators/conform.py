"""Projection / schema operators (all narrow: no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tag(df: DataFrame, **consts) -> DataFrame:
    """B1: add constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in consts.items()})


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """B2: rename by map; names not present are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def drop(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns, ignoring absent ones."""
    return df.drop(*cols)


def add_nulls(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add every schema column missing from ``df`` as a typed NULL."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, in order, cast to its types;
    missing ones NULL, extra ones dropped."""
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields]
    return df.select(*cols)
