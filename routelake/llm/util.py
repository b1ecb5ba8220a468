"""Shared helpers: slices of Arrow batches, written tables, empty-safe column selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Rows of an Arrow batch turned into Python objects at a time (bounds a task's memory).
SLICE_ROWS = 512


def slices(batches, rows: int = SLICE_ROWS):
    """The batches of a ``mapInArrow`` function in slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def python_ready(spark: SparkSession) -> None:
    """Ship the package to the Python workers of a cluster."""
    ship_package(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a lineage cut that survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalised(text):
    """Every run of ``[\\x20\\x09-\\x0D]`` as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
