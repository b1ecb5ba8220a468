"""Written tables in the shared checkpoint folder: audit (date-partitioned) and snapshots.

Upserts never overwrite a folder that is being read: every snapshot goes to a fresh
folder and the caller switches to it (copy-on-write)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import scratch_path


def write_audit(spark: SparkSession, audit: DataFrame, path: str | None = None, mode: str = "overwrite") -> str:
    """Audit layout for the query patterns: one folder per event_date (pruned by every
    time filter), rows clustered by route then time so row-group min/max skip the rest."""
    path = path or scratch_path(spark, "audit")
    order = [F.col("event_date"), *[F.col(f"route.{c}") for c in ("tenant", "service", "env", "version")],
             F.col("occurred_at")]
    # range partitioning on (date, route, time): a busy day is split over several tasks
    # instead of landing in one, and each file still covers a narrow route/time range
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (audit.repartitionByRange(n, *order).sortWithinPartitions(*order)
     .write.mode(mode).partitionBy("event_date").parquet(path))
    return path


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUDIT).parquet(path)


def retain_audit(spark: SparkSession, path: str, as_of, days: int = 365, to: str | None = None) -> str:
    """The next snapshot of a stored audit without expired rows; folders that have expired as a
    whole are pruned by their date and never read."""
    from ..operators.dml import audit_retention
    return write_audit(spark, audit_retention(read_audit(spark, path), as_of, days), to)


def write_snapshot(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return path


def read_snapshot(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def cut_lineage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Materialise to the shared folder and continue from the written copy (survives
    executor loss, unlike a local checkpoint)."""
    return read_snapshot(spark, write_snapshot(spark, df, name))


def add_event_date(df: DataFrame, ts: str = "occurred_at") -> DataFrame:
    return df.withColumn("event_date", F.to_date(ts))


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a readable parquet table."""
    from pyspark.errors import AnalysisException
    try:
        spark.read.parquet(path).schema  # noqa: B018  (resolves the files, reads no data)
        return True
    except AnalysisException:
        return False
