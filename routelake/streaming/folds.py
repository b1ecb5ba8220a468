"""Tables that grow by one folder of change rows per micro-batch and are read by folding them.

A micro-batch appends only its own rows, under its batch id, so it costs what it holds and a
replay overwrites itself. Readers take the newest folded version and the changes after it. A
compaction folds them into a new version and publishes it with one row of the ``versions`` table:
a reader sees the version before or after, never a mixture, since no folded version is changed
once it is published.

Layout: ``changes/gen=<batch div BATCHES>/batch=<number>``, ``base-<unique>``, ``versions``, ``writers``.
Batch numbers are the table's own and consecutive from 0, so a reader lists the generations after the
folded batches only, however long the stream has run. A stream counts its batches from 0 for every
checkpoint; ``number_of`` gives the table's number for them, so a query that begins again with a new
checkpoint, or after a batch job, writes new batches instead of replaying those of another writer.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.lake import path_exists

#: Batches in a generation, and between two compactions unless a query says otherwise.
BATCHES = 64
VERSIONS = "version long, base string, upto long, folders int, rows long"
#: From table number ``number`` on, the batches are those of ``writer`` from its batch ``first`` on, up to the next span.
WRITERS = "span long, number long, writer string, first long"


class Version(NamedTuple):
    """The newest folded state: its folder, the last batch in it, folders and rows of it (where counted)."""
    version: int = 0
    base: str | None = None
    upto: int = -1
    folders: int = 0
    rows: int = 0


def newest(spark: SparkSession, path: str) -> Version:
    if not path_exists(spark, f"{path}/versions"):
        return Version()
    row = spark.read.schema(VERSIONS).parquet(f"{path}/versions").agg(F.max(F.struct("version", "base", "upto", "folders", "rows")).alias("v")).first()
    return Version(*row["v"]) if row["v"] else Version()


def publish(spark: SparkSession, path: str, v: Version) -> None:
    spark.createDataFrame([tuple(v)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/changes/gen={batch_id // BATCHES}/batch={batch_id}"


def next_number(spark: SparkSession, path: str, upto: int) -> int:
    """The number after all batches in ``path`` and after ``upto``."""
    seen, at = upto, max(0, upto + 1) // BATCHES * BATCHES
    while path_exists(spark, f"{path}/changes/gen={at // BATCHES}"):
        seen = max([seen, *[b for b in range(at, at + BATCHES) if path_exists(spark, batch_folder(path, b))]])
        at += BATCHES
    return seen + 1


def number_of(spark: SparkSession, path: str, writer: str, batch_id: int, free: Callable[[], int] | None = None, alone: bool = False) -> int:
    """The table's number of the batch ``batch_id`` of ``writer``: the one it had before if this is a replay, else the
    next one. ``free`` gives the next number (default: after all batches of ``path``). ``alone``: the table takes the batches of
    one writer only, another one is refused. One writer at a time."""
    spans = sorted(map(tuple, spark.read.schema(WRITERS).parquet(f"{path}/writers").collect())) if path_exists(spark, f"{path}/writers") else []
    for (_, start, who, first), end in zip(spans, [s[1] for s in spans[1:]] + [math.inf] * bool(spans), strict=True):
        if who == writer and start <= start + batch_id - first < end:
            return start + batch_id - first
    if alone and any(who != writer for _, _, who, _ in spans):
        raise ValueError(f"{path} holds the counts of another checkpoint, whose rows would count twice: give the query a folder of its own")
    start = free() if free else next_number(spark, path, newest(spark, path).upto)
    spark.createDataFrame([(len(spans), start, writer, batch_id)], WRITERS).coalesce(1).write.mode("append").parquet(f"{path}/writers")
    return start


class Checkpoint:
    """The writer that a stream's checkpoint stands for: its id lasts as long as the checkpoint."""

    def __init__(self, path: str):
        self.path, self._id = path, None

    def writer(self, spark: SparkSession) -> str:
        if self._id is None:
            self._id = spark.read.schema("id string").json(f"{self.path}/metadata").first()["id"]
        return self._id

    def number_of(self, spark: SparkSession, path: str, batch_id: int, **kw) -> int:
        return number_of(spark, path, self.writer(spark), batch_id, **kw)


def append(df: DataFrame, path: str, batch_id: int) -> None:
    """The batch's rows. A replay overwrites them; one of a batch that is folded already has nothing to add."""
    if batch_id > newest(df.sparkSession, path).upto:
        df.write.mode("overwrite").parquet(batch_folder(path, batch_id))


def changes(spark: SparkSession, path: str, schema, after: int = -1) -> DataFrame:
    """Change rows of the batches after ``after``, with their ``batch``."""
    folders, gen = [], (after + 1) // BATCHES
    while path_exists(spark, f"{path}/changes/gen={gen}"):
        folders.append(f"{path}/changes/gen={gen}")
        gen += 1
    fields = spark.createDataFrame([], schema).schema
    if not folders:
        return spark.createDataFrame([], fields).withColumn("batch", F.lit(0).cast("long"))
    typed = T.StructType([*fields.fields, T.StructField("gen", T.IntegerType()), T.StructField("batch", T.LongType())])
    return (spark.read.schema(typed).option("basePath", f"{path}/changes").parquet(*folders)
            .filter(F.col("batch") > after).drop("gen"))


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Folded rows and the changes after them, with their ``batch`` (folded rows: the last one folded)."""
    v = newest(spark, path)
    rows = changes(spark, path, schema, v.upto)
    if v.base is None:
        return rows
    base = spark.read.schema(spark.createDataFrame([], schema).schema).parquet(f"{path}/{v.base}")
    return base.withColumn("batch", F.lit(v.upto).cast("long")).unionByName(rows)


def write_base(df: DataFrame, path: str) -> str:
    base = f"base-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{base}")
    return base


def start(df: DataFrame, path: str) -> None:
    """A first folded version, before any batch."""
    publish(df.sparkSession, path, Version(1, write_base(df, path)))


def compact(spark: SparkSession, path: str, schema, fold: Callable[[DataFrame], DataFrame], upto: int) -> None:
    """Folds everything up to batch ``upto`` into a new version. ``fold``: rows with ``batch`` -> rows of ``schema``."""
    v = newest(spark, path)
    if upto > v.upto:
        base = write_base(fold(read(spark, path, schema).filter(F.col("batch") <= upto)), path)
        publish(spark, path, Version(v.version + 1, base, upto))


def due(batch_id: int, every: int | None) -> bool:
    return bool(every) and (batch_id + 1) % every == 0


def last_per_key(rows: DataFrame, keys, order=("batch",)) -> DataFrame:
    """Of every key the row that is last by ``order``: a partial aggregate, whatever the number of rows of a key."""
    keys = list(keys)
    values = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("l"))
    return last.select(*keys, *[F.col(f"l.{c}").alias(c) for c in values])
