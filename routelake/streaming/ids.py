"""Stored event ids: a lookup that reads what a batch's ids may touch, however long the history is.

Ids of the latest batches lie in change folders (``folds``). A compaction moves them into folders by
a hash of the id; their number doubles so that a folder holds about ``IDS_PER_FOLDER`` ids at any
time. A lookup reads the recent changes and the folders of the batch's own ids.

Two tables are kept: ``started`` gets a batch's ids before its rows are stored, ``done`` after. A
batch that is started but not done failed in between, and only its ids need a look at the stored rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.lake import path_exists
from . import folds

IDS_PER_FOLDER = 1 << 20
LEAST_FOLDERS = 16
ID = "event_id string"
STARTED = "event_id string, event_date date"


def folder_of(folders: int) -> F.Column:
    return F.pmod(F.xxhash64("event_id"), F.lit(folders)).cast("int")


def number_of(spark: SparkSession, path: str, writer: str, batch_id: int = 0) -> int:
    """The number of a writer's batch in these tables (see ``folds.number_of``)."""
    return folds.number_of(spark, path, writer, batch_id, lambda: folds.next_number(spark, f"{path}/started", folds.newest(spark, f"{path}/done").upto))


def known(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Stored ids among which all stored ones of ``wanted`` are."""
    done = f"{path}/done"
    v = folds.newest(spark, done)
    ids = folds.changes(spark, done, ID, v.upto).select("event_id")
    if v.base:
        touched = [r[0] for r in wanted.select(folder_of(v.folders)).distinct().collect()]  # at most v.folders numbers
        # every folder exists: it holds a row without id
        paths = [f"{done}/{v.base}/folder={b}" for b in touched] if len(touched) < v.folders else [f"{done}/{v.base}"]
        if paths:
            base = spark.read.schema(ID).option("recursiveFileLookup", "true").parquet(*paths)
            ids = ids.unionByName(base.filter("event_id IS NOT NULL"))
    return ids


def unsure(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, event_date, batch) of the batches that were started and never got done."""
    upto = folds.newest(spark, f"{path}/done").upto
    done = folds.changes(spark, f"{path}/done", ID, upto).select("batch").distinct()
    return folds.changes(spark, f"{path}/started", STARTED, upto).join(done, "batch", "left_anti")


def is_done(spark: SparkSession, path: str, batch_id: int) -> bool:
    done = f"{path}/done"
    return batch_id <= folds.newest(spark, done).upto or path_exists(spark, folds.batch_folder(done, batch_id))


def compact(spark: SparkSession, path: str, upto: int, ids_per_folder: int = IDS_PER_FOLDER) -> None:
    """Moves the ids of the batches up to ``upto`` (all of them done) into the folders. Only where the number of
    folders changes are stored ids written again."""
    done = f"{path}/done"
    v = folds.newest(spark, done)
    if upto <= v.upto:
        return
    new = folds.changes(spark, done, ID, v.upto).filter(F.col("batch") <= upto).select("event_id")
    rows = v.rows + new.count()
    folders = max(LEAST_FOLDERS, 1 << math.ceil(math.log2(max(1, rows / ids_per_folder))))
    if v.base and folders == v.folders:
        base = v.base                                   # ids are a set: a reader that meets one twice takes no harm
    else:
        base, markers = None, spark.range(folders).select(F.lit(None).cast("string").alias("event_id"), F.col("id").cast("int").alias("folder"))
        if v.base:
            new = new.unionByName(spark.read.schema(ID).parquet(f"{done}/{v.base}").filter("event_id IS NOT NULL").select("event_id"))
    placed = new.withColumn("folder", folder_of(folders))
    if base is None:
        base, placed = f"base-{upto}-{folders}-{v.version + 1}", placed.unionByName(markers)
        mode = "overwrite"                              # of an attempt that was never published
    else:
        mode = "append"
    placed.repartition("folder").write.mode(mode).partitionBy("folder").parquet(f"{done}/{base}")
    folds.publish(spark, done, folds.Version(v.version + 1, base, upto, folders, rows))
