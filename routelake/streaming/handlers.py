"""Micro-batch handlers for the change stream (used by ``foreachBatch`` and by batch jobs).

Every handler is idempotent, so a replayed micro-batch (after a failure, before the
checkpoint commit) leaves the sink unchanged: audit appends look up ``event_id``; changes of the
cache, of key states and of counters are written under the batch id and overwritten on replay
(``folds``).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expr as X
from ..operators import audit as A
from ..operators import catalog as C
from ..sources import lake
from . import folds, ids

REQUIRED = ["action", *X.ROUTE_COLS]
#: Tasks that ``spread`` makes of one.
PIECES = 8


def spread(batch: DataFrame) -> DataFrame:
    """A batch of envelope rows in smaller tasks, for aggregates that sort the rows of a task: a split of the source
    may hold millions. By record, not by id or route, so a frequent one is spread as well."""
    return batch.repartition(PIECES * max(1, batch.rdd.getNumPartitions()), "partition", "offset", "timestamp")


def parse_envelope(df: DataFrame) -> DataFrame:
    """Envelope (key, value, partition, offset, timestamp) -> event columns + ``reject_reason``.
    One bad record never stops the stream: it is kept with a reason instead."""
    e = F.from_json("value", schemas.ROUTE_EVENT, {"mode": "PERMISSIVE"})
    d = df.withColumn("e", e)
    fields = [f.name for f in schemas.ROUTE_EVENT.fields]
    all_null = reduce(lambda a, b: a & b, [F.col(f"e.{f}").isNull() for f in fields])
    d = d.select("key", "value", "partition", "offset", "timestamp", *[F.col(f"e.{f}").alias(f) for f in fields],
                 F.col("e").isNull().alias("_null"), all_null.alias("_empty"))
    reason = (F.when(F.col("_null") | F.col("_empty"), F.lit("malformed"))
              .when(~X.all_present(*REQUIRED), F.lit("missing_field"))
              .when(~X.all_present("event_id"), F.lit("missing_event_id")))
    return d.withColumn("reject_reason", reason).drop("_null", "_empty")


def split_valid(parsed: DataFrame):
    return (parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            parsed.filter(F.col("reject_reason").isNotNull()))


def first_per_event_id(events: DataFrame) -> DataFrame:
    """Duplicates inside a batch: the copy with the lowest (partition, offset) wins (Q10).
    A partial min over a struct, so a repeated id never concentrates in one task."""
    cols = [c for c in events.columns if c != "event_id"]
    # min_by: the payload may hold a map (not orderable), the ordering key is (partition, offset)
    g = events.groupBy("event_id").agg(F.min_by(F.struct(*cols), F.struct("partition", "offset")).alias("m"))
    return g.select("event_id", "m.*")


def to_audit_rows(events: DataFrame) -> DataFrame:
    """Parsed events -> audit rows (Q4/Q5: ISO parse to UTC; junk or missing -> ingest time,
    flagged in ``occurred_at_defaulted``)."""
    d = (events.withColumn("occurred_at_defaulted", X.parse_iso_timestamp(F.col("occurred_at")).isNull())
         .withColumn("occurred_at", X.parse_iso_timestamp(F.col("occurred_at"), F.col("timestamp"))))
    return A.shape_audit_doc(d, processed_at=F.col("timestamp"))


def ids_of(audit_path: str) -> str:
    """Where the ids of a stored audit are kept."""
    return f"{audit_path.rstrip('/')}-ids"


def append_audit(spark: SparkSession, audit_rows: DataFrame, path: str, batch_id: int | None = None,
                 compact_every: int | None = folds.BATCHES) -> DataFrame:
    """Append rows whose event_id is not stored yet, whatever their date; of copies inside the
    batch the first processed one counts. Late events are kept (no watermark, Q22). Returns the new rows.

    Stored ids are kept beside the audit, in ``<path>-ids`` (``ids``): a batch reads the folders that
    its own ids fall into, so its cost does not follow the history. Its ids are written before its
    rows and confirmed after them. Only after a failure in between are the stored rows looked at: those
    of the dates of the ids in question (a replay has the same dates). ``batch_id``: the table's number of a batch
    (``ids.number_of`` gives it for that of a stream); without it the rows are a batch of a writer of its own. One writer at a time. Rows without id must be rejected before (``parse_envelope`` does)."""
    stored_ids = ids_of(path)
    if batch_id is None:
        batch_id = ids.number_of(spark, stored_ids, uuid.uuid4().hex)
    elif ids.is_done(spark, stored_ids, batch_id):
        return audit_rows.limit(0)
    cols = [c for c in audit_rows.columns if c != "event_id"]
    rows = (audit_rows.filter(X.all_present("event_id")).groupBy("event_id")
            .agg(F.min_by(F.struct(*cols), F.struct("processed_at", "occurred_at", "action")).alias("m")).select("event_id", "m.*"))
    rows = lake.cut_lineage(spark, rows.select(*audit_rows.columns), "audit-batch")
    started, done = f"{stored_ids}/started", f"{stored_ids}/done"
    failed = ids.unsure(spark, stored_ids)
    again = None                                        # what an earlier attempt at this batch has stored
    if not failed.isEmpty():
        stored = failed.select("batch", "event_id")
        if lake.path_exists(spark, path):
            near = lake.read_audit(spark, path).join(failed.select("event_date").distinct(), "event_date", "left_semi")
            stored = stored.join(near.select("event_id"), "event_id", "left_semi")
        else:
            stored = stored.limit(0)
        stored = lake.cut_lineage(spark, stored, "audit-stored")
        for b in [r[0] for r in failed.select("batch").distinct().collect()]:    # batch numbers
            if b != batch_id:
                folds.append(stored.filter(F.col("batch") == b).select("event_id"), done, b)
        again = stored.filter(F.col("batch") == batch_id)
    new = rows.join(ids.known(spark, stored_ids, rows), "event_id", "left_anti")
    folds.append(new.select("event_id", "event_date"), started, batch_id)
    missing = new if again is None else new.join(again, "event_id", "left_anti")
    missing = missing.select(*audit_rows.columns)
    missing.write.mode("append").partitionBy("event_date").parquet(path)
    folds.append(spark.read.schema(ids.STARTED).parquet(folds.batch_folder(started, batch_id)).select("event_id"), done, batch_id)
    if folds.due(batch_id, compact_every):
        ids.compact(spark, stored_ids, batch_id)
    return missing


# ------------------------------------------------------------------ cache
def start_cache(cache: DataFrame, path: str) -> None:
    """The first snapshot of a cache that a stream keeps up to date."""
    folds.start(cache.select(*schemas.CACHE.fieldNames()).withColumn("deleted", F.lit(False)), path)


def _live(rows: DataFrame) -> DataFrame:
    return folds.last_per_key(rows, ["route_key"]).filter(~F.col("deleted"))


def read_cache(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The cache's entries, or those of ``keys`` (route_key): the newest change of a key counts."""
    rows = folds.read(spark, path, schemas.CACHE_CHANGE)
    if keys is not None:
        rows = rows.join(keys, "route_key", "left_semi")
    return _live(rows).select(*schemas.CACHE.fieldNames())


def compact_cache(spark: SparkSession, path: str, upto: int) -> None:
    """Folds the changes up to a batch into a snapshot, clustered by key; removed entries go."""
    folds.compact(spark, path, schemas.CACHE_CHANGE, lambda rows: _live(rows).drop("batch").select(*schemas.CACHE_CHANGE.fieldNames())
                  .repartitionByRange("route_key").sortWithinPartitions("route_key"), upto)


def changed_keys(valid: DataFrame) -> DataFrame:
    return valid.select(*X.ROUTE_COLS, "timestamp").filter(X.all_present(*X.ROUTE_COLS))


def invalidate(cache: DataFrame, valid: DataFrame) -> DataFrame:
    return C.invalidate_cache(cache, changed_keys(valid))


def removed(valid: DataFrame) -> DataFrame:
    """Change rows that take every changed key out of the cache."""
    keys = changed_keys(valid).select(X.route_cache_key().alias("route_key")).distinct()
    return keys.select("route_key", *[F.lit(None).cast(schemas.CACHE[c].dataType).alias(c) for c in schemas.CACHE.fieldNames()[1:]],
                       F.lit(True).alias("deleted"))


def refilled(valid: DataFrame, routes: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Every changed key resolved again against the catalog; the entry's clock is the key's
    newest event time in the batch (repeatable), TTL 60 s / 10 s (Q20). ``live``: entries that stay
    as they are while they are valid, as on the reference's read path."""
    k = changed_keys(valid).groupBy(*X.ROUTE_COLS).agg(F.max("timestamp").alias("as_of"))
    if live is not None:
        k = (k.withColumn("route_key", X.route_cache_key()).join(live.select("route_key", "expires_at"), "route_key", "left")
             .filter(F.col("expires_at").isNull() | (F.col("expires_at") <= F.col("as_of")))
             .drop("route_key", "expires_at"))
    j = k.join(C.active_routes(routes), list(X.ROUTE_COLS), "left")
    found = F.col("url").isNotNull()
    return j.select(X.route_cache_key().alias("route_key"), "url", (~found).alias("is_negative"),
                    F.when(found, X.ts_plus_seconds(F.col("as_of"), X.POSITIVE_TTL_SECONDS))
                    .otherwise(X.ts_plus_seconds(F.col("as_of"), X.NEGATIVE_TTL_SECONDS)).alias("expires_at"))


def warm(cache: DataFrame, valid: DataFrame, routes: DataFrame, only_missing: bool = False) -> DataFrame:
    """The whole cache with every changed key refilled (see ``refilled``)."""
    rows = refilled(valid, routes, cache if only_missing else None)
    return cache.join(rows.select("route_key"), "route_key", "left_anti").unionByName(rows)
