"""Structured Streaming queries over the route-change stream.

Source: Kafka topic ``route-events`` (``format="kafka"``) when the connector is on the
classpath, else files with the same five envelope columns. Each consumer type of the
reference is its own query with its own checkpoint folder (independent offsets, like
separate consumer groups). ``availableNow`` runs a query over everything new and stops;
``processingTime='1 second'`` is the live setting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import expr as X
from ..operators import metrics as M
from ..operators.dml import dense_index
from ..sources.lake import cut_lineage
from . import folds, ids
from . import handlers as H

TOPIC = "route-events"
#: Next offset of every partition of a topic folder.
HEADS = "partition int, next long"
CONSUMER_TYPES = ("cache_invalidation", "cache_warming", "audit_log")
POLL = "1 second"


def _kafka(reader, servers: str):
    return reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", TOPIC).option("startingOffsets", "earliest")


def _envelope(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset", "timestamp")


def peek(spark: SparkSession, n: int = 5, path: str | None = None, kafka_servers: str | None = None) -> DataFrame:
    """The first ``n`` records from the beginning of the topic, by (partition, offset), as a batch."""
    rows = _envelope(_kafka(spark.read, kafka_servers).load()) if kafka_servers else spark.read.schema(schemas.ENVELOPE).parquet(path)
    return rows.orderBy("partition", "offset").limit(n)


def read_route_stream(spark: SparkSession, path: str | None = None, kafka_servers: str | None = None,
                      max_files_per_trigger: int | None = None, max_offsets_per_trigger: int | None = None) -> DataFrame:
    """Start from the earliest offset; resume from the checkpoint afterwards. A micro-batch takes at most so many
    files (folder) or offsets (Kafka)."""
    if kafka_servers:
        r = _kafka(spark.readStream, kafka_servers)
        if max_offsets_per_trigger:
            r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        return _envelope(r.load())
    r = spark.readStream.schema(schemas.ENVELOPE)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def _start(df: DataFrame, fn, checkpoint: str, available_now: bool = True):
    w = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=POLL)
    return w.start()


def run(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


# ------------------------------------------------------------------ consumers (foreachBatch)
# A handler with a checkpoint takes the batch ids of its stream; without one they are the table's own numbers.
def audit_batch_handler(audit_path: str, rejects_path: str, compact_every: int | None = folds.BATCHES, checkpoint: str | None = None):
    """The audit consumer's micro-batch function (idempotent: safe to replay). A stream that begins again with a new
    checkpoint adds the events that are not stored yet; records that it rejects again are written again, with the same (partition, offset)."""
    origin = folds.Checkpoint(checkpoint) if checkpoint else None

    def handle(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        if origin:
            batch_id = ids.number_of(spark, H.ids_of(audit_path), origin.writer(spark), batch_id)
        parsed = H.parse_envelope(H.spread(batch)).persist()  # read by both writes below
        try:
            valid, rejects = H.split_valid(parsed)
            # per batch id, overwritten on replay: a re-run batch leaves no duplicate rejects
            rejects.select("key", "value", "partition", "offset", "timestamp", "reject_reason") \
                .write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")
            rows = H.to_audit_rows(H.first_per_event_id(valid.drop("key", "value")))
            H.append_audit(spark, rows, audit_path, batch_id, compact_every)
        finally:
            parsed.unpersist()
    return handle


def audit_log_query(stream: DataFrame, audit_path: str, rejects_path: str, checkpoint: str, compact_every: int | None = folds.BATCHES, **kw):
    """Write each change once to the audit table; rejects (malformed / missing fields) kept."""
    return _start(stream, audit_batch_handler(audit_path, rejects_path, compact_every, checkpoint), checkpoint, **kw)


def cache_batch_handler(cache_path: str, routes_fn, invalidate: bool = True, warm: bool = True, only_missing: bool = False,
                        compact_every: int | None = folds.BATCHES, checkpoint: str | None = None):
    """Invalidation and/or warming: a batch appends one change row per changed key. Where both are
    asked for, the refilled entry is the key's change: removing comes first, refilling last (Q20b)."""
    origin = folds.Checkpoint(checkpoint) if checkpoint else None

    def handle(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        if origin:
            batch_id = origin.number_of(spark, cache_path, batch_id)
        valid, _ = H.split_valid(H.parse_envelope(batch))
        if warm:
            live = None
            if only_missing and not invalidate:
                live = H.read_cache(spark, cache_path, H.changed_keys(valid).select(X.route_cache_key().alias("route_key")))
            rows = H.refilled(valid, routes_fn(spark), live).withColumn("deleted", F.lit(False))
        else:
            rows = H.removed(valid)
        if invalidate or warm:
            folds.append(rows, cache_path, batch_id)
            if folds.due(batch_id, compact_every):
                H.compact_cache(spark, cache_path, batch_id)
    return handle


def cache_query(stream: DataFrame, cache_path: str, routes_fn, checkpoint: str, invalidate: bool = True,
                warm: bool = True, only_missing: bool = False, compact_every: int | None = folds.BATCHES, **kw):
    """The cache consumers as a stream; ``handlers.read_cache`` reads the cache."""
    return _start(stream, cache_batch_handler(cache_path, routes_fn, invalidate, warm, only_missing, compact_every, checkpoint), checkpoint, **kw)


def _newest_event(rows: DataFrame) -> DataFrame:
    return folds.last_per_key(rows, X.ROUTE_COLS, ("partition", "offset"))


def key_order_query(stream: DataFrame, state_path: str, checkpoint: str, compact_every: int | None = folds.BATCHES, **kw):
    """Latest state per route: a batch appends the newest event by (partition, offset) of its keys."""
    origin = folds.Checkpoint(checkpoint)

    def handle(batch: DataFrame, batch_id: int):
        batch_id = origin.number_of(batch.sparkSession, state_path, batch_id)
        valid, _ = H.split_valid(H.parse_envelope(H.spread(batch)))
        folds.append(_newest_event(valid.select(*schemas.KEY_STATE.fieldNames())).select(*schemas.KEY_STATE.fieldNames()), state_path, batch_id)
        if folds.due(batch_id, compact_every):
            folds.compact(batch.sparkSession, state_path, schemas.KEY_STATE,
                          lambda rows: _newest_event(rows.drop("batch")).select(*schemas.KEY_STATE.fieldNames()), batch_id)
    return _start(stream, handle, checkpoint, **kw)


def read_key_state(spark: SparkSession, state_path: str) -> DataFrame:
    """Newest per route by (partition, offset), not by batch: a key lives in one partition,
    whose offsets order its events even when a later batch carries older records."""
    return _newest_event(folds.read(spark, state_path, schemas.KEY_STATE).drop("batch")).select(*X.ROUTE_COLS, "action", "url", "event_id")


# ------------------------------------------------------------------ windowed counters
def event_counters(events: DataFrame, window: str = "1 minute") -> DataFrame:
    """Counts per action and minute of a batch of envelope rows."""
    valid, _ = H.split_valid(H.parse_envelope(events))
    ev = valid.withColumn("ts", X.parse_iso_timestamp(F.col("occurred_at"), F.col("timestamp")))
    return (ev.groupBy(F.window("ts", window).alias("w"), "action").agg(F.count(F.lit(1)).alias("count"))
            .select(F.col("w.start").alias("window_start"), "action", "count"))


def request_metrics(requests: DataFrame, window: str = "1 minute", bounds=M.DEFAULT_BUCKETS) -> DataFrame:
    """Per-minute request count and cumulative latency buckets per endpoint of a batch."""
    v = F.col("elapsed_ms") / 1000.0
    aggs = [F.sum(F.when(v <= b, 1).otherwise(0)).cast("long").alias(f"le_{i}") for i, b in enumerate(bounds)]
    return (requests.groupBy(F.window("ts", window).alias("w"), "endpoint")
            .agg(F.count(F.lit(1)).alias("requests"), F.sum(v).alias("sum_seconds"), *aggs)
            .select(F.col("w.start").alias("window_start"), "endpoint", "requests", "sum_seconds", *[f"le_{i}" for i in range(len(bounds))]))


def _added(rows: DataFrame, keys) -> DataFrame:
    values = [c for c in rows.columns if c not in [*keys, "batch"]]
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


def counter_query(stream: DataFrame, count, keys, path: str, checkpoint: str, compact_every: int | None = folds.BATCHES, **kw):
    """Running counters without a watermark: every batch appends its own partial counts (``count(batch)``),
    readers add them up, so a row counts however late it comes, and a replayed batch counts once. A table belongs to one
    checkpoint: a query with another one, which would read the same rows again, fails."""
    origin = folds.Checkpoint(checkpoint)

    def handle(batch: DataFrame, batch_id: int):
        batch_id = origin.number_of(batch.sparkSession, path, batch_id, alone=True)
        partial = count(batch)
        folds.append(partial, path, batch_id)
        if folds.due(batch_id, compact_every):
            names = partial.columns
            folds.compact(batch.sparkSession, path, partial.schema, lambda rows: _added(rows, keys).select(*names), batch_id)
    return _start(stream, handle, checkpoint, **kw)


def read_counters(spark: SparkSession, path: str, keys, schema) -> DataFrame:
    """Counters of all batches; ``schema``: that of the partial counts."""
    return _added(folds.read(spark, path, schema), list(keys))


def publish_route_events(events: DataFrame, path: str | None = None, kafka_servers: str | None = None,
                         partitions: int = 4, order_cols=None) -> None:
    """Publish (key, value) rows: to the ``route-events`` topic when Kafka is given (key =
    route, so one route's events stay in one partition; rows are sorted by the order within each
    task), else appended to the topic folder ``path`` as the envelope that ``read_route_stream`` reads.

    ``order_cols``: columns of ``events`` that order the events; by default the time and then the id in the value. A key
    belongs to one partition; its offsets follow that order and continue those of earlier calls, without gaps unless a
    call failed (its offsets are not used again). One call at a time."""
    order = list(order_cols) if order_cols else ["_time", "_id"]
    rows = events.withColumns({"_time": X.parse_iso_timestamp(F.get_json_object("value", "$.occurred_at")), "_id": F.get_json_object("value", "$.event_id")})
    if kafka_servers:
        (rows.repartition(partitions, "key").sortWithinPartitions("key", *order)
         .select(F.col("key").cast("binary"), F.col("value").cast("binary")).write.format("kafka")
         .option("kafka.bootstrap.servers", kafka_servers).option("topic", TOPIC).save())
        return
    spark = events.sparkSession
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int").alias("partition"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], "key", "value")
    placed = dense_index(rows, ["partition", *[f"_o{i}" for i in range(len(order))]])
    # where a partition begins in the global order, and where its offsets go on
    counts = placed.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("partition", "n", (F.sum("n").over(Window.orderBy("partition")) - F.col("n")).alias("first"))
    heads = f"{path.rstrip('/')}-heads"
    call = folds.newest(spark, heads)
    reached = folds.read(spark, heads, HEADS).groupBy("partition").agg(F.max("next").alias("next"))
    first = cut_lineage(spark, first.join(reached, "partition", "left").select("partition", "n", "first", F.coalesce("next", F.lit(0).cast("long")).alias("base")), "heads")
    # reserved first: a call that fails after this leaves a gap, never an offset twice
    carried = reached.unionByName(first.select("partition", (F.col("base") + F.col("n")).alias("next"))).groupBy("partition").agg(F.max("next").alias("next"))
    folds.publish(spark, heads, folds.Version(call.version + 1, folds.write_base(carried, heads)))
    (placed.join(first, "partition")
     .select("key", "value", "partition", (F.col("base") + F.col("idx") - F.col("first")).alias("offset"), F.current_timestamp().alias("timestamp"))
     .write.mode("append").parquet(path))
