"""2.10 streaming: every query runs with ``availableNow`` over envelope files derived from
``events`` (written to the shared folder) and returns its sink read back as a batch."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import audit as A
from ..session import scratch_path
from ..sources.tables import Tables
from ..streaming import handlers as H
from ..streaming import streams as S
from .q_audit import AUDIT_COLS, flat
from .registry import register


#: Records of one envelope file: what one task sorts and writes, however long the topic is.
ROWS_PER_FILE = 250_000


def envelope_files(spark, t: Tables, value=None) -> str:
    """The change stream as files with the five envelope columns, in ranges of (partition, offset) and sorted by them.
    The narrow ``events`` rows are shuffled and sorted; keys and JSON values are built from the sorted rows."""
    path = scratch_path(spark, "route-events")
    files = max(4, math.ceil(t.events.count() / ROWS_PER_FILE))
    order = t.topic_order()
    events = t.events.repartitionByRange(files, *order, "ts", "user_id").sortWithinPartitions(*order)
    t.envelopes(events).withColumn("value", F.col("value") if value is None else value).write.parquet(path)
    return path


STREAM_AUDIT_SQL = """SELECT event_id, 'route_changed' AS event_type, action, tenant, service, env, version, url,
       CAST(NULL AS VARCHAR) AS previous_url, CAST(NULL AS VARCHAR) AS previous_state, CAST(NULL AS VARCHAR) AS changed_by,
       occurred_at, correlation_id
  FROM event_rows WHERE action IS NOT NULL"""
STREAM_AUDIT_COLS = [c for c in AUDIT_COLS if c != "processed_at"]


def _audit_run(spark, d, restart: bool = False, value=None):
    t = Tables(spark, d)
    src = envelope_files(spark, t, value)
    audit, rej, ck = (scratch_path(spark, n) for n in ("audit", "rejects", "ckpt-audit"))
    S.run(S.audit_log_query(S.read_route_stream(spark, src), audit, rej, ck))
    if restart:  # same checkpoint: resumes after the committed offsets, adds nothing
        S.run(S.audit_log_query(S.read_route_stream(spark, src), audit, rej, ck))
    return audit, rej


@register("stream_audit_log", STREAM_AUDIT_SQL)
def q_stream_audit_log(spark, d):
    from ..sources import lake
    audit, _ = _audit_run(spark, d)
    return flat(lake.read_audit(spark, audit)).select(*STREAM_AUDIT_COLS)


@register("stream_offsets", STREAM_AUDIT_SQL)
def q_stream_offsets(spark, d):
    from ..sources import lake
    audit, _ = _audit_run(spark, d, restart=True)
    return flat(lake.read_audit(spark, audit)).select(*STREAM_AUDIT_COLS)


@register("stream_parse_validate", """SELECT event_id, CASE WHEN action IS NULL OR action = '' THEN 'missing_field' END AS reject_reason
  FROM event_rows""")
def q_stream_parse_validate(spark, d):
    t = Tables(spark, d)
    src = envelope_files(spark, t)
    out, ck = scratch_path(spark, "parsed"), scratch_path(spark, "ckpt-parse")

    def handle(batch, batch_id):
        # by batch id, overwritten on replay: a re-run batch leaves no row twice
        H.parse_envelope(batch).select("event_id", "reject_reason").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    S.run(S._start(S.read_route_stream(spark, src), handle, ck))
    return spark.read.parquet(out).drop("batch")


@register("source_route_stream", """SELECT key, event_id, action, tenant, service, env, version, url, correlation_id
  FROM (SELECT CASE WHEN action IS NOT NULL THEN tenant || ':' || service || ':' || env || ':' || version
                    ELSE tenant || ':' || service || ':' || env || ':' || version END AS key, * FROM event_rows) e""")
def q_source_route_stream(spark, d):
    t = Tables(spark, d)
    src = envelope_files(spark, t)
    out, ck = scratch_path(spark, "decoded"), scratch_path(spark, "ckpt-decode")

    def handle(batch, batch_id):
        H.parse_envelope(batch).select("key", "event_id", "action", *X.ROUTE_COLS, "url", "correlation_id") \
            .write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    S.run(S._start(S.read_route_stream(spark, src), handle, ck))
    return spark.read.parquet(out).drop("batch")


STALE_URL = "https://stale.example.com/"


def stream_catalog(t: Tables):
    """The catalog the change events describe: newest state per route."""
    return A.route_state_latest(t.audit)


def _cache_run(spark, d, invalidate: bool, warm: bool):
    t = Tables(spark, d)
    src = envelope_files(spark, t)
    cache, ck = scratch_path(spark, "cache"), scratch_path(spark, "ckpt-cache")
    # starting snapshot: the catalog's cache plus stale entries for every route the stream
    # changes (all of them must be invalidated / refilled)
    stale = (t.event_rows.select(X.route_cache_key().alias("route_key")).distinct()
             .select("route_key", F.lit(STALE_URL).alias("url"), F.lit(False).alias("is_negative"),
                     F.lit("2100-01-01 00:00:00").cast("timestamp").alias("expires_at")))
    H.start_cache(t.cache_snapshot.unionByName(stale), cache)
    cat = stream_catalog(t)
    S.run(S.cache_query(S.read_route_stream(spark, src), cache, lambda s: cat, ck, invalidate=invalidate, warm=warm))
    return H.read_cache(spark, cache)


@register("stream_cache_invalidation", "SELECT * FROM cache_snapshot")
def q_stream_cache_invalidation(spark, d):
    """Every stale entry of a changed route is removed; the catalog's entries stay."""
    return _cache_run(spark, d, invalidate=True, warm=False)


WARM_SQL = """WITH k AS (SELECT tenant, service, env, version, max(occurred_at) AS as_of FROM event_rows
                  WHERE action IS NOT NULL GROUP BY tenant, service, env, version),
st AS (SELECT tenant, service, env, version, url, action FROM audit
        QUALIFY row_number() OVER (PARTITION BY tenant, service, env, version ORDER BY occurred_at DESC, event_id DESC) = 1),
w AS (SELECT 'route:' || k.tenant || ':' || k.service || ':' || k.env || ':' || k.version AS route_key,
             CASE WHEN st.action <> 'deactivated' THEN st.url END AS url,
             NOT coalesce(st.action <> 'deactivated', FALSE) AS is_negative,
             CASE WHEN coalesce(st.action <> 'deactivated', FALSE) THEN k.as_of + INTERVAL 60 SECOND
                  ELSE k.as_of + INTERVAL 10 SECOND END AS expires_at
        FROM k LEFT JOIN st ON k.tenant = st.tenant AND k.service = st.service AND k.env = st.env AND k.version = st.version)
SELECT * FROM cache_snapshot WHERE route_key NOT IN (SELECT route_key FROM w) UNION ALL SELECT * FROM w"""


@register("stream_cache_warming", WARM_SQL)
def q_stream_cache_warming(spark, d):
    return _cache_run(spark, d, invalidate=True, warm=True)


@register("stream_key_order", """SELECT tenant, service, env, version, action, url, event_id FROM event_rows
 WHERE action IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY tenant, service, env, version ORDER BY user_id % 4 DESC, event_seq DESC) = 1""")
def q_stream_key_order(spark, d):
    """Per key the event with the highest (partition, offset): the order Kafka keeps per key."""
    t = Tables(spark, d)
    src = envelope_files(spark, t)
    state, ck = scratch_path(spark, "key-state"), scratch_path(spark, "ckpt-key")
    S.run(S.key_order_query(S.read_route_stream(spark, src), state, ck))
    return S.read_key_state(spark, state)


@register("stream_correlation", """SELECT event_id, CASE WHEN event_seq % 3 = 0 THEN 'req-' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 16)
            ELSE correlation_id END AS correlation_id
  FROM event_rows WHERE action IS NOT NULL""")
def q_stream_correlation(spark, d):
    """The id travels from the event to the audit row; every third record comes without one, and its id is generated."""
    from ..sources import lake
    lost = F.regexp_replace("value", '"correlation_id":"[^"]*"', '"correlation_id":""')
    audit, _ = _audit_run(spark, d, value=F.when(F.col("offset") % 3 == 0, lost).otherwise(F.col("value")))
    a = lake.read_audit(spark, audit)
    return a.select("event_id", X.default_correlation_id(F.col("correlation_id"), F.col("event_id")).alias("correlation_id"))


@register("stream_event_counters", """SELECT date_trunc('minute', occurred_at) AS window_start, action, count(*) AS count
  FROM event_rows WHERE action IS NOT NULL GROUP BY 1, 2""")
def q_stream_event_counters(spark, d):
    t = Tables(spark, d)
    src = envelope_files(spark, t)
    out, ck = scratch_path(spark, "counters"), scratch_path(spark, "ckpt-counters")
    keys = ["window_start", "action"]
    S.run(S.counter_query(S.read_route_stream(spark, src), S.event_counters, keys, out, ck))
    return S.read_counters(spark, out, keys, "window_start timestamp, action string, count long")


@register("stream_request_metrics", """SELECT date_trunc('minute', ts) AS window_start, endpoint, count(*) AS requests,
       count(*) FILTER (WHERE elapsed_ms / 1000.0 <= 0.25) AS le_0_25, count(*) FILTER (WHERE elapsed_ms / 1000.0 <= 1.0) AS le_1
  FROM request_log GROUP BY 1, 2""")
def q_stream_request_metrics(spark, d):
    t = Tables(spark, d)
    path = scratch_path(spark, "request-log")
    t.request_log.write.parquet(path)
    stream = spark.readStream.schema(t.request_log.schema).parquet(path)
    out, ck = scratch_path(spark, "req-metrics"), scratch_path(spark, "ckpt-req")
    keys = ["window_start", "endpoint"]
    S.run(S.counter_query(stream, S.request_metrics, keys, out, ck))
    r = S.read_counters(spark, out, keys, S.request_metrics(t.request_log).schema)
    i25, i1 = [list(S.M.DEFAULT_BUCKETS).index(b) for b in (0.25, 1.0)]
    return r.select("window_start", "endpoint", "requests", F.col(f"le_{i25}").alias("le_0_25"), F.col(f"le_{i1}").alias("le_1"))


@register("stream_group_isolation", """SELECT 'audit_log' AS consumer, count(*) AS processed FROM event_rows
UNION ALL SELECT c.consumer, (SELECT count(DISTINCT tenant || ':' || service || ':' || env || ':' || version) FROM event_rows
                               WHERE action IS NOT NULL AND action <> '')
  FROM (SELECT 'cache_invalidation' AS consumer UNION ALL SELECT 'cache_warming') c""")
def q_stream_group_isolation(spark, d):
    """The three consumers of one topic, one checkpoint each: the records that the audit stored or
    rejected, the stale routes that invalidation removed, and those that warming refilled."""
    from ..sources import lake
    t = Tables(spark, d)
    audit, rejects = _audit_run(spark, d)
    stored = lake.read_audit(spark, audit).select("event_id").unionByName(spark.read.parquet(rejects).select(F.lit("-").alias("event_id")))
    stale = t.event_rows.select(X.route_cache_key().alias("route_key")).distinct()

    def changed(cache):
        left = cache.filter(F.col("url") == STALE_URL).select("route_key")
        return stale.join(left, "route_key", "left_anti")
    parts = [("audit_log", stored), ("cache_invalidation", changed(_cache_run(spark, d, invalidate=True, warm=False))),
             ("cache_warming", changed(_cache_run(spark, d, invalidate=False, warm=True)))]
    out = [df.agg(F.count(F.lit(1)).alias("processed")).select(F.lit(c).alias("consumer"), "processed") for c, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("peek_events", """SELECT "partition", "offset", coalesce(event_id, 'unknown') AS event_id,
       coalesce(action, 'unknown') AS action, coalesce(tenant, 'unknown') AS tenant
  FROM (SELECT user_id % 4 AS "partition", event_seq AS "offset", event_id, action, tenant FROM event_rows) e
 ORDER BY "partition", "offset" LIMIT 5""")
def q_peek_events(spark, d):
    """First 5 records from the beginning (batch read of the topic), fields with defaults."""
    t = Tables(spark, d)
    src = envelope_files(spark, t)
    e = S.peek(spark, 5, path=src)
    def field(f):
        return F.coalesce(F.get_json_object("value", f"$.{f}"), F.lit("unknown")).alias(f)
    return e.select(F.col("partition").cast("long").alias("partition"), "offset", field("event_id"), field("action"),
                    field("tenant"))
