"""2.9 scalar functions, each checked as a column over a fixture table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import catalog as C
from ..sources.tables import CATALOG_AS_OF, Tables
from .q_catalog import CACHE_ASIDE_SQL
from .registry import register


def rows(spark, d):
    return Tables(spark, d).event_rows


@register("route_cache_key", "SELECT event_id, 'route:' || tenant || ':' || service || ':' || env || ':' || version AS route_key FROM event_rows")
def q_route_cache_key(spark, d):
    return rows(spark, d).select("event_id", X.route_cache_key().alias("route_key"))


@register("route_partition_key", "SELECT event_id, tenant || ':' || service || ':' || env || ':' || version AS partition_key FROM event_rows")
def q_route_partition_key(spark, d):
    return rows(spark, d).select("event_id", X.route_partition_key().alias("partition_key"))


@register("route_label", """SELECT event_id, tenant || '/' || service || '/' || env || '/' || version AS label,
       'Route not found: ' || tenant || '/' || service || '/' || env || '/' || version AS not_found_message FROM event_rows""")
def q_route_label(spark, d):
    return rows(spark, d).select("event_id", X.route_label().alias("label"), X.not_found_message().alias("not_found_message"))


@register("split_route_key", """SELECT route_key, split_part(k, ':', 1) AS tenant, split_part(k, ':', 2) AS service,
       split_part(k, ':', 3) AS env, split_part(k, ':', 4) AS version
  FROM (SELECT route_key, regexp_replace(route_key, '^route:', '') AS k FROM cache_snapshot) c""")
def q_split_route_key(spark, d):
    c = Tables(spark, d).cache_snapshot
    return c.select("route_key", X.split_route_key("route_key").alias("p")).select("route_key", "p.*")


# ISO strings in four shapes: Z, +05:00 offset, no zone, junk (chosen by the event's k)
def _iso_inputs(t: Tables):
    e = t.events
    k = F.get_json_object("props", "$.k").cast("int")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.date_format(F.col("ts") + F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    s = (F.when(k % 4 == 0, F.concat(base, F.lit("Z"))).when(k % 4 == 1, F.concat(shifted, F.lit("+05:00")))
         .when(k % 4 == 2, base).otherwise(F.lit("not-a-time")))
    return e.select("event_id", "ts", s.alias("raw"))


ISO_INPUT_SQL = """SELECT event_id, ts, CASE WHEN k % 4 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
            WHEN k % 4 = 1 THEN strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+05:00'
            WHEN k % 4 = 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') ELSE 'not-a-time' END AS raw
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e"""


@register("parse_iso_timestamp", f"""SELECT event_id, raw,
       coalesce(CASE WHEN raw LIKE '%Z' OR raw LIKE '%+__:__' THEN TRY_CAST(raw AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
                     ELSE TRY_CAST(raw AS TIMESTAMP) END, ts + INTERVAL 1 SECOND) AS occurred_at,
       (CASE WHEN raw LIKE '%Z' OR raw LIKE '%+__:__' THEN TRY_CAST(raw AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
             ELSE TRY_CAST(raw AS TIMESTAMP) END) IS NULL AS occurred_at_defaulted
  FROM ({ISO_INPUT_SQL}) i""")
def q_parse_iso_timestamp(spark, d):
    """Q4/Q5: offsets to UTC, zone-less kept, junk -> ingest time (here ts + 1 s) + flag."""
    i = _iso_inputs(Tables(spark, d))
    ingest = X.ts_plus_seconds(F.col("ts"), 1)
    return i.select("event_id", "raw", X.parse_iso_timestamp("raw", ingest).alias("occurred_at"),
                    X.parse_iso_timestamp("raw").isNull().alias("occurred_at_defaulted"))


ISO = ("CASE WHEN microsecond({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') "
       "ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END")


@register("format_iso_timestamp", f"""SELECT CAST(event_id AS VARCHAR) AS id, {ISO.format(c='ts')} AS iso, {ISO.format(c='ts')} || 'Z' AS iso_z FROM events
UNION ALL SELECT 'ep-' || CAST(endpoint_id AS VARCHAR), {ISO.format(c='updated_at')}, {ISO.format(c='updated_at')} || 'Z' FROM route_table""")
def q_format_iso_timestamp(spark, d):
    """Both shapes of isoformat(): with microseconds (events) and without (catalog dates)."""
    t = Tables(spark, d)
    a = t.events.select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("t"))
    b = t.route_table.select(F.concat(F.lit("ep-"), F.col("endpoint_id").cast("string")).alias("id"),
                             F.col("updated_at").alias("t"))
    u = a.unionByName(b)
    return u.select("id", X.format_iso_timestamp("t").alias("iso"), X.format_iso_timestamp("t", zulu=True).alias("iso_z"))


@register("format_day_clock", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS clock FROM events")
def q_format_day_clock(spark, d):
    return Tables(spark, d).events.select("event_id", X.format_day("ts").alias("day"), X.format_clock("ts").alias("clock"))


def _uuid_sql(seed: str) -> str:
    h = f"sha256({seed})"
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
            f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")


@register("new_event_id", f"""SELECT event_id, {_uuid_sql("CAST(event_id AS VARCHAR)")} AS new_event_id,
       'req-' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 16) AS new_correlation_id FROM events""")
def q_new_event_id(spark, d):
    """Repeatable ids (seeded by a key); the unseeded forms are random (pattern-tested)."""
    e = Tables(spark, d).events
    return e.select("event_id", X.new_event_id(F.col("event_id")).alias("new_event_id"),
                    X.new_correlation_id(F.col("event_id")).alias("new_correlation_id"))


@register("default_correlation_id", """SELECT request_id, coalesce(nullif(cid, ''), 'req-' || substr(sha256(CAST(request_id AS VARCHAR)), 1, 16))
         AS correlation_id, coalesce(nullif(cid, ''), '-') AS log_correlation_id
  FROM (SELECT request_id, CASE WHEN cid_from_client THEN correlation_id ELSE '' END AS cid FROM request_log) r""")
def q_default_correlation_id(spark, d):
    """Client ids kept; missing ('' here) ids generated; logs print '-' when there is none."""
    r = Tables(spark, d).request_log
    cid = F.when(F.col("cid_from_client"), F.col("correlation_id")).otherwise(F.lit(""))
    return r.select("request_id", X.default_correlation_id(cid, F.col("request_id")).alias("correlation_id"),
                    X.log_correlation_id(cid).alias("log_correlation_id"))


@register("event_to_json", """SELECT event_id, CAST(to_json({'event_id': event_id, 'action': action, 'tenant': tenant, 'url': url}) AS VARCHAR) AS value
  FROM event_rows""")
def q_event_to_json(spark, d):
    return rows(spark, d).select("event_id", X.event_to_json("event_id", "action", "tenant", "url").alias("value"))


@register("event_from_json", "SELECT event_id, action, tenant, url FROM event_rows")
def q_event_from_json(spark, d):
    from .. import schemas
    j = rows(spark, d).select(X.event_to_json("event_id", "action", "tenant", "url").alias("value"))
    p = j.select(X.event_from_json("value", schemas.ROUTE_EVENT).alias("e"))
    return p.select("e.event_id", "e.action", "e.tenant", "e.url")


@register("default_fields", """SELECT event_id, coalesce(nullif(action, ''), 'unknown') AS action_or_unknown,
       CASE WHEN event_seq % 2 = 0 THEN 'custom' ELSE 'route_changed' END AS event_type,
       CAST(CASE WHEN event_seq % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS metadata_size FROM event_rows""")
def q_default_fields(spark, d):
    """A missing event_type becomes 'route_changed' (metadata {}); display fields 'unknown'."""
    r = (rows(spark, d).withColumn("event_type", F.when(F.col("event_seq") % 2 == 0, F.lit("custom")))
         .withColumn("metadata", F.when(F.col("event_seq") % 3 == 0, F.create_map(F.lit("k"), F.lit("v")))))
    event_type, metadata = X.default_fields("event_type", "metadata")
    return r.select("event_id", X.display_or_unknown("action").alias("action_or_unknown"),
                    event_type.alias("event_type"), F.size(metadata).cast("long").alias("metadata_size"))


@register("route_url_template", """SELECT event_id, CASE user_id % 6
    WHEN 0 THEN 'https://' || service || '.' || tenant || '.example.com/' || version
    WHEN 1 THEN 'https://' || service || '-' || env || '.' || tenant || '.example.com/' || version
    WHEN 2 THEN 'https://' || tenant || '-' || service || '.example.com/' || version
    WHEN 3 THEN 'https://api.' || tenant || '.example.com/' || service || '/' || version
    WHEN 4 THEN 'https://' || service || '.api.' || tenant || '.example.com/' || version
    ELSE 'https://' || env || '.' || service || '.' || tenant || '.example.com/' || version END AS url FROM event_rows""")
def q_route_url_template(spark, d):
    r = rows(spark, d)
    return r.select("event_id", X.route_url_template(F.col("user_id") % 6 + 1).alias("url"))


@register("cache_ttl_remaining", f"""SELECT route_key, CAST(greatest(floor((epoch_us(expires_at) - epoch_us(TIMESTAMP '{CATALOG_AS_OF}')) / 1000000), 0)
         AS BIGINT) AS ttl_seconds FROM cache_snapshot""")
def q_cache_ttl_remaining(spark, d):
    c = Tables(spark, d).cache_snapshot
    return c.select("route_key", X.cache_ttl_remaining("expires_at", F.lit(CATALOG_AS_OF).cast("timestamp")).alias("ttl_seconds"))


@register("status_of_resolve", f"""SELECT request_id, outcome, CASE WHEN outcome = 'negative_hit' THEN 404
       WHEN outcome = 'miss' AND url IS NULL THEN 404 ELSE 200 END AS status_code FROM ({CACHE_ASIDE_SQL}) r""")
def q_status_of_resolve(spark, d):
    t = Tables(spark, d)
    r = C.resolve_cache_aside(t.route_requests, t.cache_snapshot, t.route_table, CATALOG_AS_OF)
    o = F.when((F.col("outcome") == "miss") & F.col("url").isNull(), F.lit("not_found")).otherwise(F.col("outcome"))
    return r.select("request_id", "outcome", X.status_of_resolve(o).alias("status_code"))


@register("format_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def q_format_day(spark, d):
    return Tables(spark, d).events.select("event_id", X.format_day("ts").alias("day"))


@register("format_clock", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def q_format_clock(spark, d):
    return Tables(spark, d).events.select("event_id", X.format_clock("ts").alias("clock"))


@register("new_correlation_id", """SELECT request_id, 'req-' || substr(sha256(CAST(request_id AS VARCHAR)), 1, 16) AS correlation_id
  FROM request_log""")
def q_new_correlation_id(spark, d):
    r = Tables(spark, d).request_log
    return r.select("request_id", X.new_correlation_id(F.col("request_id")).alias("correlation_id"))
