"""2.1 scans, sources and sinks; 2.3 trace and outage joins; 2.2 validation filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import expr as X
from ..operators import audit as A
from ..operators import catalog as C
from ..operators import dml as D
from ..operators import ingest as I
from ..session import scratch_path
from ..sources import lake
from ..sources.tables import CATALOG_AS_OF, Tables, flat_route
from .q_audit import AUDIT_SQL, flat
from .registry import register


@register("scan_catalog", """SELECT 'tenants' AS table_name, id, CAST(NULL AS BIGINT) AS parent_id, name FROM tenants
UNION ALL SELECT 'services', id, tenant_id, name FROM services
UNION ALL SELECT 'environments', id, service_id, name FROM environments
UNION ALL SELECT 'endpoints', id, environment_id, version FROM endpoints""")
def q_scan_catalog(spark, d):
    """The four tables written as a catalog snapshot and read back with their schemas."""
    from ..sources.catalog_io import read_catalog, write_catalog
    t = Tables(spark, d)
    c = read_catalog(spark, write_catalog(spark, {"tenants": t.tenants, "services": t.services,
                                                  "environments": t.environments, "endpoints": t.endpoints}))
    return D.union_all([
        c["tenants"].select(F.lit("tenants").alias("table_name"), "id", F.lit(None).cast("long").alias("parent_id"),
                            "name"),
        c["services"].select(F.lit("services").alias("table_name"), "id", F.col("tenant_id").alias("parent_id"), "name"),
        c["environments"].select(F.lit("environments").alias("table_name"), "id",
                                 F.col("service_id").alias("parent_id"), "name"),
        c["endpoints"].select(F.lit("endpoints").alias("table_name"), "id", F.col("environment_id").alias("parent_id"),
                              F.col("version").alias("name"))])


ROUTE_EVENTS_SCHEMA = ("id long, tenant string, service string, env string, version string, action string, "
                       "created_at timestamp, processed_at timestamp")


@register("scan_route_events", """SELECT event_seq AS id, tenant, service, env, version, action, occurred_at AS created_at,
       occurred_at + INTERVAL 1 SECOND AS processed_at FROM event_rows WHERE action IN ('created', 'activated', 'deactivated')""")
def q_scan_route_events(spark, d):
    """The legacy route_events table, written once and read back with its DDL schema."""
    t = Tables(spark, d)
    rows = t.event_rows.filter(F.col("action").isin(*X.ACTIONS)).select(
        F.col("event_seq").alias("id"), "tenant", "service", "env", "version", "action",
        F.col("occurred_at").alias("created_at"), X.ts_plus_seconds(F.col("occurred_at"), 1).alias("processed_at"))
    path = lake.write_snapshot(spark, rows, "route_events")
    return spark.read.schema(ROUTE_EVENTS_SCHEMA).parquet(path)


shape_route_event = A.shape_route_event


ISO_Z = ("CASE WHEN microsecond(occurred_at) % 1000000 = 0 THEN strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') "
         "ELSE strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f') END || 'Z'")
SHAPE_SQL = f"""SELECT tenant || ':' || service || ':' || env || ':' || version AS key,
       CAST(to_json({{'event_id': event_id, 'event_type': 'route_changed', 'action': action, 'tenant': tenant,
                 'service': service, 'env': env, 'version': version, 'url': url, 'occurred_at': {ISO_Z},
                 'correlation_id': correlation_id}}) AS VARCHAR) AS value
  FROM audit"""


@register("shape_route_event", SHAPE_SQL)
def q_shape_route_event(spark, d):
    return shape_route_event(flat_route(Tables(spark, d).audit))


@register("sink_route_stream", SHAPE_SQL)
def q_sink_route_stream(spark, d):
    """Publish: rows appended to the topic folder, and consumed from it by the stream reader."""
    from ..streaming import streams as S
    path = scratch_path(spark, "route-events-topic")
    S.publish_route_events(shape_route_event(flat_route(Tables(spark, d).audit)), path=path)
    out, ck = scratch_path(spark, "route-events-read"), scratch_path(spark, "ckpt-route-events")

    def handle(batch, batch_id):
        batch.select("key", "value").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    S.run(S._start(S.read_route_stream(spark, path), handle, ck))
    return spark.read.parquet(out).drop("batch")


@register("sink_audit", f"SELECT {AUDIT_SQL} FROM audit")
def q_sink_audit(spark, d):
    """The audit sink fed twice with the same batch: the second append adds nothing."""
    from ..streaming.handlers import append_audit
    t = Tables(spark, d)
    path = scratch_path(spark, "audit-sink")
    append_audit(spark, t.audit, path)
    append_audit(spark, t.audit, path)
    return flat(lake.read_audit(spark, path))


@register("sink_cache_snapshot", f"""WITH k AS (SELECT DISTINCT tenant, service, env, version FROM route_requests),
act AS (SELECT tenant, service, env, version, url FROM route_table WHERE is_active)
SELECT 'route:' || k.tenant || ':' || k.service || ':' || k.env || ':' || k.version AS route_key, a.url,
       a.url IS NULL AS is_negative,
       CASE WHEN a.url IS NOT NULL THEN TIMESTAMP '{CATALOG_AS_OF}' + INTERVAL 60 SECOND
            ELSE TIMESTAMP '{CATALOG_AS_OF}' + INTERVAL 10 SECOND END AS expires_at
  FROM k LEFT JOIN act a ON k.tenant = a.tenant AND k.service = a.service AND k.env = a.env AND k.version = a.version""")
def q_sink_cache_snapshot(spark, d):
    """Every requested key resolved once and materialised as a new cache snapshot."""
    t = Tables(spark, d)
    rows = C.warm_join(t.route_requests, t.route_table, CATALOG_AS_OF)
    path = lake.write_snapshot(spark, rows, "cache-snapshot")
    return lake.read_snapshot(spark, path, schemas.CACHE)


EXPO_SQL = """SELECT metric, instance, endpoint, value, 'counter' AS type FROM (
  SELECT *, row_number() OVER (PARTITION BY metric, instance, endpoint ORDER BY ts DESC, value DESC) AS rn
    FROM counter_samples) t WHERE rn = 1"""


@register("scan_exposition_text", EXPO_SQL)
def q_scan_exposition_text(spark, d):
    """Latest counters rendered as exposition text, written as a text file, parsed back."""
    t = Tables(spark, d)
    path = scratch_path(spark, "metrics-text")
    I.render_exposition(t.counter_samples).write.text(path)
    p = I.parse_exposition(I.read_text(spark, path))
    return p.select("metric", F.col("labels")["instance"].alias("instance"),
                    F.col("labels")["endpoint"].alias("endpoint"), "value", "type")


@register("scan_app_log", """SELECT date_trunc('millisecond', ts) AS ts, correlation_id, 'api.app' AS logger,
       CASE WHEN status_code >= 500 OR status_code = 0 THEN 'ERROR' WHEN status_code >= 400 THEN 'WARNING' ELSE 'INFO' END
         AS level,
       method || ' /api/' || endpoint || ' -> ' || CAST(status_code AS VARCHAR) AS message,
       CAST(NULL AS VARCHAR) AS reject_reason
  FROM request_log""")
def q_scan_app_log(spark, d):
    t = Tables(spark, d)
    path = scratch_path(spark, "app-log")
    I.render_app_log(t.request_log).write.text(path)
    return I.parse_app_log(I.read_text(spark, path))


@register("trace_by_correlation", """SELECT correlation_id, ts, source, detail,
       row_number() OVER (PARTITION BY correlation_id ORDER BY ts, source, detail) AS step
  FROM (SELECT correlation_id, ts, 'request' AS source, CAST(status_code AS VARCHAR) AS detail FROM request_log
        UNION ALL SELECT correlation_id, date_trunc('millisecond', ts), 'log',
                         CASE WHEN status_code >= 500 OR status_code = 0 THEN 'ERROR'
                              WHEN status_code >= 400 THEN 'WARNING' ELSE 'INFO' END FROM request_log
        UNION ALL SELECT correlation_id, occurred_at, 'audit', action FROM audit) u""")
def q_trace_by_correlation(spark, d):
    """One timeline per request id across the request log, the application log lines
    (written as text and parsed back) and the audit rows."""
    t = Tables(spark, d)
    path = scratch_path(spark, "app-log")
    I.render_app_log(t.request_log).write.text(path)
    logs = I.parse_app_log(I.read_text(spark, path))
    return I.trace_by_correlation({
        "request": t.request_log.select("correlation_id", "ts", F.col("status_code").alias("detail")),
        "log": logs.select("correlation_id", "ts", F.col("level").alias("detail")),
        "audit": t.audit.select("correlation_id", F.col("occurred_at").alias("ts"), F.col("action").alias("detail"))})


@register("outage_changes", f"""SELECT a.event_id, a.action, a.tenant, a.service, a.env, a.version, a.occurred_at,
       o.outage_id, o.start_ts, o.end_ts
  FROM audit a JOIN outages o ON a.occurred_at BETWEEN o.start_ts AND o.end_ts""")
def q_outage_changes(spark, d):
    t = Tables(spark, d)
    ch = flat_route(t.audit).select("event_id", "action", "tenant", "service", "env", "version", "occurred_at")
    return I.outage_changes(ch, t.outages)


@register("filter_required_fields", """SELECT event_id, CASE WHEN action IS NULL OR action = '' OR tenant IS NULL OR tenant = ''
       OR service IS NULL OR service = '' OR env IS NULL OR env = '' OR version IS NULL OR version = ''
       THEN 'missing_field' END AS reject_reason FROM event_rows""")
def q_filter_required_fields(spark, d):
    r = Tables(spark, d).event_rows
    ok = X.all_present("action", *X.ROUTE_COLS)
    return r.select("event_id", F.when(~ok, F.lit("missing_field")).alias("reject_reason"))


@register("filter_action_valid", "SELECT event_id, action FROM event_rows WHERE action IN ('created', 'activated', 'deactivated')")
def q_filter_action_valid(spark, d):
    return Tables(spark, d).event_rows.filter(X.action_valid()).select("event_id", "action")


@register("shape_audit_doc", f"SELECT {AUDIT_SQL} FROM audit")
def q_shape_audit_doc(spark, d):
    """Flat change events (valid actions) shaped into audit rows with the store's defaults."""
    r = Tables(spark, d).event_rows.filter(X.action_valid())
    shaped = A.shape_audit_doc(r.select("event_id", "action", *X.ROUTE_COLS, "url", "changed_by", "occurred_at",
                                        "correlation_id"),
                               processed_at=X.ts_plus_seconds(F.col("occurred_at"), 1))
    return flat(shaped)


@register("route_state_at_outage_start", """WITH p AS (
  SELECT DISTINCT o.outage_id, a.tenant, a.service, a.env, a.version, o.start_ts AS at
    FROM audit a JOIN outages o ON a.occurred_at BETWEEN o.start_ts AND o.end_ts),
c AS (SELECT tenant, service, env, version, occurred_at, action, url FROM audit
      QUALIFY row_number() OVER (PARTITION BY tenant, service, env, version, occurred_at ORDER BY event_id DESC) = 1)
SELECT p.outage_id, p.tenant, p.service, p.env, p.version, p.at, c.action AS action_then, c.url AS url_then,
       coalesce(c.action <> 'deactivated', FALSE) AS active_then, c.occurred_at AS changed_at
  FROM p ASOF LEFT JOIN c ON p.tenant = c.tenant AND p.service = c.service AND p.env = c.env
                         AND p.version = c.version AND p.at >= c.occurred_at""")
def q_route_state_at_outage_start(spark, d):
    """Every route changed during an outage, with its state when the outage began (as-of
    join for many T: one T per outage)."""
    t = Tables(spark, d)
    ch = flat_route(t.audit).select("event_id", "action", "tenant", "service", "env", "version", "occurred_at")
    probes = (I.outage_changes(ch, t.outages).select("outage_id", "tenant", "service", "env", "version",
                                                     F.col("start_ts").alias("at")).distinct())
    return A.route_state_at(t.audit, probes, "at")
