"""Audit filters, projections, newest-first reports, aggregations and state over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import dml as D
from ..sources.tables import EVENTS_AS_OF, Tables, flat_route
from .registry import register

AUDIT_COLS = ["event_id", "event_type", "action", "tenant", "service", "env", "version", "url", "previous_url",
              "previous_state", "changed_by", "occurred_at", "processed_at", "correlation_id"]
AUDIT_SQL = ", ".join(AUDIT_COLS)
ASOF = f"TIMESTAMP '{EVENTS_AS_OF}'"
# route of user 1 (and every user = 1 mod 60)
R = ("team-1", "svc-1", "staging", "v2")
R_SQL = f"tenant = '{R[0]}' AND service = '{R[1]}' AND env = '{R[2]}' AND version = '{R[3]}'"
RANGE = ("2024-01-10 00:00:00", "2024-01-12 12:00:00")
ROUTE_SQL = "tenant, service, env, version"


def iso(col: str) -> str:
    return (f"CASE WHEN microsecond({col}) % 1000000 = 0 THEN strftime({col}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({col}, '%Y-%m-%dT%H:%M:%S.%f') END")


HIST_SQL = (f"event_id, action, url, previous_url, previous_state, changed_by, {iso('occurred_at')} AS occurred_at, "
            f"{iso('processed_at')} AS processed_at")
EVENT_SQL = (f"event_id, event_type, action, {ROUTE_SQL}, url, previous_url, previous_state, changed_by, "
             f"{iso('occurred_at')} AS occurred_at, {iso('processed_at')} AS processed_at")


def flat(df: DataFrame) -> DataFrame:
    d = flat_route(df) if "route" in df.columns else df
    return d.select(*[c for c in AUDIT_COLS if c in d.columns])


def audit(spark, d):
    return Tables(spark, d).audit


@register("filter_route_path", f"SELECT {AUDIT_SQL} FROM audit WHERE {R_SQL}")
def q_filter_route_path(spark, d):
    return flat(A.filter_route_path(audit(spark, d), *R))


@register("filter_optional", f"SELECT {AUDIT_SQL} FROM audit WHERE tenant = 'team-1'")
def q_filter_optional(spark, d):
    return flat(A.filter_optional(audit(spark, d), tenant="team-1", service="", env=None))


@register("filter_recent_days", f"SELECT {AUDIT_SQL} FROM audit WHERE occurred_at >= {ASOF} - INTERVAL 7 DAY")
def q_filter_recent_days(spark, d):
    return flat(A.filter_recent(audit(spark, d), EVENTS_AS_OF, days=7))


@register("filter_recent_hours", f"SELECT {AUDIT_SQL} FROM audit WHERE occurred_at >= {ASOF} - INTERVAL 48 HOUR")
def q_filter_recent_hours(spark, d):
    return flat(A.filter_recent(audit(spark, d), EVENTS_AS_OF, hours=48))


@register("filter_time_range", f"""SELECT {AUDIT_SQL} FROM audit
 WHERE occurred_at BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'""")
def q_filter_time_range(spark, d):
    return flat(A.filter_time_range(audit(spark, d), *RANGE))


@register("filter_action_in", f"""SELECT {AUDIT_SQL} FROM audit
 WHERE action IN ('deactivated', 'created') AND occurred_at >= {ASOF} - INTERVAL 7 DAY""")
def q_filter_action_in(spark, d):
    return flat(A.filter_action_in(audit(spark, d), ["deactivated", "created"], EVENTS_AS_OF, 7))


@register("filter_partial_route_recent", f"""SELECT {AUDIT_SQL} FROM audit
 WHERE tenant = 'team-1' AND service = 'svc-1' AND env = 'staging' AND occurred_at >= {ASOF} - INTERVAL 14 DAY""")
def q_filter_partial_route_recent(spark, d):
    return flat(A.filter_partial_route_recent(audit(spark, d), "team-1", "svc-1", "staging", EVENTS_AS_OF, 14))


@register("filter_route_recent", f"""SELECT {AUDIT_SQL} FROM audit
 WHERE {R_SQL} AND occurred_at >= {ASOF} - INTERVAL 30 DAY""")
def q_filter_route_recent(spark, d):
    return flat(A.filter_route_recent(audit(spark, d), *R, EVENTS_AS_OF, 30))


CID = "req-0000000000000042"


@register("filter_correlation_id", f"SELECT {AUDIT_SQL} FROM audit WHERE correlation_id = '{CID}'")
def q_filter_correlation_id(spark, d):
    return flat(A.filter_correlation_id(audit(spark, d), CID))


@register("lookup_event_id", f"SELECT {AUDIT_SQL} FROM audit WHERE event_id = '5' LIMIT 1")
def q_lookup_event_id(spark, d):
    return flat(A.lookup_event_id(audit(spark, d), "5"))


@register("project_history", f"SELECT {HIST_SQL} FROM audit WHERE {R_SQL}")
def q_project_history(spark, d):
    return A.project_history(A.filter_route_path(audit(spark, d), *R))


@register("project_event", f"SELECT {EVENT_SQL} FROM audit")
def q_project_event(spark, d):
    return flat_route(A.project_event(audit(spark, d)))


@register("project_who_changed", f"SELECT changed_by, action, occurred_at, url FROM audit WHERE {R_SQL}")
def q_project_who_changed(spark, d):
    return A.project_who_changed(A.filter_route_path(audit(spark, d), *R))


@register("project_when_changed", f"SELECT action, occurred_at, processed_at FROM audit WHERE {R_SQL}")
def q_project_when_changed(spark, d):
    return A.project_when_changed(A.filter_route_path(audit(spark, d), *R))


@register("route_history", f"""SELECT {HIST_SQL} FROM audit WHERE {R_SQL}
 ORDER BY audit.occurred_at DESC, event_id DESC LIMIT 100""")
def q_route_history(spark, d):
    return A.route_history(audit(spark, d), *R, limit=100)


@register("recent_events", f"""SELECT {EVENT_SQL} FROM audit
 WHERE audit.occurred_at >= {ASOF} - INTERVAL 30 DAY AND tenant = 'team-2'
 ORDER BY audit.occurred_at DESC, event_id DESC LIMIT 100""")
def q_recent_events(spark, d):
    return flat_route(A.recent_events(audit(spark, d), EVENTS_AS_OF, days=30, tenant="team-2", limit=100))


@register("events_by_action", f"""SELECT {EVENT_SQL} FROM audit
 WHERE action = 'deactivated' AND audit.occurred_at >= {ASOF} - INTERVAL 72 HOUR
 ORDER BY audit.occurred_at DESC, event_id DESC LIMIT 100""")
def q_events_by_action(spark, d):
    return flat_route(A.events_by_action(audit(spark, d), "deactivated", EVENTS_AS_OF, hours=72, limit=100))


@register("events_in_time_range", f"""SELECT {EVENT_SQL} FROM audit
 WHERE audit.occurred_at BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}' AND env = 'prod' AND action = 'created'
 ORDER BY audit.occurred_at DESC, event_id DESC LIMIT 100""")
def q_events_in_time_range(spark, d):
    return flat_route(A.events_in_time_range(audit(spark, d), *RANGE, env="prod", action="created", limit=100))


@register("latest_audit_events", """SELECT coalesce(nullif(action, ''), 'unknown') AS action,
       coalesce(nullif(tenant, ''), 'unknown') AS tenant, coalesce(nullif(service, ''), 'unknown') AS service,
       coalesce(nullif(env, ''), 'unknown') AS env, coalesce(nullif(version, ''), 'unknown') AS version,
       coalesce(strftime(occurred_at, '%H:%M:%S'), 'unknown') AS clock
  FROM audit ORDER BY occurred_at DESC, event_id DESC LIMIT 5""")
def q_latest_audit_events(spark, d):
    return A.latest_audit_events(audit(spark, d), 5)


@register("history_page", f"""WITH h AS (SELECT * FROM audit WHERE {R_SQL}),
n AS (SELECT count(*) AS n FROM h)
SELECT {HIST_SQL}, (SELECT n FROM n) > 10 AS has_more FROM h
 ORDER BY h.occurred_at DESC, event_id DESC LIMIT 10""")
def q_history_page(spark, d):
    return A.history_page(audit(spark, d), *R, limit=10)


@register("history_top_n_per_route", f"""SELECT {ROUTE_SQL}, rank, event_id, action, url, occurred_at FROM (
  SELECT *, row_number() OVER (PARTITION BY {ROUTE_SQL} ORDER BY occurred_at DESC, event_id DESC) AS rank
    FROM audit) t WHERE rank <= 3""")
def q_history_top_n_per_route(spark, d):
    return A.history_top_n_per_route(audit(spark, d), 3)


@register("count_by_action", "SELECT action, count(*) AS count FROM audit GROUP BY action ORDER BY count DESC, action")
def q_count_by_action(spark, d):
    return A.count_by_action(audit(spark, d))


@register("count_by_service", """SELECT tenant, service, count(*) AS count FROM audit GROUP BY tenant, service
 ORDER BY count DESC, tenant, service""")
def q_count_by_service(spark, d):
    return A.count_by_service(audit(spark, d))


@register("changes_per_day", """SELECT strftime(occurred_at, '%Y-%m-%d') AS day, count(*) AS count FROM audit
 GROUP BY 1 ORDER BY 1 DESC""")
def q_changes_per_day(spark, d):
    return A.changes_per_day(audit(spark, d))


@register("audit_previous_value", f"""SELECT event_id, event_type, action, {ROUTE_SQL}, url, changed_by, occurred_at,
       processed_at, correlation_id,
       coalesce(previous_url, lag(url) OVER w) AS previous_url,
       coalesce(previous_state, lag(CASE WHEN action = 'deactivated' THEN 'inactive' ELSE 'active' END) OVER w)
         AS previous_state
  FROM audit WINDOW w AS (PARTITION BY {ROUTE_SQL} ORDER BY occurred_at, event_id)""")
def q_audit_previous_value(spark, d):
    return flat(A.audit_previous_value(audit(spark, d)))


STATE_SQL = f"""SELECT {ROUTE_SQL}, action AS last_action, url, action <> 'deactivated' AS is_active,
       occurred_at AS changed_at, n_changes FROM (
  SELECT *, row_number() OVER (PARTITION BY {ROUTE_SQL} ORDER BY occurred_at DESC, event_id DESC) AS rn,
         count(*) OVER (PARTITION BY {ROUTE_SQL}) AS n_changes
    FROM audit {{where}}) t WHERE rn = 1"""
AT = "2024-01-15 12:00:00"


@register("route_state_latest", STATE_SQL.format(where=""))
def q_route_state_latest(spark, d):
    return A.route_state_latest(audit(spark, d))


@register("route_state_as_of", STATE_SQL.format(where=f"WHERE occurred_at <= TIMESTAMP '{AT}'"))
def q_route_state_as_of(spark, d):
    return A.route_state_as_of(audit(spark, d), AT)


RETENTION_AS_OF = "2025-01-15 00:00:00"


@register("audit_retention", f"""SELECT {AUDIT_SQL} FROM audit
 WHERE occurred_at >= TIMESTAMP '{RETENTION_AS_OF}' - INTERVAL 365 DAY""")
def q_audit_retention(spark, d):
    """The stored audit, its next snapshot without expired rows, read back."""
    from ..sources import lake
    stored = lake.write_audit(spark, audit(spark, d))
    return flat(lake.read_audit(spark, lake.retain_audit(spark, stored, RETENTION_AS_OF, 365)))


@register("scan_audit", f"SELECT {AUDIT_SQL} FROM audit")
def q_scan_audit(spark, d):
    """The audit table written date-partitioned to the lake and read back with its schema."""
    from ..sources import lake
    t = Tables(spark, d)
    path = lake.write_audit(spark, t.audit)
    return flat(lake.read_audit(spark, path))


@register("count_events", "SELECT count(*) AS count FROM audit")
def q_count_events(spark, d):
    return audit(spark, d).agg(F.count(F.lit(1)).alias("count"))
