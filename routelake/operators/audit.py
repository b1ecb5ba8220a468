"""Audit reads: filters and projections (2.2), newest-first reports (2.7), audit
aggregations (2.5) and state over time (2.6).

``audit`` rows: event_id, event_type, action, route STRUCT<tenant,service,env,version>, url,
previous_url, previous_state, changed_by, occurred_at, processed_at, metadata,
correlation_id, event_date. Sorting is newest first with ``event_id`` as tie-break (Q7).
Every time bound also bounds ``event_date`` so date-partitioned tables are pruned at the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from . import scan



def newest():
    """Newest first, event_id as the tie-break (Q7)."""
    return [F.col("occurred_at").desc(), F.col("event_id").desc()]
MAX_LIMIT = 1000


def _ts(x) -> Column:
    return F.lit(x).cast("timestamp") if isinstance(x, str) else x


def since(df: DataFrame, cut: Column) -> DataFrame:
    cond = F.col("occurred_at") >= cut
    if "event_date" in df.columns:
        cond = cond & (F.col("event_date") >= F.to_date(cut))
    return df.filter(cond)


def between(df: DataFrame, start, end) -> DataFrame:
    """Closed range on occurred_at (plus the matching event_date range)."""
    s, e = _ts(start), _ts(end)
    cond = (F.col("occurred_at") >= s) & (F.col("occurred_at") <= e)
    if "event_date" in df.columns:
        cond = cond & (F.col("event_date") >= F.to_date(s)) & (F.col("event_date") <= F.to_date(e))
    return df.filter(cond)


def route_eq(tenant, service, env, version) -> Column:
    return ((F.col("route.tenant") == tenant) & (F.col("route.service") == service)
            & (F.col("route.env") == env) & (F.col("route.version") == version))


def filter_route_path(audit: DataFrame, tenant, service, env, version) -> DataFrame:
    return audit.filter(route_eq(tenant, service, env, version))


def optional_conditions(tenant=None, service=None, env=None, action=None) -> Column:
    """Conjunction of the filters that are given; falsy ('' / None) means no filter (Q2)."""
    conds = []
    for name, v in (("route.tenant", tenant), ("route.service", service), ("route.env", env), ("action", action)):
        if v:
            conds.append(F.col(name) == v)
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def filter_optional(audit: DataFrame, tenant=None, service=None, env=None, action=None) -> DataFrame:
    return audit.filter(optional_conditions(tenant, service, env, action))


def filter_recent(audit: DataFrame, as_of, days: int | None = None, hours: int | None = None) -> DataFrame:
    """``occurred_at >= as_of - N days/hours``; 0 or None means no time filter (Q2, Q3), other
    values than 1 to 365 days or 1 hour and more are refused."""
    if (days and not 1 <= int(days) <= 365) or (hours and int(hours) < 1):
        raise ValueError("days must be 1 to 365, hours 1 or more")
    if days:
        return since(audit, _ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    if hours:
        return since(audit, _ts(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return audit


def filter_time_range(audit: DataFrame, start, end) -> DataFrame:
    if type(start) is type(end) and not isinstance(start, Column) and start >= end:
        raise ValueError("start must be before end")
    return between(audit, start, end)


def filter_action_in(audit: DataFrame, actions, as_of, days: int) -> DataFrame:
    return filter_recent(audit.filter(F.col("action").isin(*actions)), as_of, days=days)


def filter_partial_route_recent(audit: DataFrame, tenant, service, env, as_of, days: int) -> DataFrame:
    return filter_recent(filter_optional(audit, tenant, service, env), as_of, days=days)


def filter_route_recent(audit: DataFrame, tenant, service, env, version, as_of, days: int = 30) -> DataFrame:
    return filter_recent(filter_route_path(audit, tenant, service, env, version), as_of, days=days)


def filter_correlation_id(df: DataFrame, cid: str) -> DataFrame:
    return df.filter(F.col("correlation_id") == cid)


def lookup_event_id(audit: DataFrame, event_id: str) -> DataFrame:
    return audit.filter(F.col("event_id") == event_id).limit(1)


# ------------------------------------------------------------------ projections
def project_history(df: DataFrame) -> DataFrame:
    """History entry of one route: no route object, ISO timestamps (Q6)."""
    return df.select("event_id", "action", "url", "previous_url", "previous_state", "changed_by",
                     X.format_iso_timestamp("occurred_at").alias("occurred_at"),
                     X.format_iso_timestamp("processed_at").alias("processed_at"))


def project_event(df: DataFrame) -> DataFrame:
    return df.select("event_id", "event_type", "action", "route", "url", "previous_url", "previous_state",
                     "changed_by", X.format_iso_timestamp("occurred_at").alias("occurred_at"),
                     X.format_iso_timestamp("processed_at").alias("processed_at"))


def project_who_changed(df: DataFrame) -> DataFrame:
    return df.select("changed_by", "action", "occurred_at", "url")


def project_when_changed(df: DataFrame) -> DataFrame:
    return df.select("action", "occurred_at", "processed_at")


def shape_audit_doc(events: DataFrame, processed_at) -> DataFrame:
    """Flat change event -> audit row with the store's defaults: event_type
    'route_changed', metadata {}, missing optional fields null, route as a struct."""
    et, md = X.default_fields("event_type", "metadata")

    def opt(c):
        return F.col(c) if c in events.columns else F.lit(None).cast("string")

    meta = md if "metadata" in events.columns else F.create_map().cast("map<string,string>")
    return events.select(
        "event_id", (et if "event_type" in events.columns else F.lit(X.DEFAULT_EVENT_TYPE)).alias("event_type"),
        "action", F.struct(*[F.col(c) for c in X.ROUTE_COLS]).alias("route"), "url",
        opt("previous_url").alias("previous_url"), opt("previous_state").alias("previous_state"),
        opt("changed_by").alias("changed_by"), F.col("occurred_at"), _ts(processed_at).alias("processed_at"),
        meta.alias("metadata"), opt("correlation_id").alias("correlation_id"),
        (F.col("occurred_at_defaulted") if "occurred_at_defaulted" in events.columns else F.lit(False))
        .alias("occurred_at_defaulted"),
        F.to_date("occurred_at").alias("event_date"))


EVENT_JSON_COLS = ["event_id", "event_type", "action", "tenant", "service", "env", "version", "url",
                   "occurred_at", "correlation_id"]


def shape_route_event(rows: DataFrame) -> DataFrame:
    """Applied writes (flat route columns) -> the published payload: key ``t:s:e:v`` (one
    route, one partition) and the JSON value with an ISO-Z timestamp; nulls are kept."""
    ev = rows.select("event_id", F.lit(X.DEFAULT_EVENT_TYPE).alias("event_type"), "action", "tenant", "service",
                     "env", "version", "url", X.format_iso_timestamp("occurred_at", zulu=True).alias("occurred_at"),
                     "correlation_id")
    return ev.select(X.route_partition_key().alias("key"), X.event_to_json(*EVENT_JSON_COLS).alias("value"))


# ------------------------------------------------------------------ newest-first reports
def _limit(n: int) -> int:
    if not 1 <= n <= MAX_LIMIT:
        raise ValueError(f"limit must be within 1..{MAX_LIMIT}")
    return n


def route_history(audit: DataFrame, tenant, service, env, version, limit: int = 100) -> DataFrame:
    return project_history(filter_route_path(audit, tenant, service, env, version)
                           .orderBy(*newest()).limit(_limit(limit)))


def recent_events(audit: DataFrame, as_of, days: int = 30, tenant=None, service=None, env=None,
                  limit: int = 100) -> DataFrame:
    d = filter_optional(filter_recent(audit, as_of, days=days), tenant, service, env)
    return project_event(d.orderBy(*newest()).limit(_limit(limit)))


def events_by_action(audit: DataFrame, action: str, as_of, hours: int | None = None, tenant=None,
                     service=None, env=None, limit: int = 100) -> DataFrame:
    d = filter_optional(filter_recent(audit.filter(F.col("action") == action), as_of, hours=hours),
                        tenant, service, env)
    return project_event(d.orderBy(*newest()).limit(_limit(limit)))


def events_in_time_range(audit: DataFrame, start, end, tenant=None, service=None, env=None, action=None,
                         limit: int = 100) -> DataFrame:
    d = filter_optional(between(audit, start, end), tenant, service, env, action)
    return project_event(d.orderBy(*newest()).limit(_limit(limit)))


def latest_audit_events(audit: DataFrame, n: int = 5) -> DataFrame:
    """Last n events with 'unknown' defaults and an HH:MM:SS clock."""
    d = audit.orderBy(*newest()).limit(n)
    return d.select(X.display_or_unknown("action").alias("action"),
                    X.display_or_unknown("route.tenant").alias("tenant"),
                    X.display_or_unknown("route.service").alias("service"),
                    X.display_or_unknown("route.env").alias("env"),
                    X.display_or_unknown("route.version").alias("version"),
                    F.coalesce(X.format_clock("occurred_at"), F.lit(X.UNKNOWN)).alias("clock"))


def history_page(audit: DataFrame, tenant, service, env, version, limit: int = 100) -> DataFrame:
    """``limit`` newest rows plus ``has_more``: take limit+1 (at most 1001 rows, so the
    un-partitioned window below is bounded), flag, drop the extra row."""
    from pyspark.sql import Window
    d = filter_route_path(audit, tenant, service, env, version).orderBy(*newest()).limit(_limit(limit) + 1)
    d = (d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
         .withColumn("_pos", F.row_number().over(Window.orderBy(*newest()))))
    h = project_history(d)
    return (d.filter(F.col("_pos") <= limit)
            .select(*[F.col(c) for c in ("event_id", "action", "url", "previous_url", "previous_state", "changed_by")],
                    X.format_iso_timestamp("occurred_at").alias("occurred_at"),
                    X.format_iso_timestamp("processed_at").alias("processed_at"),
                    (F.col("_n") > limit).alias("has_more"))
            .select(*h.columns, "has_more"))


def history_top_n_per_route(audit: DataFrame, n: int = 10) -> DataFrame:
    """Newest n changes of every route at once (``scan.top_n_per_group``: every input partition forwards n rows of a
    route at most; above the session's group-limit threshold by a salted first pass)."""
    flat = audit.select("*", *[F.col(f"route.{c}").alias(c) for c in X.ROUTE_COLS])
    top = scan.top_n_per_group(flat, list(X.ROUTE_COLS), newest(), n, salt_col="event_id")
    return top.select(*X.ROUTE_COLS, "rank", "event_id", "action", "url", "occurred_at")


def count_by_action(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "action")


def count_by_service(audit: DataFrame) -> DataFrame:
    return (audit.groupBy(F.col("route.tenant").alias("tenant"), F.col("route.service").alias("service"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "tenant", "service"))


def changes_per_day(audit: DataFrame) -> DataFrame:
    return (audit.groupBy(X.format_day("occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("day").desc()))


# ------------------------------------------------------------------ state over time
def audit_previous_value(audit: DataFrame, chunk_seconds: int = scan.DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """Fill previous_url / previous_state from the route's previous change when the
    publisher left them empty (Q8). Chunked lag: a hot route is spread over its quarters of an hour
    (``chunk_seconds``)."""
    flat = audit.select("*", *[F.col(f"route.{c}").alias(f"_{c}") for c in X.ROUTE_COLS])
    keys = [f"_{c}" for c in X.ROUTE_COLS]
    state = F.when(F.col("action") == "deactivated", F.lit("inactive")).otherwise(F.lit("active"))
    flat = flat.withColumn("_state", state)
    lagged = scan.lag_within(flat, keys, "occurred_at", "event_id", ["url", "_state"], prefix="_p",
                             chunk_seconds=chunk_seconds)
    return lagged.select(
        *[c for c in audit.columns if c not in ("previous_url", "previous_state")],
        F.coalesce("previous_url", "_purl").alias("previous_url"),
        F.coalesce("previous_state", "_p_state").alias("previous_state"))


def route_state_latest(audit: DataFrame) -> DataFrame:
    """Current state of every route from its newest event (partial max over a struct)."""
    g = audit.groupBy(*[F.col(f"route.{c}").alias(c) for c in X.ROUTE_COLS]).agg(
        F.max(F.struct("occurred_at", "event_id", "action", "url")).alias("l"),
        F.count(F.lit(1)).alias("n_changes"))
    return g.select(*X.ROUTE_COLS, F.col("l.action").alias("last_action"), F.col("l.url").alias("url"),
                    (F.col("l.action") != "deactivated").alias("is_active"),
                    F.col("l.occurred_at").alias("changed_at"), "n_changes")


def route_state_as_of(audit: DataFrame, at) -> DataFrame:
    cond = F.col("occurred_at") <= _ts(at)
    if "event_date" in audit.columns:
        cond = cond & (F.col("event_date") <= F.to_date(_ts(at)))
    return route_state_latest(audit.filter(cond))


def route_state_at(audit: DataFrame, probes: DataFrame, at: str = "at") -> DataFrame:
    """State of each probed route at its own time ``at`` (many T at once): an as-of join of
    the probes (route columns + ``at``) with the route's changes, newest at or before ``at``.
    Probes come from data (e.g. the routes changed during an outage), never a cross product."""
    keys = list(X.ROUTE_COLS)
    ch = audit.select(*[F.col(f"route.{c}").alias(c) for c in keys], F.col("occurred_at").alias("ts"),
                      F.struct("occurred_at", "event_id", "action", "url").alias("st"))
    # ties at one instant: the change with the highest event_id is the state (as in route_state_latest)
    ch = ch.groupBy(*keys, "ts").agg(F.max("st").alias("st"))
    p = probes.withColumn("ts", F.col(at))
    j = scan.asof_last(p, ch, keys, "ts", "st", "_st")
    return j.drop("ts").select("*", F.col("_st.action").alias("action_then"), F.col("_st.url").alias("url_then"),
                               (F.col("_st.action").isNotNull() & (F.col("_st.action") != "deactivated")).alias("active_then"),
                               F.col("_st.occurred_at").alias("changed_at")).drop("_st")
