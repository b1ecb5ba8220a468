"""DuckDB twins of the fixture views (same mapping as ``sources.tables``).

``with_fixtures(sql)`` prepends the CTEs a twin query refers to, in dependency order.
"""

from __future__ import annotations

import re

ROUTE_OF_USER = """'team-' || CAST(user_id % 5 AS VARCHAR) AS tenant,
       'svc-' || CAST(user_id % 12 AS VARCHAR) AS service,
       CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS env,
       'v' || CAST(user_id % 20 + 1 AS VARCHAR) AS version"""


def open_range(seconds: int) -> str:
    """DuckDB frame for the left-open range (t - seconds, t]."""
    return f"RANGE BETWEEN INTERVAL '{seconds * 1_000_000 - 1} microseconds' PRECEDING AND CURRENT ROW"


def closed_range(seconds: int) -> str:
    """DuckDB frame for the closed range [t - seconds, t]."""
    return f"RANGE BETWEEN INTERVAL '{seconds * 1_000_000} microseconds' PRECEDING AND CURRENT ROW"


def plus_seconds(ts: str, secs: str) -> str:
    return f"make_timestamp(epoch_us({ts}) + CAST(round(CAST({secs} AS DOUBLE) * 1000000) AS BIGINT))"


FIXTURES: dict[str, str] = {
    "tenants": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region",
    "services": "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS tenant_id, "
                "n_name AS name FROM nation",
    "environments": "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS service_id, c_name AS name FROM customer",
    "endpoint_writes": """SELECT o_orderkey AS id, o_custkey AS environment_id,
       'v' || CAST(o_orderkey % 20 + 1 AS VARCHAR) AS version,
       'https://env-' || CAST(o_custkey AS VARCHAR) || '.example.com/' || CAST(o_orderkey AS VARCHAR) AS url,
       o_orderstatus <> 'F' AS is_active, o_orderdate AS created_at, o_orderdate AS updated_at
  FROM orders""",
    "endpoints": """SELECT f.id, f.environment_id, f.version, l.url, l.is_active, f.created_at, l.updated_at
  FROM (SELECT * FROM endpoint_writes
         QUALIFY row_number() OVER (PARTITION BY environment_id, version ORDER BY updated_at, id) = 1) f
  JOIN (SELECT * FROM endpoint_writes
         QUALIFY row_number() OVER (PARTITION BY environment_id, version ORDER BY updated_at DESC, id DESC) = 1) l
    ON f.environment_id = l.environment_id AND f.version = l.version""",
    "route_table": """SELECT t.id AS tenant_id, t.name AS tenant, s.id AS service_id, s.name AS service,
       en.id AS environment_id, en.name AS env, ep.id AS endpoint_id, ep.version, ep.url, ep.is_active,
       ep.created_at, ep.updated_at
  FROM endpoints ep JOIN environments en ON ep.environment_id = en.id
  JOIN services s ON en.service_id = s.id JOIN tenants t ON s.tenant_id = t.id""",
    "route_requests": """SELECT o.o_orderkey AS request_id, o.o_orderdate AS ts, t.name AS tenant, s.name AS service,
       en.name AS env,
       'v' || CAST((o.o_orderkey + CASE WHEN o.o_orderkey % 3 = 0 THEN 7 ELSE 0 END) % 20 + 1 AS VARCHAR) AS version
  FROM orders o JOIN environments en ON o.o_custkey = en.id
  JOIN services s ON en.service_id = s.id JOIN tenants t ON s.tenant_id = t.id""",
    "event_rows": f"""SELECT *, 'https://' || tenant || '.example.com/' || service || '/' || env || '/' || version
       || '/' || event_id AS url
  FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS event_seq, event_type AS source_type,
         CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'activated'
              WHEN 'error' THEN 'deactivated' WHEN 'view' THEN 'viewed' END AS action,
         {ROUTE_OF_USER},
         ts AS occurred_at, 'user-' || CAST(user_id AS VARCHAR) AS changed_by,
         'req-' || lpad(CAST(event_id AS VARCHAR), 16, '0') AS correlation_id, props, user_id, value
    FROM events) er0""",
    "audit": """SELECT event_id, 'route_changed' AS event_type, action, tenant, service, env, version, url,
       CAST(NULL AS VARCHAR) AS previous_url, CAST(NULL AS VARCHAR) AS previous_state, changed_by,
       occurred_at, occurred_at + INTERVAL 1 SECOND AS processed_at, correlation_id,
       CAST(occurred_at AS DATE) AS event_date
  FROM event_rows WHERE action IN ('created', 'activated', 'deactivated')""",
    "request_log": f"""SELECT event_id AS request_id, ts, 'GET' AS method, event_type AS endpoint,
       CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'activate'
            WHEN 'error' THEN 'deactivate' ELSE 'resolve' END AS operation,
       value * 10 AS elapsed_ms,
       CASE WHEN k = 1 THEN 0 WHEN event_type = 'error' THEN 500 WHEN k % 10 = 0 THEN 404 ELSE 200 END AS status_code,
       CASE WHEN k = 1 THEN 'transport error' END AS error,
       'req-' || lpad(CAST(event_id AS VARCHAR), 16, '0') AS correlation_id,
       k % 2 = 0 AS cid_from_client,
       {ROUTE_OF_USER}
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) rl0""",
    "cache_snapshot": f"""SELECT 'route:' || tenant || ':' || service || ':' || env || ':' || version AS route_key,
       CASE WHEN is_active THEN url END AS url, NOT is_active AS is_negative,
       {plus_seconds("TIMESTAMP '2001-09-01 00:00:00'", "endpoint_id % 120 - 60")} AS expires_at
  FROM route_table""",
    "counter_samples": """SELECT ts, 'i-' || CAST(user_id % 3 AS VARCHAR) AS instance, 'http_requests_total' AS metric,
       event_type AS endpoint,
       CAST(row_number() OVER (PARTITION BY user_id % 3, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS DOUBLE)
         AS value
  FROM events""",
    "gauge_samples": """SELECT ts, 'i-' || CAST(user_id % 3 AS VARCHAR) AS instance, 'db_pool_in_use' AS metric,
       CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 11 AS DOUBLE) AS value FROM events
UNION ALL
SELECT ts, 'i-' || CAST(user_id % 3 AS VARCHAR) AS instance, 'db_pool_size' AS metric, 10.0 AS value FROM events""",
    "call_log": """SELECT 'i-' || CAST(user_id % 2 AS VARCHAR) AS instance,
       CASE user_id % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'redis' ELSE 'mongodb' END AS dependency,
       ts, event_id AS call_id, event_type = 'error' AS is_failure FROM events""",
    "retry_log": """SELECT 'i-' || CAST(user_id % 2 AS VARCHAR) AS instance,
       CASE user_id % 3 WHEN 0 THEN 'database' ELSE 'redis' END AS budget, ts, event_id AS retry_id FROM events""",
    "operation_spans": f"""SELECT 'i-' || CAST(user_id % 2 AS VARCHAR) AS instance,
       CASE user_id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'audit' END AS class,
       event_id AS span_id, ts AS start_ts, {plus_seconds("ts", "value")} AS end_ts FROM events""",
    "change_log": """SELECT event_seq AS seq,
       CASE action WHEN 'created' THEN 'create' WHEN 'activated' THEN 'activate' ELSE 'deactivate' END AS op,
       tenant, service, env, version, CASE WHEN action = 'created' THEN url END AS url
  FROM event_rows WHERE action IN ('created', 'activated', 'deactivated')
UNION ALL
SELECT r.request_id + 1000000000 AS seq,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'deactivate' WHEN '3-MEDIUM' THEN 'activate'
            WHEN '4-NOT SPECIFIED' THEN 'purge' ELSE 'create' END AS op,
       r.tenant, r.service, r.env, r.version,
       CASE WHEN o.o_orderpriority = '2-HIGH' OR (o.o_orderpriority = '5-LOW' AND r.request_id % 2 = 0)
            THEN 'https://new.example.com/' || CAST(r.request_id AS VARCHAR)
            WHEN o.o_orderpriority = '5-LOW' THEN '  ' END AS url
  FROM route_requests r JOIN orders o ON r.request_id = o.o_orderkey""",
    "outages": """SELECT event_id AS outage_id, ts AS start_ts, ts + INTERVAL 1 HOUR AS end_ts
  FROM events WHERE event_type = 'error' AND value > 250""",
}


def _deps(sql: str) -> list[str]:
    return [n for n in FIXTURES if re.search(rf"\b{n}\b", sql)]


def with_fixtures(sql: str) -> str:
    order: list[str] = []

    def visit(name: str, stack: tuple = ()):
        if name in order or name in stack:
            return
        for d in _deps(FIXTURES[name]):
            if d != name:
                visit(d, stack + (name,))
        order.append(name)

    for n in _deps(sql):
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{FIXTURES[n]}\n)" for n in order)
    body = sql.lstrip()
    m = re.match(r"(?is)with\s+recursive\s+", body)
    if m:
        return f"WITH RECURSIVE {ctes},\n{body[m.end():]}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
