"""2.3 joins and catalog reads, plus 2.8 set operations on the cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import catalog as C
from ..sources.tables import CATALOG_AS_OF, Tables
from .registry import register

ROUTE_SQL = "tenant, service, env, version"
KEY_SQL = "'route:' || tenant || ':' || service || ':' || env || ':' || version"
ASOF_SQL = f"TIMESTAMP '{CATALOG_AS_OF}'"

# A route of the sf0.01 catalog, used as the point-lookup parameter.
P_TENANT, P_SERVICE, P_ENV = "MIDDLE EAST", "NATION_19", "Customer#000000001"
P_VERSION_ACTIVE, P_VERSION_INACTIVE = "v13", "v17"


@register("route_table", f"""SELECT tenant_id, tenant, service_id, service, environment_id, env, endpoint_id, version,
       url, is_active, created_at, updated_at FROM route_table""")
def q_route_table(spark, d):
    return Tables(spark, d).route_table


@register("resolve_route", f"""SELECT url FROM route_table
 WHERE tenant = '{P_TENANT}' AND service = '{P_SERVICE}' AND env = '{P_ENV}' AND version = '{P_VERSION_ACTIVE}'
   AND is_active LIMIT 1""")
def q_resolve_route(spark, d):
    return C.resolve_route(Tables(spark, d).route_table, P_TENANT, P_SERVICE, P_ENV, P_VERSION_ACTIVE)


@register("lookup_route_any_state", f"""SELECT url, is_active FROM route_table
 WHERE tenant = '{P_TENANT}' AND service = '{P_SERVICE}' AND env = '{P_ENV}' AND version = '{P_VERSION_INACTIVE}'
 LIMIT 1""")
def q_lookup_route_any_state(spark, d):
    return C.lookup_route_any_state(Tables(spark, d).route_table, P_TENANT, P_SERVICE, P_ENV, P_VERSION_INACTIVE)


@register("lookup_environment_id", f"""SELECT e.id AS environment_id FROM environments e
  JOIN services s ON e.service_id = s.id JOIN tenants t ON s.tenant_id = t.id
 WHERE t.name = '{P_TENANT}' AND s.name = '{P_SERVICE}' AND e.name = '{P_ENV}' LIMIT 1""")
def q_lookup_environment_id(spark, d):
    t = Tables(spark, d)
    return C.lookup_environment_id(t.tenants, t.services, t.environments, P_TENANT, P_SERVICE, P_ENV)


@register("list_active_routes", f"SELECT {ROUTE_SQL}, url FROM route_table WHERE is_active ORDER BY {ROUTE_SQL}")
def q_list_active_routes(spark, d):
    return C.list_active_routes(Tables(spark, d).route_table)


@register("recent_routes", f"""SELECT {ROUTE_SQL}, url, is_active, updated_at FROM route_table
 ORDER BY updated_at DESC, {ROUTE_SQL} LIMIT 5""")
def q_recent_routes(spark, d):
    return C.recent_routes(Tables(spark, d).route_table, 5)


RESOLVE_SQL = f"""SELECT r.request_id, r.tenant, r.service, r.env, r.version, a.url,
       CASE WHEN a.url IS NULL THEN 404 ELSE 200 END AS status_code
  FROM route_requests r
  LEFT JOIN (SELECT {ROUTE_SQL}, url FROM route_table WHERE is_active) a
    ON r.tenant = a.tenant AND r.service = a.service AND r.env = a.env AND r.version = a.version"""


@register("resolve_routes_batch", RESOLVE_SQL)
def q_resolve_routes_batch(spark, d):
    t = Tables(spark, d)
    return C.resolve_routes_batch(t.route_requests, t.route_table)


@register("unresolved_requests", f"""SELECT request_id, ts, {ROUTE_SQL} FROM route_requests r
 WHERE NOT EXISTS (SELECT 1 FROM route_table a WHERE a.is_active AND a.tenant = r.tenant
                   AND a.service = r.service AND a.env = r.env AND a.version = r.version)""")
def q_unresolved_requests(spark, d):
    t = Tables(spark, d)
    return C.unresolved_requests(t.route_requests, t.route_table)


@register("requests_with_route", f"""SELECT request_id, ts, {ROUTE_SQL} FROM route_requests r
 WHERE EXISTS (SELECT 1 FROM route_table a WHERE a.is_active AND a.tenant = r.tenant
               AND a.service = r.service AND a.env = r.env AND a.version = r.version)""")
def q_requests_with_route(spark, d):
    t = Tables(spark, d)
    return C.requests_with_route(t.route_requests, t.route_table)


CACHE_ASIDE_SQL = f"""WITH c AS (
  SELECT route_key, url AS cached_url, is_negative FROM cache_snapshot WHERE expires_at > {ASOF_SQL}),
rq AS (SELECT request_id, {ROUTE_SQL}, {KEY_SQL} AS route_key FROM route_requests),
rc AS (
  SELECT rq.*, c.cached_url, c.is_negative,
         CASE WHEN c.is_negative THEN 'negative_hit'
              WHEN NOT c.is_negative AND c.cached_url IS NOT NULL AND c.cached_url <> '' THEN 'hit'
              ELSE 'miss' END AS outcome
    FROM rq LEFT JOIN c ON rq.route_key = c.route_key),
act AS (SELECT {ROUTE_SQL}, url FROM route_table WHERE is_active),
res AS (
  SELECT rc.request_id, rc.tenant, rc.service, rc.env, rc.version, rc.route_key, rc.outcome,
         CASE WHEN rc.outcome = 'hit' THEN rc.cached_url WHEN rc.outcome = 'miss' THEN a.url END AS url,
         CASE WHEN rc.outcome <> 'miss' THEN 'cache' WHEN a.url IS NOT NULL THEN 'database' ELSE 'none' END AS source,
         rc.outcome = 'miss' AS db_queried,
         CASE WHEN rc.outcome = 'miss' THEN CASE WHEN a.url IS NOT NULL THEN 'positive' ELSE 'negative' END END
           AS cache_write,
         CASE WHEN rc.outcome = 'miss' THEN CASE WHEN a.url IS NOT NULL THEN {ASOF_SQL} + INTERVAL 60 SECOND
              ELSE {ASOF_SQL} + INTERVAL 10 SECOND END END AS cache_expires_at
    FROM rc LEFT JOIN act a ON rc.outcome = 'miss' AND a.tenant = rc.tenant AND a.service = rc.service
                            AND a.env = rc.env AND a.version = rc.version)
SELECT *, CASE WHEN url IS NULL THEN 404 ELSE 200 END AS status_code FROM res"""


@register("resolve_cache_aside", CACHE_ASIDE_SQL)
def q_resolve_cache_aside(spark, d):
    t = Tables(spark, d)
    return C.resolve_cache_aside(t.route_requests, t.cache_snapshot, t.route_table, CATALOG_AS_OF)


@register("resolve_stale_fallback", f"""WITH c AS (
  SELECT route_key, url AS cached_url FROM cache_snapshot
   WHERE expires_at > {ASOF_SQL} AND NOT is_negative AND url IS NOT NULL AND url <> '')
SELECT r.request_id, r.tenant, r.service, r.env, r.version, c.cached_url AS url,
       CASE WHEN c.cached_url IS NOT NULL THEN 'cache_fallback' END AS source,
       CASE WHEN c.cached_url IS NOT NULL THEN 200 ELSE 503 END AS status_code
  FROM route_requests r LEFT JOIN c ON {KEY_SQL.replace("tenant", "r.tenant").replace("service", "r.service").replace("env", "r.env").replace("version", "r.version")} = c.route_key""")
def q_resolve_stale_fallback(spark, d):
    t = Tables(spark, d)
    return C.resolve_stale_fallback(t.route_requests, t.cache_snapshot, CATALOG_AS_OF)


def _changed_keys(t: Tables):
    """The routes that the change log names."""
    return t.change_log.select(*X.ROUTE_COLS).distinct()


@register("warm_join", f"""WITH k AS (SELECT DISTINCT {ROUTE_SQL} FROM change_log),
act AS (SELECT {ROUTE_SQL}, url FROM route_table WHERE is_active)
SELECT {KEY_SQL.replace("tenant", "k.tenant").replace("service", "k.service").replace("env", "k.env").replace("version", "k.version")} AS route_key,
       a.url, a.url IS NULL AS is_negative,
       CASE WHEN a.url IS NOT NULL THEN {ASOF_SQL} + INTERVAL 60 SECOND ELSE {ASOF_SQL} + INTERVAL 10 SECOND END AS expires_at
  FROM k LEFT JOIN act a ON k.tenant = a.tenant AND k.service = a.service AND k.env = a.env AND k.version = a.version""")
def q_warm_join(spark, d):
    t = Tables(spark, d)
    return C.warm_join(_changed_keys(t), t.route_table, CATALOG_AS_OF)


@register("invalidate_cache", f"""SELECT c.* FROM cache_snapshot c
 WHERE c.route_key NOT IN (SELECT {KEY_SQL} FROM change_log)""")
def q_invalidate_cache(spark, d):
    t = Tables(spark, d)
    return C.invalidate_cache(t.cache_snapshot, _changed_keys(t))


@register("label_active_mark", f"""SELECT {ROUTE_SQL}, url, CASE WHEN is_active THEN '✓' ELSE '✗' END AS active
  FROM route_table""")
def q_label_active_mark(spark, d):
    return C.label_active_mark(Tables(spark, d).route_table)


@register("filter_active_routes", "SELECT * FROM route_table WHERE is_active")
def q_filter_active_routes(spark, d):
    return Tables(spark, d).route_table.filter("is_active")


@register("filter_inactive_routes", "SELECT * FROM route_table WHERE NOT is_active")
def q_filter_inactive_routes(spark, d):
    return Tables(spark, d).route_table.filter(~F.col("is_active"))
