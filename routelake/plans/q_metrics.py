"""2.5 request / cache / metric aggregations and 2.2 filters on requests and the cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import metrics as M
from ..sources.tables import CATALOG_AS_OF, Tables
from .q_catalog import CACHE_ASIDE_SQL
from .registry import register

ROUTE_SQL = "tenant, service, env, version"


def quantile_sql(groups: list[str], table: str = "request_log", value: str = "elapsed_ms",
                 median: bool = False) -> str:
    """Exclusive p95/p99 (statistics.quantiles) with the max fallback, per group."""
    gk = groups or ["_g"]
    sel = ", ".join(groups) + ", " if groups else ""
    gsel = ", ".join(f"p.{c}" for c in gk)
    part = ", ".join(gk)
    src = f"(SELECT *, 1 AS _g FROM {table})" if not groups else table

    def q(i, n, jname):
        d = f"({i} * (p.n + 1) - {jname} * {n})"
        return (f"CASE WHEN p.n > {n} THEN (max(CASE WHEN v.rk = {jname} THEN v.x END) * ({n} - {d}) + "
                f"max(CASE WHEN v.rk = {jname} + 1 THEN v.x END) * {d}) / {n} ELSE max(v.x) END")
    med = ", median(v.x) AS median_ms" if median else ""
    return f"""SELECT {gsel}, {q(19, 20, 'p.j95')} AS p95_ms, {q(99, 100, 'p.j99')} AS p99_ms{med}
  FROM (SELECT {sel}{"_g, " if not groups else ""}{value} AS x,
               row_number() OVER (PARTITION BY {part} ORDER BY {value}) AS rk
          FROM {src} s WHERE {value} IS NOT NULL) v
  JOIN (SELECT {part}, n, greatest(1, least(n - 1, (19 * (n + 1)) // 20)) AS j95,
               greatest(1, least(n - 1, (99 * (n + 1)) // 100)) AS j99
          FROM (SELECT {part}, count(*) AS n FROM {src} s2 WHERE {value} IS NOT NULL GROUP BY {part}) c) p
    USING ({part})
 GROUP BY {gsel}, p.n, p.j95, p.j99"""


def log(spark, d):
    return Tables(spark, d).request_log


@register("latency_quantile_exclusive", f"SELECT p95_ms, p99_ms FROM ({quantile_sql([])}) q")
def q_latency_quantile_exclusive(spark, d):
    return M.latency_quantile_exclusive(log(spark, d))


@register("latency_quantile_by_endpoint", f"SELECT endpoint, p95_ms, p99_ms FROM ({quantile_sql(['endpoint'])}) q")
def q_latency_quantile_by_endpoint(spark, d):
    return M.latency_quantile_exclusive(log(spark, d), ["endpoint"])


@register("request_summary", f"""WITH b AS (
  SELECT endpoint, count(*) AS requests, avg(elapsed_ms) AS avg_ms, min(elapsed_ms) AS min_ms,
         max(elapsed_ms) AS max_ms,
         (max(epoch_us(ts) + CAST(round(elapsed_ms * 1000) AS BIGINT)) - min(epoch_us(ts))) / 1e6 AS wall_seconds
    FROM request_log GROUP BY endpoint),
q AS ({quantile_sql(['endpoint'], median=True)})
SELECT b.*, q.median_ms, q.p95_ms, q.p99_ms,
       CASE WHEN wall_seconds > 0 THEN requests / wall_seconds ELSE 0.0 END AS requests_per_second
  FROM b JOIN q USING (endpoint)""")
def q_request_summary(spark, d):
    return M.request_summary(log(spark, d), ["endpoint"])


@register("status_distribution", """SELECT status_code, count(*) AS count,
       CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 100 AS pct FROM request_log GROUP BY status_code""")
def q_status_distribution(spark, d):
    return M.status_distribution(log(spark, d))


READ_OUTCOME_SQL = """CASE WHEN error IS NOT NULL AND error <> '' THEN 'error' WHEN status_code = 200 THEN 'successful'
            WHEN status_code = 404 THEN 'not_found' ELSE 'failed' END"""


@register("outcome_summary_read", f"""SELECT count(*) AS completed, count(*) FILTER (WHERE o = 'successful') AS successful,
       count(*) FILTER (WHERE o = 'not_found') AS not_found, count(*) FILTER (WHERE o IN ('failed', 'error')) AS failed,
       count(*) FILTER (WHERE o = 'error') AS errors
  FROM (SELECT {READ_OUTCOME_SQL} AS o FROM request_log WHERE operation = 'resolve') t""")
def q_outcome_summary_read(spark, d):
    return M.outcome_summary_read(log(spark, d).filter(F.col("operation") == "resolve"))


WRITE_SUMMARY_SQL = """SELECT operation, count(*) AS completed, count(*) FILTER (WHERE ok) AS successful,
       count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE err) AS errors
  FROM (SELECT operation, error IS NOT NULL AND error <> '' AS err,
               NOT (error IS NOT NULL AND error <> '') AND status_code IN (200, 201) AS ok
          FROM request_log WHERE operation <> 'resolve') t GROUP BY operation"""


@register("outcome_summary_write", WRITE_SUMMARY_SQL)
def q_outcome_summary_write(spark, d):
    return M.outcome_summary_write(log(spark, d).filter(F.col("operation") != "resolve"))


@register("failure_gate", f"""SELECT *, CASE WHEN completed > 0 THEN failed / completed * 100 ELSE 100.0 END AS failure_rate_pct,
       (CASE WHEN completed > 0 THEN failed / completed * 100 ELSE 100.0 END) <= 10.0 AS passed
  FROM ({WRITE_SUMMARY_SQL}) s""")
def q_failure_gate(spark, d):
    return M.failure_gate(M.outcome_summary_write(log(spark, d).filter(F.col("operation") != "resolve")))


@register("requests_by_label", """SELECT method, endpoint, status_code, count(*) AS requests FROM request_log
 GROUP BY method, endpoint, status_code""")
def q_requests_by_label(spark, d):
    return M.requests_by_label(log(spark, d))


BOUNDS = M.DEFAULT_BUCKETS


def hist_sql(groups: str) -> str:
    arms = " UNION ALL ".join(
        f"SELECT {groups}, CAST({b} AS DOUBLE) AS le, count(*) FILTER (WHERE elapsed_ms / 1000.0 <= {b}) AS bucket_count, "
        f"sum(elapsed_ms / 1000.0) AS sum, count(*) AS count FROM request_log GROUP BY {groups}" for b in BOUNDS)
    inf = (f"SELECT {groups}, CAST('inf' AS DOUBLE) AS le, count(*) AS bucket_count, sum(elapsed_ms / 1000.0) AS sum, "
           f"count(*) AS count FROM request_log GROUP BY {groups}")
    return f"{arms} UNION ALL {inf}"


@register("latency_histogram", hist_sql("method, endpoint"))
def q_latency_histogram(spark, d):
    return M.latency_histogram(log(spark, d))


@register("resolve_counters", """SELECT count(*) AS requests, count(*) FILTER (WHERE outcome = 'hit') AS cache_hits,
       count(*) FILTER (WHERE outcome = 'miss') AS cache_misses,
       count(*) FILTER (WHERE outcome = 'negative_hit') AS negative_hits,
       count(*) FILTER (WHERE db_queried) AS db_queries FROM ({CACHE_ASIDE}) r""".replace("{CACHE_ASIDE}", CACHE_ASIDE_SQL))
def q_resolve_counters(spark, d):
    t = Tables(spark, d)
    return M.resolve_counters(C.resolve_cache_aside(t.route_requests, t.cache_snapshot, t.route_table, CATALOG_AS_OF))


@register("cache_hit_ratio", """SELECT *, CASE WHEN requests > 0 THEN cache_hits / requests * 100 END AS cache_hit_ratio_pct
  FROM (SELECT count(*) AS requests, count(*) FILTER (WHERE outcome = 'hit') AS cache_hits,
       count(*) FILTER (WHERE outcome = 'miss') AS cache_misses,
       count(*) FILTER (WHERE outcome = 'negative_hit') AS negative_hits,
       count(*) FILTER (WHERE db_queried) AS db_queries FROM ({CACHE_ASIDE}) r) c""".replace("{CACHE_ASIDE}", CACHE_ASIDE_SQL))
def q_cache_hit_ratio(spark, d):
    t = Tables(spark, d)
    return M.cache_hit_ratio(M.resolve_counters(
        C.resolve_cache_aside(t.route_requests, t.cache_snapshot, t.route_table, CATALOG_AS_OF)))


@register("events_published_by_action", """SELECT action, count(*) FILTER (WHERE status_code IN (200, 201)) AS published,
       count(*) FILTER (WHERE status_code NOT IN (200, 201)) AS failed
  FROM (SELECT *, CASE operation WHEN 'create' THEN 'created' WHEN 'activate' THEN 'activated'
                  WHEN 'deactivate' THEN 'deactivated' END AS action FROM request_log) t
 WHERE action IS NOT NULL GROUP BY action""")
def q_events_published_by_action(spark, d):
    return M.events_published_by_action(log(spark, d))


@register("correlation_id_counts", """SELECT count(*) FILTER (WHERE cid_from_client) AS client_supplied,
       count(*) FILTER (WHERE NOT cid_from_client) AS generated FROM request_log""")
def q_correlation_id_counts(spark, d):
    return M.correlation_id_counts(log(spark, d))


@register("gauge_latest", """SELECT instance, metric, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY instance, metric ORDER BY ts DESC, value DESC) AS rn FROM gauge_samples) t
 WHERE rn = 1""")
def q_gauge_latest(spark, d):
    return M.gauge_latest(Tables(spark, d).gauge_samples)


@register("pool_utilisation_pct", """WITH l AS (SELECT instance, metric, value FROM (
  SELECT *, row_number() OVER (PARTITION BY instance, metric ORDER BY ts DESC, value DESC) AS rn FROM gauge_samples) t
 WHERE rn = 1)
SELECT instance, max(value) FILTER (WHERE metric = 'db_pool_in_use') AS in_use,
       max(value) FILTER (WHERE metric = 'db_pool_size') AS size,
       max(value) FILTER (WHERE metric = 'db_pool_in_use') / max(value) FILTER (WHERE metric = 'db_pool_size') * 100
         AS utilisation_pct
  FROM l GROUP BY instance""")
def q_pool_utilisation_pct(spark, d):
    return M.pool_utilisation_pct(Tables(spark, d).gauge_samples)


@register("hot_routes", f"""SELECT {ROUTE_SQL}, count(*) AS access_count FROM request_log GROUP BY {ROUTE_SQL}
 HAVING count(*) > 100 ORDER BY access_count DESC, {ROUTE_SQL} LIMIT 100""")
def q_hot_routes(spark, d):
    return M.hot_routes(log(spark, d), threshold=100, n=100)


CROSS_SQL = """SELECT metric, endpoint, sum(v) AS metric_sum, avg(v) AS metric_avg, max(v) AS metric_max,
       count(*) AS instances, make_timestamp(CAST(step AS BIGINT) * 3600 * 1000000) AS ts
  FROM (SELECT step, instance, metric, endpoint, value AS v FROM (
          SELECT *, floor(epoch_us(ts) / 3600000000) AS step,
                 row_number() OVER (PARTITION BY floor(epoch_us(ts) / 3600000000), instance, metric, endpoint
                                    ORDER BY ts DESC, value DESC) AS rn
            FROM counter_samples) t WHERE rn = 1) l
 GROUP BY step, metric, endpoint"""


@register("metric_cross_instance", CROSS_SQL)
def q_metric_cross_instance(spark, d):
    return M.cross_instance(Tables(spark, d).counter_samples)


for _agg in ("sum", "avg", "max"):
    def _mk(a):
        def fn(spark, d):
            return M.cross_instance(Tables(spark, d).counter_samples).select("ts", "metric", "endpoint", f"metric_{a}")
        return fn
    register(f"metric_{_agg}", f"SELECT ts, metric, endpoint, metric_{_agg} FROM ({CROSS_SQL}) c")(_mk(_agg))


@register("distinct_routes", f"SELECT DISTINCT {ROUTE_SQL} FROM event_rows")
def q_distinct_routes(spark, d):
    return Tables(spark, d).event_rows.select("tenant", "service", "env", "version").dropDuplicates()


@register("table_counts", """SELECT 'tenants' AS table_name, count(*) AS row_count FROM tenants
UNION ALL SELECT 'services', count(*) FROM services
UNION ALL SELECT 'environments', count(*) FROM environments
UNION ALL SELECT 'endpoints', count(*) FROM endpoints""")
def q_table_counts(spark, d):
    t = Tables(spark, d)
    parts = [(n, getattr(t, n)) for n in ("tenants", "services", "environments", "endpoints")]
    out = None
    for n, df in parts:
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out


@register("count_endpoints", "SELECT count(*) AS count FROM endpoints")
def q_count_endpoints(spark, d):
    return Tables(spark, d).endpoints.agg(F.count(F.lit(1)).alias("count"))


@register("cache_key_counts", """SELECT count(*) AS keys_total, count(*) FILTER (WHERE route_key LIKE 'route:%') AS route_keys,
       count(*) FILTER (WHERE NOT is_negative) AS positive, count(*) FILTER (WHERE is_negative) AS negative
  FROM cache_snapshot""")
def q_cache_key_counts(spark, d):
    return M.cache_key_counts(Tables(spark, d).cache_snapshot)


@register("sample_first_n", """SELECT route_key, greatest((SELECT count(*) FROM cache_snapshot) - 10, 0) AS n_more
  FROM cache_snapshot ORDER BY route_key LIMIT 10""")
def q_sample_first_n(spark, d):
    return M.sample_first_n(Tables(spark, d).cache_snapshot, 10)


@register("filter_status_class", "SELECT * FROM request_log WHERE regexp_full_match(CAST(status_code AS VARCHAR), '5..')")
def q_filter_status_class(spark, d):
    return log(spark, d).filter(F.col("status_code").cast("string").rlike("^5..$"))


@register("filter_slow_requests", "SELECT * FROM request_log WHERE elapsed_ms / 1000.0 > 1.0")
def q_filter_slow_requests(spark, d):
    return log(spark, d).filter(F.col("elapsed_ms") / 1000.0 > M.SLOW_REQUEST_SECONDS)


@register("filter_cache_negative", "SELECT * FROM cache_snapshot WHERE is_negative")
def q_filter_cache_negative(spark, d):
    return Tables(spark, d).cache_snapshot.filter("is_negative")


@register("filter_key_prefix", "SELECT * FROM cache_snapshot WHERE starts_with(route_key, 'route:')")
def q_filter_key_prefix(spark, d):
    return Tables(spark, d).cache_snapshot.filter(F.col("route_key").startswith("route:"))
