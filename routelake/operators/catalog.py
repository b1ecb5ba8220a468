"""Catalog reads (2.3): the four-table route join and everything resolved against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X

ROUTE = list(X.ROUTE_COLS)


def route_table(tenants: DataFrame, services: DataFrame, environments: DataFrame,
                endpoints: DataFrame) -> DataFrame:
    """One denormalised row per endpoint: three plain equi joins, without hints. AQE broadcasts a
    side from its measured bytes."""
    env = environments.select(F.col("id").alias("environment_id"), "service_id", F.col("name").alias("env"))
    svc = services.select(F.col("id").alias("service_id"), "tenant_id", F.col("name").alias("service"))
    ten = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant"))
    ep = endpoints.select(F.col("id").alias("endpoint_id"), "environment_id", "version", "url",
                          "is_active", "created_at", "updated_at")
    j = ep.join(env, "environment_id")
    j = j.join(svc, "service_id")
    j = j.join(ten, "tenant_id")
    return j.select("tenant_id", "tenant", "service_id", "service", "environment_id", "env",
                    "endpoint_id", "version", "url", "is_active", "created_at", "updated_at")


def _route_eq(t, s, e, v) -> Column:
    return ((F.col("tenant") == t) & (F.col("service") == s) & (F.col("env") == e)
            & (F.col("version") == v))


def resolve_route(routes: DataFrame, tenant, service, env, version) -> DataFrame:
    """URL of one active route, at most one row."""
    return (routes.filter(_route_eq(tenant, service, env, version) & F.col("is_active"))
            .select("url").limit(1))


def lookup_route_any_state(routes: DataFrame, tenant, service, env, version) -> DataFrame:
    return (routes.filter(_route_eq(tenant, service, env, version))
            .select("url", "is_active").limit(1))


def lookup_environment_id(tenants, services, environments, tenant, service, env) -> DataFrame:
    t = tenants.filter(F.col("name") == tenant).select(F.col("id").alias("tenant_id"))
    s = services.filter(F.col("name") == service).select(F.col("id").alias("service_id"), "tenant_id")
    e = environments.filter(F.col("name") == env).select(F.col("id").alias("environment_id"), "service_id")
    return e.join(s, "service_id").join(t, "tenant_id").select("environment_id").limit(1)


def active_routes(routes: DataFrame) -> DataFrame:
    return routes.filter(F.col("is_active")).select(*ROUTE, "url")


def list_active_routes(routes: DataFrame) -> DataFrame:
    return active_routes(routes).orderBy(*ROUTE)


def recent_routes(routes: DataFrame, n: int = 5) -> DataFrame:
    """The n most recently updated routes (ties broken by the route names)."""
    return (routes.select(*ROUTE, "url", "is_active", "updated_at")
            .orderBy(F.col("updated_at").desc(), *ROUTE).limit(n))


def resolve_routes_batch(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Every request -> url + 200, or 404 when no active route, 400 when a name is missing.
    Left join on the four names; AQE splits a hot route on the request side."""
    act = active_routes(routes)
    j = requests.join(act, ROUTE, "left")
    ok = X.all_present(*ROUTE)
    status = F.when(~ok, 400).when(F.col("url").isNull(), 404).otherwise(200)
    return j.select("request_id", *ROUTE, F.when(ok, F.col("url")).alias("url"),
                    status.alias("status_code"))


def unresolved_requests(requests: DataFrame, routes: DataFrame) -> DataFrame:
    return requests.join(active_routes(routes).select(*ROUTE), ROUTE, "left_anti")


def requests_with_route(requests: DataFrame, routes: DataFrame) -> DataFrame:
    return requests.join(active_routes(routes).select(*ROUTE), ROUTE, "left_semi")


def _valid_cache(cache: DataFrame, as_of) -> DataFrame:
    """Entries alive at ``as_of`` (Redis drops a key once its TTL reaches 0)."""
    return (cache.filter(F.col("expires_at") > as_of)
            .select("route_key", F.col("url").alias("cached_url"), "is_negative"))


def resolve_cache_aside(requests: DataFrame, cache: DataFrame, routes: DataFrame, as_of) -> DataFrame:
    """Cache-aside resolve for a batch: hit / negative_hit from the snapshot; a miss falls
    through to the catalog and yields the entry that would be written (60 s / 10 s TTL).

    Both joins are on ``route_key``: the request side comes out of the cache join already
    hash-partitioned on it, so the catalog join shuffles only the catalog side, and its
    extra condition lets only misses match."""
    as_of = X.lit_ts(as_of) if isinstance(as_of, str) else as_of
    r = requests.withColumn("route_key", X.route_cache_key())
    c = r.join(_valid_cache(cache, as_of), "route_key", "left")
    positive = (~F.col("is_negative")) & X.present("cached_url")   # '' counts as a miss (Q19)
    outcome = (F.when(F.coalesce(F.col("is_negative"), F.lit(False)), F.lit("negative_hit"))
               .when(positive, F.lit("hit")).otherwise(F.lit("miss")))
    c = c.withColumn("outcome", outcome)
    act = active_routes(routes).select(X.route_cache_key().alias("_rk"), F.col("url").alias("_db_url"))
    m = c.join(act, (c["route_key"] == act["_rk"]) & (c["outcome"] == "miss"), "left")
    miss, found = F.col("outcome") == "miss", F.col("_db_url").isNotNull()
    url = F.when(F.col("outcome") == "hit", F.col("cached_url")).when(miss, F.col("_db_url"))
    out = m.select(
        "request_id", *ROUTE, "route_key", "outcome", url.alias("url"),
        F.when(~miss, F.lit("cache")).when(found, F.lit("database")).otherwise(F.lit("none")).alias("source"),
        miss.alias("db_queried"),
        F.when(miss, F.when(found, F.lit("positive")).otherwise(F.lit("negative"))).alias("cache_write"),
        F.when(miss, F.when(found, X.ts_plus_seconds(as_of, X.POSITIVE_TTL_SECONDS))
               .otherwise(X.ts_plus_seconds(as_of, X.NEGATIVE_TTL_SECONDS))).alias("cache_expires_at"))
    return out.withColumn("status_code", F.when(F.col("url").isNull(), 404).otherwise(200))


def resolve_stale_fallback(requests: DataFrame, cache: DataFrame, as_of) -> DataFrame:
    """Catalog down: answer from unexpired positive entries only, else 503."""
    as_of = X.lit_ts(as_of) if isinstance(as_of, str) else as_of
    r = requests.withColumn("route_key", X.route_cache_key())
    v = _valid_cache(cache, as_of).filter(~F.col("is_negative") & X.present("cached_url"))
    j = r.join(v, "route_key", "left")
    hit = F.col("cached_url").isNotNull()
    return j.select("request_id", *ROUTE, F.col("cached_url").alias("url"),
                    F.when(hit, F.lit("cache_fallback")).alias("source"),
                    F.when(hit, 200).otherwise(503).alias("status_code"))


def warm_join(changed: DataFrame, routes: DataFrame, as_of) -> DataFrame:
    """Changed route keys re-resolved against the catalog -> cache rows to write."""
    as_of = X.lit_ts(as_of) if isinstance(as_of, str) else as_of
    keys = changed.select(*ROUTE).filter(X.all_present(*ROUTE)).dropDuplicates(ROUTE)
    # the catalog is cut to the changed keys first; where these are few, AQE broadcasts them and the catalog is not shuffled
    found = active_routes(routes).join(keys, ROUTE, "left_semi")
    j = keys.join(found, ROUTE, "left")
    found = F.col("url").isNotNull()
    return j.select(
        X.route_cache_key().alias("route_key"), "url", (~found).alias("is_negative"),
        F.when(found, X.ts_plus_seconds(as_of, X.POSITIVE_TTL_SECONDS))
        .otherwise(X.ts_plus_seconds(as_of, X.NEGATIVE_TTL_SECONDS)).alias("expires_at"))


def invalidate_cache(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """Cache minus the keys of changed routes (``DEL key``)."""
    keys = changed.select(X.route_cache_key().alias("route_key")).filter(F.col("route_key").isNotNull())
    return cache.join(keys, "route_key", "left_anti")


def label_active_mark(routes: DataFrame) -> DataFrame:
    return routes.select(*ROUTE, "url",
                         F.when(F.col("is_active"), F.lit("✓")).otherwise(F.lit("✗")).alias("active"))
