"""Request, cache and metric aggregations (2.5). All are partial (map-side) aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from . import quantiles as Q

# Default histogram bounds (seconds) of the reference's metrics.
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
P95 = ("exclusive", "p95_ms", 19, 20, 20)     # quantiles(n=20)[18] when > 20 samples
P99 = ("exclusive", "p99_ms", 99, 100, 100)   # quantiles(n=100)[98] when > 100 samples
FAILURE_GATE_PCT = 10.0
SLOW_REQUEST_SECONDS = 1.0


def _n(c: Column | None = None) -> Column:
    return F.count(F.lit(1)) if c is None else F.sum(F.when(c, 1).otherwise(0)).cast("long")


def request_summary(log: DataFrame, groups=()) -> DataFrame:
    """count, mean, median, min, max, p95, p99 (exclusive, Q16), wall time and req/s."""
    g = list(groups)
    end_us = F.unix_micros("ts") + F.round(F.col("elapsed_ms") * 1000).cast("long")
    basic = log.groupBy(*g).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg("elapsed_ms").alias("avg_ms"), F.min("elapsed_ms").alias("min_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        ((F.max(end_us) - F.min(F.unix_micros("ts"))) / 1e6).alias("wall_seconds"))
    q = Q.quantile_report(log, g, "elapsed_ms", [("median", "median_ms"), P95, P99])
    out = _attach(basic, q, g)
    return out.withColumn("requests_per_second",
                          F.when(F.col("wall_seconds") > 0, F.col("requests") / F.col("wall_seconds")).otherwise(0.0))


def _attach(a: DataFrame, b: DataFrame, g) -> DataFrame:
    """Join two per-group aggregates. With no groups ``b`` is one row: it comes in as one
    scalar subquery (a struct), not as a join."""
    if g:
        return a.join(b, g)
    packed = b.select(F.struct(*b.columns).alias("_b")).scalar()
    return a.select("*", packed.alias("_b")).select(*a.columns, *[F.col(f"_b.{c}").alias(c) for c in b.columns])


def latency_quantile_exclusive(log: DataFrame, groups=()) -> DataFrame:
    return Q.quantile_report(log, list(groups), "elapsed_ms", [P95, P99])


def status_distribution(log: DataFrame, groups=()) -> DataFrame:
    g = list(groups)
    c = log.groupBy(*g, "status_code").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(1))
    # the window runs over the aggregate (#groups x #status codes rows), not over requests
    return c.withColumn("pct", F.col("count") / F.sum("count").over(w) * 100)


def read_outcome(status: Column, error: Column) -> Column:
    """Read path (Q17): transport error -> error (also failed); 200 ok; 404 not_found; else failed."""
    return (F.when(error.isNotNull() & (error != ""), F.lit("error"))
            .when(status == 200, F.lit("successful")).when(status == 404, F.lit("not_found"))
            .otherwise(F.lit("failed")))


def outcome_summary_read(log: DataFrame, groups=()) -> DataFrame:
    o = read_outcome(F.col("status_code"), F.col("error"))
    return log.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("completed"), _n(o == "successful").alias("successful"),
        _n(o == "not_found").alias("not_found"), _n(o.isin("failed", "error")).alias("failed"),
        _n(o == "error").alias("errors"))


def outcome_summary_write(log: DataFrame, groups=("operation",)) -> DataFrame:
    """Write path: every non-200/201 is failed; transport errors also count as errors."""
    err = F.col("error").isNotNull() & (F.col("error") != "")
    ok = (~err) & F.col("status_code").isin(200, 201)
    return log.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("completed"), _n(ok).alias("successful"), _n(~ok).alias("failed"),
        _n(err).alias("errors"))


def failure_gate(summary: DataFrame, limit_pct: float = FAILURE_GATE_PCT) -> DataFrame:
    """failed/completed*100 > limit -> flagged; no data counts as 100 %."""
    rate = F.when(F.col("completed") > 0, F.col("failed") / F.col("completed") * 100).otherwise(100.0)
    return summary.withColumn("failure_rate_pct", rate).withColumn("passed", F.col("failure_rate_pct") <= limit_pct)


def requests_by_label(log: DataFrame) -> DataFrame:
    return log.groupBy("method", "endpoint", "status_code").agg(F.count(F.lit(1)).alias("requests"))


def latency_histogram(log: DataFrame, groups=("method", "endpoint"), bounds=DEFAULT_BUCKETS,
                      value: Column | None = None) -> DataFrame:
    """Cumulative ``le`` buckets (+Inf included), sum and count, in one conditional aggregate."""
    v = value if value is not None else F.col("elapsed_ms") / 1000.0
    d = log.withColumn("_v", v)
    aggs = [_n(F.col("_v") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    a = d.groupBy(*groups).agg(*aggs, F.count(F.lit(1)).alias("count"), F.sum("_v").alias("sum"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("bucket_count")))
    return a.select(*groups, "sum", "count", F.explode(F.array(*rows)).alias("b")).select(
        *groups, "b.le", "b.bucket_count", "sum", "count")


def resolve_counters(resolved: DataFrame) -> DataFrame:
    """Counters over ``resolve_cache_aside`` output."""
    o = F.col("outcome")
    return resolved.agg(F.count(F.lit(1)).alias("requests"), _n(o == "hit").alias("cache_hits"),
                        _n(o == "miss").alias("cache_misses"), _n(o == "negative_hit").alias("negative_hits"),
                        _n(F.col("db_queried")).alias("db_queries"))


def cache_hit_ratio(counters: DataFrame) -> DataFrame:
    return counters.select("*", F.when(F.col("requests") > 0, F.col("cache_hits") / F.col("requests") * 100)
                           .alias("cache_hit_ratio_pct"))


ACTION_OF_OPERATION = {"create": "created", "activate": "activated", "deactivate": "deactivated"}


def events_published_by_action(log: DataFrame) -> DataFrame:
    """Write requests -> events published (write ok) / failed, per action."""
    act = F.coalesce(*[F.when(F.col("operation") == k, F.lit(v)) for k, v in ACTION_OF_OPERATION.items()])
    ok = F.col("status_code").isin(200, 201)
    return (log.withColumn("action", act).filter(F.col("action").isNotNull()).groupBy("action")
            .agg(_n(ok).alias("published"), _n(~ok).alias("failed")))


def correlation_id_counts(log: DataFrame) -> DataFrame:
    """Ids supplied by the client vs generated; with no source flag, an id of the generated
    shape counts as generated."""
    gen = (~F.col("cid_from_client")) if "cid_from_client" in log.columns else \
        F.col("correlation_id").rlike(X.CORRELATION_PATTERN)
    return log.agg(_n(~gen).alias("client_supplied"), _n(gen).alias("generated"))


def gauge_latest(samples: DataFrame, series=("instance", "metric")) -> DataFrame:
    g = samples.groupBy(*series).agg(F.max(F.struct("ts", "value")).alias("l"))
    return g.select(*series, F.col("l.ts").alias("ts"), F.col("l.value").alias("value"))


def pool_utilisation_pct(gauges: DataFrame, in_use: str = "db_pool_in_use", size: str = "db_pool_size") -> DataFrame:
    latest = gauge_latest(gauges.filter(F.col("metric").isin(in_use, size)))
    p = latest.groupBy("instance").agg(F.max(F.when(F.col("metric") == in_use, F.col("value"))).alias("in_use"),
                                       F.max(F.when(F.col("metric") == size, F.col("value"))).alias("size"))
    return p.withColumn("utilisation_pct", F.col("in_use") / F.col("size") * 100)


def hot_routes(log: DataFrame, threshold: int = 1000, n: int = 100) -> DataFrame:
    c = log.groupBy(*X.ROUTE_COLS).agg(F.count(F.lit(1)).alias("access_count"))
    return c.filter(F.col("access_count") > threshold).orderBy(F.col("access_count").desc(), *X.ROUTE_COLS).limit(n)


def cross_instance(samples: DataFrame, step_seconds: int = 3600, labels=("metric", "endpoint")) -> DataFrame:
    """sum / avg / max across instances at each evaluation step: the last sample of every
    (instance, series) inside the step, then aggregated over instances."""
    step = F.floor(F.unix_micros("ts") / F.lit(step_seconds * 1_000_000)).cast("long")
    last = (samples.withColumn("step", step).groupBy("step", "instance", *labels)
            .agg(F.max(F.struct("ts", "value")).alias("l")))
    return (last.groupBy("step", *labels)
            .agg(F.sum("l.value").alias("metric_sum"), F.avg("l.value").alias("metric_avg"),
                 F.max("l.value").alias("metric_max"), F.count(F.lit(1)).alias("instances"))
            .withColumn("ts", F.timestamp_micros(F.col("step") * step_seconds * 1_000_000)).drop("step"))


def cache_key_counts(cache: DataFrame) -> DataFrame:
    k = F.col("route_key")
    return cache.agg(F.count(F.lit(1)).alias("keys_total"), _n(k.startswith("route:")).alias("route_keys"),
                     _n(~F.col("is_negative")).alias("positive"), _n(F.col("is_negative")).alias("negative"))


def sample_first_n(cache: DataFrame, n: int = 10) -> DataFrame:
    """First n keys (in key order) and how many more there are."""
    total = cache.select(F.count(F.lit(1))).scalar()
    first = cache.select("route_key").orderBy("route_key").limit(n)
    return first.select("route_key", F.greatest(total - n, F.lit(0)).alias("n_more"))
