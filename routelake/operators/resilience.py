"""Resilience analytics over logs (2.6): failure windows, retry budget, concurrency. Keys are (instance, dependency|budget|class); limits are fixed small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan

# The reference's limits.
#   breaker: name, failure_threshold, timeout_seconds, window_seconds, min_calls
BREAKERS = [("database", 5, 60, 60, 10), ("redis", 10, 30, 60, 20), ("mongodb", 5, 60, 60, 10)]
#   retry budget: name, max_retries, window_seconds
BUDGETS = [("database", 100, 60), ("redis", 200, 60)]
#   bulkhead: class, max_concurrent
BULKHEADS = [("read", 20), ("write", 5), ("audit", 10)]


def breaker_limits(spark: SparkSession, rows=BREAKERS) -> DataFrame:
    return spark.createDataFrame(rows, "dependency string, failure_threshold long, timeout_seconds long, "
                                       "window_seconds long, min_calls long")


def budget_limits(spark: SparkSession, rows=BUDGETS) -> DataFrame:
    return spark.createDataFrame(rows, "budget string, max_retries long, window_seconds long")


def bulkhead_limits(spark: SparkSession, rows=BULKHEADS) -> DataFrame:
    return spark.createDataFrame(rows, "class string, max_concurrent long")


def failure_window(calls: DataFrame, limits: DataFrame, window_seconds: int = 60,
                   failure_predicate=None) -> DataFrame:
    """At every call: failures in ``(t - 60 s, t]`` (strict, Q14), lifetime calls, the
    reference's failure rate (window failures / lifetime calls, Q15), a windowed-denominator
    rate, and whether a closed breaker would trip (>= threshold and >= min_calls)."""
    k = ["instance", "dependency"]
    if failure_predicate is not None:  # Q13: what counts as a failure (default: any error)
        calls = calls.withColumn("is_failure", failure_predicate)
    d = calls.withColumn("_tb", F.col("call_id"))
    fail = F.when(F.col("is_failure"), 1).otherwise(0)
    d = scan.trailing_sums(d, k, "ts", "_tb", window_seconds, {"failures_in_window": fail, "calls_in_window": F.lit(1)},
                           include_lower=False, lifetime={"lifetime_calls": F.lit(1)})
    d = d.join(limits.select("dependency", "failure_threshold", "min_calls"), "dependency", "left")
    return d.select(
        "instance", "dependency", "call_id", "ts", "is_failure",
        F.col("failures_in_window").cast("long").alias("failures_in_window"),
        F.col("calls_in_window").cast("long").alias("calls_in_window"),
        F.col("lifetime_calls").cast("long").alias("lifetime_calls"),
        (F.col("failures_in_window") / F.col("lifetime_calls") * 100).alias("failure_rate"),
        (F.col("failures_in_window") / F.col("calls_in_window") * 100).alias("window_failure_rate"),
        ((F.col("failures_in_window") >= F.col("failure_threshold"))
         & (F.col("lifetime_calls") >= F.col("min_calls"))).alias("would_trip"))


def retry_budget_usage(retries: DataFrame, limits: DataFrame, window_seconds: int = 60) -> DataFrame:
    """At every retry: retries in ``[t - 60 s, t]`` (closed, Q14) including this one, whether
    it was within budget, % used, remaining, exhausted."""
    k = ["instance", "budget"]
    d = retries.withColumn("_tb", F.col("retry_id"))
    d = scan.trailing_count(d, k, "ts", "_tb", window_seconds, F.lit(1), "retries_in_window", include_lower=True)
    d = d.join(limits.select("budget", "max_retries"), "budget", "left")
    n, m = F.col("retries_in_window").cast("long"), F.col("max_retries")
    return d.select("instance", "budget", "retry_id", "ts", n.alias("retries_in_window"),
                    (n - 1 < m).alias("allowed"), (n / m * 100).alias("budget_used_pct"),
                    F.greatest(m - n, F.lit(0)).alias("remaining"), (n >= m).alias("exhausted"))


def concurrency_profile(spans: DataFrame, limits: DataFrame) -> DataFrame:
    """In-flight operations over time per (instance, class): +1 at start, -1 at end, ends
    before starts at the same instant (touching spans never overlap), running sum."""
    k = ["instance", "class"]
    ev = (spans.select(*k, "span_id", F.col("start_ts").alias("ts"), F.lit(1).alias("delta"))
          .unionByName(spans.select(*k, "span_id", F.col("end_ts").alias("ts"), F.lit(-1).alias("delta"))))
    # tie-break: at equal ts the -1 rows first, then by span id
    ev = ev.withColumn("_tb", F.col("delta") * F.lit(1 << 40) + F.col("span_id"))
    d = scan.running_sum(ev, k, "ts", "_tb", F.col("delta"), "in_flight")
    d = d.join(limits, "class", "left")
    f, m = F.col("in_flight").cast("long"), F.col("max_concurrent")
    return d.select(*k, "span_id", "ts", "delta", f.alias("in_flight"), m.alias("limit"),
                    (f / m * 100).alias("utilisation_pct"), (m - f).alias("slots_left"), (f > m).alias("over_limit"))


def concurrency_peaks(profile: DataFrame) -> DataFrame:
    return profile.groupBy("instance", "class").agg(
        F.max("in_flight").alias("peak_in_flight"), F.first("limit").alias("limit"),
        F.sum(F.when(F.col("over_limit"), 1).otherwise(0)).cast("long").alias("over_limit_events"))


def resilience_report(calls: DataFrame, retries: DataFrame, spans: DataFrame, budgets: DataFrame, bulkheads: DataFrame, as_of,
                      window_seconds: int = 60, failure_predicate=None) -> DataFrame:
    """One row per (instance, component): its reading at the newest of its rows up to ``as_of``.

    The readings equal the newest rows of ``failure_window``, ``retry_budget_usage`` and
    ``concurrency_profile`` but need no window: one aggregate finds the newest time of each key, a
    second one sums up what counts at that time. Both read rows up to ``as_of`` only."""
    at = F.lit(as_of).cast("timestamp")
    width = int(window_seconds) * 1_000_000

    def newest(df, ts="ts"):
        """Rows up to ``as_of`` with their key's newest time ``_t``; as many keys as there are components."""
        df = df.filter(F.col(ts) <= at)
        return df, df.groupBy("instance", "name").agg(F.max(ts).alias("_t"))

    def with_newest(df, last):
        last = last.withColumnsRenamed({"instance": "_i", "name": "_n"})
        return df.join(last, F.col("instance").eqNullSafe(F.col("_i")) & F.col("name").eqNullSafe(F.col("_n"))).drop("_i", "_n")

    def row(df, kind, reading, rate):
        return df.select("instance", F.lit(kind).alias("kind"), "name", F.col("_t").alias("ts"),
                         reading.cast("double").alias("reading"), rate.cast("double").alias("rate_pct"))
    age = F.unix_micros("_t") - F.unix_micros("ts")
    key = ["instance", "name", "_t"]

    failed = F.col("is_failure") if failure_predicate is None else failure_predicate
    c, last = newest(calls.withColumnRenamed("dependency", "name"))
    c = with_newest(c, last).groupBy(*key).agg(
        F.sum(F.when(failed & (age < width), 1).otherwise(0)).alias("f"), F.count(F.lit(1)).alias("n"))
    breaker = row(c, "circuit_breaker", F.col("f"), F.col("f") / F.col("n") * 100)

    r, last = newest(retries.withColumnRenamed("budget", "name"))
    r = (with_newest(r, last).filter(age <= width).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
         .join(budgets.select(F.col("budget").alias("name"), "max_retries"), "name", "left"))
    budget = row(r, "retry_budget", F.col("n"), F.col("n") / F.col("max_retries") * 100)

    moves = (spans.select("instance", F.col("class").alias("name"), F.col("start_ts").alias("ts"), F.lit(1).alias("delta"))
             .unionByName(spans.select("instance", F.col("class").alias("name"), F.col("end_ts").alias("ts"), F.lit(-1).alias("delta"))))
    m, last = newest(moves)
    now = age == 0
    m = with_newest(m, last).groupBy(*key).agg(
        F.sum(F.when(now, 0).otherwise(F.col("delta"))).alias("base"), F.sum(F.when(now & (F.col("delta") < 0), 1).otherwise(0)).alias("ends"),
        F.sum(F.when(now & (F.col("delta") > 0), 1).otherwise(0)).alias("starts"))
    # at one instant ends come before starts: the largest count is after the first end or after the last start
    most = F.greatest(F.when(F.col("ends") > 0, F.col("base") - 1), F.when(F.col("starts") > 0, F.col("base") - F.col("ends") + F.col("starts")))
    m = m.withColumn("n", most).join(bulkheads.select(F.col("class").alias("name"), "max_concurrent"), "name", "left")
    bulkhead = row(m, "bulkhead", F.col("n"), F.col("n") / F.col("max_concurrent") * 100)
    return breaker.unionByName(budget).unionByName(bulkhead)
