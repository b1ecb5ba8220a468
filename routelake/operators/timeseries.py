"""Counter, gauge and histogram time-series operators (2.6), PromQL semantics as columns.

Samples: ts, series columns (e.g. instance, metric, endpoint), value. Range selectors are
left-open ``(t - range, t]`` and evaluated at every sample; no edge extrapolation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

SERIES = ("instance", "metric", "endpoint")


def one_per_instant(samples: DataFrame, series=SERIES, id_col: str | None = None) -> DataFrame:
    """A series has one value per instant: of samples at the same time, that with the largest id
    (the largest value where samples have no id), whatever the input order."""
    order = ([F.col(id_col).alias("i")] if id_col else []) + [F.col("value").alias("v")]
    return (samples.groupBy("ts", *series).agg(F.max(F.struct(*order)).alias("_m"))
            .select("ts", *series, F.col("_m.v").alias("value")))


def counter_deltas(samples: DataFrame, series=SERIES) -> DataFrame:
    """Per instant: increase since the previous sample of the series; a drop is a reset, so
    the new value itself is the increase. Null on the first sample."""
    d = one_per_instant(samples, series).withColumn("_tb", F.lit(0))
    d = scan.lag_within(d, list(series), "ts", "_tb", ["value", "ts"], prefix="prev_")
    delta = (F.when(F.col("prev_value").isNull(), F.lit(None).cast("double"))
             .when(F.col("value") >= F.col("prev_value"), F.col("value") - F.col("prev_value"))
             .otherwise(F.col("value")))
    return d.withColumn("delta", delta).drop("_tb")


def counter_increase(samples: DataFrame, range_seconds: int = 3600, series=SERIES) -> DataFrame:
    """increase(m[range]) at each instant: the deltas between samples inside the range, that is
    all deltas in it but the first sample's."""
    d = counter_deltas(samples, series)
    zero = F.lit(0.0)

    def here(up):
        so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return {"_all": F.sum("delta").over(so_far), "_after": F.sum("_later").over(so_far)}

    def ahead(down):
        return {"after": F.sum("delta").over(down.rowsBetween(Window.unboundedPreceding, -1))}
    # the delta of a block's first sample reaches back before the block
    width = F.lit(int(range_seconds) * 1_000_000)
    same_block = F.floor(F.unix_micros("prev_ts") / width) == F.floor(F.unix_micros("ts") / width)
    d = scan.two_blocks(d.withColumn("_later", F.when(same_block, F.col("delta"))), list(series), "ts", range_seconds, here, ahead)
    inside = F.when(F.col("suffix").isNotNull(), F.coalesce("suffix.after", zero) + F.coalesce("_all", zero)).otherwise(F.coalesce("_after", zero))
    return d.select("ts", *series, "value", inside.alias("increase"))


def counter_rate(samples: DataFrame, range_seconds: int = 300, series=SERIES) -> DataFrame:
    inc = counter_increase(samples, range_seconds, series)
    return inc.withColumn("rate", F.col("increase") / float(range_seconds)).drop("increase")


def rate_sum_by(samples: DataFrame, by=("endpoint",), step_seconds: int = 300, series=SERIES) -> DataFrame:
    """sum(rate(m[step])) by (labels) on a grid of tumbling steps."""
    d = counter_deltas(samples, series)
    step = F.floor(F.unix_micros("ts") / F.lit(step_seconds * 1_000_000)).cast("long")
    prev_step = F.floor(F.unix_micros("prev_ts") / F.lit(step_seconds * 1_000_000)).cast("long")
    inside = F.col("prev_ts").isNotNull() & (prev_step == step)
    per = (d.withColumn("step", step).groupBy("step", *series)
           .agg(F.coalesce(F.sum(F.when(inside, F.col("delta"))), F.lit(0.0)).alias("inc")))
    out = per.groupBy("step", *by).agg((F.sum("inc") / float(step_seconds)).alias("rate"))
    return out.withColumn("ts", F.timestamp_micros(F.col("step") * step_seconds * 1_000_000)).drop("step")


def counter_compare(samples: DataFrame, offset_seconds: int = 3600, series=SERIES) -> DataFrame:
    """m - m offset 1h: every sample against the newest sample at or before t - offset."""
    samples = one_per_instant(samples, series)
    shifted = samples.select(*series, (F.col("ts") + F.expr(f"INTERVAL {int(offset_seconds)} SECONDS")).alias("ts"),
                             "value")
    j = scan.asof_last(samples.select("ts", *series, "value"), shifted, list(series), "ts", "value", "value_before")
    return j.withColumn("diff", F.col("value") - F.col("value_before"))


def avg_over_time(samples: DataFrame, range_seconds: int = 3600, series=SERIES) -> DataFrame:
    """Mean of the series' samples in (t - range, t]."""
    def sums(w):
        f = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return {"_sum": F.sum("value").over(f), "_n": F.count("value").over(f)}
    d = scan.two_blocks(one_per_instant(samples, series), list(series), "ts", range_seconds, sums, sums)
    total = F.coalesce("_sum", F.lit(0.0)) + F.coalesce("suffix._sum", F.lit(0.0))
    n = F.col("_n") + F.coalesce("suffix._n", F.lit(0))
    return d.withColumn("avg_over_time", F.when(n > 0, total / n)).drop("_sum", "_n", "suffix")


def gauge_delta(samples: DataFrame, range_seconds: int = 3600, series=("instance", "metric")) -> DataFrame:
    """delta(): newest minus oldest sample in (t - range, t]."""
    d = scan.two_blocks(one_per_instant(samples, series), list(series), "ts", range_seconds,
                        lambda up: {"_first": F.first("value").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))},
                        lambda down: {"value": F.col("value")})
    oldest = F.when(F.col("suffix").isNotNull(), F.col("suffix.value")).otherwise(F.col("_first"))
    return d.withColumn("delta", F.col("value") - oldest).drop("_first", "suffix")


def window_start(ts: str, step_seconds: int):
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / F.lit(step_seconds * 1_000_000)).cast("long")
                              * step_seconds * 1_000_000)


def histogram_quantile(buckets: DataFrame, q, groups) -> DataFrame:
    """Prometheus histogram_quantile over cumulative buckets (le, bucket_count) per group:
    first bucket whose count reaches q * total, linear inside it, lower bound 0 for the
    first bucket, the highest finite bound when the rank falls in +Inf, null with no data.
    ``q``: a number or a list of numbers, all answered in one pass over the buckets. The window
    runs over the bucket table (#groups x #bounds rows), never over samples."""
    g = list(groups)
    wanted = [float(x) for x in (q if isinstance(q, (list, tuple)) else [q])]
    w = Window.partitionBy(*g).orderBy("le")
    b = (buckets.withColumn("prev_le", F.lag("le").over(w)).withColumn("prev_cnt", F.lag("bucket_count").over(w))
         .withColumn("total", F.max("bucket_count").over(Window.partitionBy(*g))))
    hit = F.struct("le", "prev_le", "prev_cnt", "bucket_count", "total")
    first = b.groupBy(*g).agg(*[F.min(F.when(F.col("bucket_count") >= F.lit(x) * F.col("total"), hit)).alias(f"h{i}")
                                for i, x in enumerate(wanted)])

    def value(h: str, x: float):
        le, ple = F.col(f"{h}.le"), F.coalesce(F.col(f"{h}.prev_le"), F.lit(0.0))
        pc = F.coalesce(F.col(f"{h}.prev_cnt"), F.lit(0)).cast("double")
        cnt = F.col(f"{h}.bucket_count").cast("double")
        interp = ple + (le - ple) * (F.lit(x) * F.col(f"{h}.total") - pc) / (cnt - pc)
        return (F.when(F.col(f"{h}.total") == 0, F.lit(None).cast("double"))
                .when(F.isnan(le) | (le == float("inf")), F.col(f"{h}.prev_le"))
                .when(F.col(f"{h}.prev_le").isNull() & (le <= 0), le)
                .otherwise(interp)).alias(f"q{int(round(x * 100)):02d}")
    return (first.filter(F.coalesce(*[F.col(f"h{i}") for i in range(len(wanted))]).isNotNull())
            .select(*g, *[value(f"h{i}", x) for i, x in enumerate(wanted)]))


def histogram_avg(hist: DataFrame, groups) -> DataFrame:
    g = list(groups)
    return hist.groupBy(*g).agg((F.first("sum") / F.first("count")).alias("avg_seconds"))


def sli_report(log: DataFrame, step_seconds: int = 3600, latency_ms: float = 200.0) -> DataFrame:
    """Availability (% non-5xx), latency SLI (% <= 200 ms) and error budget left for a
    99.9 % SLO, per step."""
    five = F.col("status_code").cast("string").rlike("^5..$")
    a = log.groupBy(window_start("ts", step_seconds).alias("ts")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.when(five, 1).otherwise(0)).alias("_5xx"),
        F.sum(F.when(F.col("elapsed_ms") <= latency_ms, 1).otherwise(0)).alias("_fast"))
    return a.select("ts", "requests",
                    ((F.col("requests") - F.col("_5xx")) / F.col("requests") * 100).alias("availability_pct"),
                    (F.col("_fast") / F.col("requests") * 100).alias("latency_sli_pct"),
                    ((1 - F.col("_5xx") / F.col("requests")) - 0.999).alias("error_budget"))


# The reference's alert rules (name, metric, operator, threshold, hold seconds).
ALERT_RULES = [
    ("HighWriteErrorRate", "write_failure_rate", ">", 0.1, 300),
    ("LowCacheHitRate", "cache_hit_ratio", "<", 0.7, 600),
    ("HighLatency", "p95_latency_seconds", ">", 1.0, 300),
    ("ConnectionPoolExhausted", "db_pool_available", "==", 0.0, 120),
    ("CacheDown", "cache_connected", "==", 0.0, 60),
    ("KafkaDown", "kafka_producer_ready", "==", 0.0, 120),
    ("HighRequestLatency", "p95_latency_seconds", ">", 0.5, 300),
    ("HighErrorRate", "write_error_ratio", ">", 0.05, 300),
]


def rules_frame(spark, rules=ALERT_RULES) -> DataFrame:
    return spark.createDataFrame(rules, "alert string, metric string, op string, threshold double, for_seconds long")


def alert_threshold(evals: DataFrame, rules: DataFrame) -> DataFrame:
    """evals: (metric, series, ts, value). One row per rule and evaluation with its condition; a
    rule whose metric has no evaluation at all has one row without series, time and value
    (``no_data`` in ``alert_firing``). Evaluations of metrics without a rule have no row."""
    j = evals.join(rules, "metric")
    silent = rules.join(evals.select("metric").distinct(), "metric", "left_anti")
    j = j.unionByName(silent, allowMissingColumns=True)
    op, v, t = F.col("op"), F.col("value"), F.col("threshold")
    cond = (F.when(op == ">", v > t).when(op == "<", v < t).when(op == "==", v == t)
            .when(op == ">=", v >= t).when(op == "<=", v <= t).otherwise(F.lit(False)))
    return j.withColumn("condition", F.coalesce(cond, F.lit(False)))


def alert_firing(conds: DataFrame, keys=("alert", "series")) -> DataFrame:
    """Gaps and islands: island = running count of false evaluations; firing once the
    condition has held without a break for ``for_seconds``."""
    k = list(keys)
    d = conds.withColumn("_tb", F.lit(0))
    d = scan.running_sum(d, k, "ts", "_tb", F.when(F.col("condition"), 0).otherwise(1), "island")
    start = d.filter("condition").groupBy(*k, "island").agg(F.min("ts").alias("since"))
    same = F.col("s.island") == F.col("d.island")
    for c in k:
        same &= F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}"))
    d = d.alias("d").join(start.alias("s"), same, "left").select("d.*", "s.since")
    held = F.unix_micros("ts") - F.unix_micros("since")
    state = (F.when(F.col("ts").isNull(), F.lit("no_data"))
             .when(~F.col("condition"), F.lit("inactive"))
             .when(held >= F.col("for_seconds") * 1_000_000, F.lit("firing")).otherwise(F.lit("pending")))
    return d.withColumn("state", state).drop("_tb", "island")
