"""Exact order statistics without sorting a group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one task, and a window
``partitionBy(group).orderBy(value)`` sorts the whole group in one task. Here rows are first
counted per (group, value), combined on the map side, so that a value that most rows share is
one row from then on. A rank is found by cumulating counts: a log-scale bucket per value (64
per octave), the bucket that holds the wanted rank, then 65,536 linear sub-buckets of that
bucket, and only the distinct values of the chosen sub-bucket are sorted.

Order: -Infinity, finite values, Infinity, NaN (as Spark sorts doubles). Nulls do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1 = 64            # level-1 buckets per octave
OFF = 1_000_000    # keeps level-1 ids of positive and negative values apart
K2 = 65536         # level-2 linear sub-buckets
INF = 2_000_000    # level-1 id of infinity; NaN follows it


def _b1(v: Column) -> Column:
    """Order-preserving log bucket (java.lang.Math.log is semi-monotonic)."""
    pos = F.floor(F.log2(v) * K1) + OFF
    neg = -(F.floor(F.log2(-v) * K1) + OFF)
    inf = F.lit(float("inf"))
    return (F.when(F.isnan(v), F.lit(INF + 1)).when(v == inf, F.lit(INF)).when(v == -inf, F.lit(-INF))
            .when(v > 0, pos).when(v < 0, neg).otherwise(F.lit(0)).cast("long"))


def _b2(v: Column, b1: Column) -> Column:
    e_pos = (b1 - OFF).cast("double") / K1
    e_neg = (-b1 - OFF).cast("double") / K1
    lo = F.when(b1 > 0, F.pow(F.lit(2.0), e_pos)).otherwise(-F.pow(F.lit(2.0), e_neg + 1.0 / K1))
    hi = F.when(b1 > 0, F.pow(F.lit(2.0), e_pos + 1.0 / K1)).otherwise(-F.pow(F.lit(2.0), e_neg))
    raw = F.floor((v - lo) / (hi - lo) * K2)
    return F.when((b1 == 0) | (F.abs(b1) >= INF), F.lit(0)).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(K2 - 1))).cast("long")


def _locate(counts: DataFrame, keys, bucket: str, want: DataFrame, want_rank: str) -> DataFrame:
    """For each wanted rank, the bucket holding it and the rank inside that bucket."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = counts.withColumn("_cum", F.sum("_cnt").over(w)).withColumn("_before", F.col("_cum") - F.col("_cnt"))
    j = want.join(c, keys, "inner").filter((F.col(want_rank) > F.col("_before")) & (F.col(want_rank) <= F.col("_cum")))
    return j.withColumn(want_rank, F.col(want_rank) - F.col("_before")).drop("_cnt", "_cum", "_before")


def order_statistics(df: DataFrame, groups, value: str, wanted: DataFrame) -> DataFrame:
    """``wanted``: (groups..., rank) with 1-based ranks. Returns (groups..., rank, value)."""
    g = list(groups)
    d = (df.select(*g, F.col(value).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
         .groupBy(*g, "_x").agg(F.count(F.lit(1)).alias("_cnt")))
    d = d.withColumn("_b1", _b1(F.col("_x")))
    want = wanted.select(*g, "rank").distinct().withColumn("_r", F.col("rank"))
    c1 = d.groupBy(*g, "_b1").agg(F.sum("_cnt").alias("_cnt"))
    # t1/t2/t3 hold (#groups x #ranks) rows; AQE turns their joins into broadcasts from the
    # measured size at run time, and keeps shuffle joins if #groups is large
    t1 = _locate(c1, g, "_b1", want, "_r")
    d2 = d.join(t1.select(*g, "_b1").distinct(), g + ["_b1"], "left_semi").withColumn("_b2", _b2(F.col("_x"), F.col("_b1")))
    c2 = d2.groupBy(*g, "_b1", "_b2").agg(F.sum("_cnt").alias("_cnt"))
    t2 = _locate(c2, g + ["_b1"], "_b2", t1, "_r")
    d3 = d2.join(t2.select(*g, "_b1", "_b2").distinct(), g + ["_b1", "_b2"], "left_semi")
    return _locate(d3, g + ["_b1", "_b2"], "_x", t2, "_r").select(*g, "rank", F.col("_x").alias("value"))


def _weights_exclusive(i: int, n: int, threshold: int, name: str) -> list:
    """statistics.quantiles(n=n, method='exclusive')[i-1] as integer weights over ranks,
    or the max when there are at most ``threshold`` samples (Q16)."""
    N = F.col("_n")
    m = N + 1
    j = F.least(F.greatest(F.floor(F.lit(i) * m / F.lit(n)).cast("long"), F.lit(1)), N - 1)
    delta = F.lit(i) * m - j * F.lit(n)
    small = N <= threshold
    return [
        (name, F.when(small, N).otherwise(j), F.when(small, F.lit(n)).otherwise(F.lit(n) - delta), F.lit(n)),
        (name, F.when(small, N).otherwise(j + 1), F.when(small, F.lit(0)).otherwise(delta), F.lit(n)),
    ]


def _weights_median(name: str) -> list:
    N = F.col("_n")
    odd = (N % 2) == 1
    a = F.when(odd, (N + 1) / 2).otherwise(N / 2).cast("long")
    b = F.when(odd, (N + 1) / 2).otherwise(N / 2 + 1).cast("long")
    return [(name, a, F.lit(1), F.lit(2)), (name, b, F.lit(1), F.lit(2))]


def quantile_report(df: DataFrame, groups, value: str, specs) -> DataFrame:
    """One row per group with one column per spec. ``specs``: list of
    ('median', name) or ('exclusive', name, i, n, threshold)."""
    g = list(groups)
    if not g:
        # one global group. The key must not be a literal: Catalyst would fold the equi-join
        # on it into a nested-loop join. isnull(value) * 0 is always 0 but not foldable.
        k = F.isnull(F.col(value)).cast("int") * 0
        return quantile_report(df.withColumn("_g", k), ["_g"], value, specs).drop("_g")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    parts = []
    for s in specs:
        if s[0] == "median":
            parts += _weights_median(s[1])
        else:
            _, name, i, n, thr = s
            parts += _weights_exclusive(i, n, thr, name)
    rows = F.explode(F.array(*[F.struct(F.lit(nm).alias("spec"), r.cast("long").alias("rank"),
                                        w.cast("double").alias("w"), dv.cast("double").alias("div"))
                               for nm, r, w, dv in parts]))
    need = counts.select(*g, rows.alias("s")).select(*g, "s.*")
    vals = order_statistics(df, g, value, need.select(*g, "rank"))
    j = need.join(vals, g + ["rank"])
    agg = j.groupBy(*g, "spec").agg((F.sum(F.col("w") * F.col("value")) / F.first("div")).alias("q"))
    names = [s[1] for s in specs]
    return agg.groupBy(*g).pivot("spec", names).agg(F.first("q"))
