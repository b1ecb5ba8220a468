"""A third of all requests on one route: AQE splits the hot partition of the batch resolve
(thresholds lowered so local data counts as skewed) and results stay whole."""

from pyspark.sql import functions as F

from routelake.operators import catalog as C
from routelake.operators import scan


def test_hot_route_is_split_and_results_are_whole(spark):
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 60000
        ids = spark.range(n)
        hot = F.col("id") % 3 == 0
        req = ids.select(F.col("id").alias("request_id"), F.lit("t").alias("tenant"), F.lit("s").alias("service"),
                         F.lit("e").alias("env"),
                         F.when(hot, F.lit("v0")).otherwise(F.concat(F.lit("v"), (F.col("id") % 997 + 1).cast("string")))
                         .alias("version"))
        routes = spark.range(0, 1000).select(F.lit("t").alias("tenant"), F.lit("s").alias("service"),
                                             F.lit("e").alias("env"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("version"),
                                             F.concat(F.lit("http://"), F.col("id").cast("string")).alias("url"),
                                             (F.col("id") % 2 == 0).alias("is_active"))
        out = C.resolve_routes_batch(req, routes)
        rows = out.collect()  # runs this plan, so its adaptive plan below is the final one
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        counts = {}
        for r in rows:
            counts[r.status_code] = counts.get(r.status_code, 0) + 1
        assert sum(counts.values()) == n
        want_ok = req.join(routes.filter("is_active"), ["tenant", "service", "env", "version"], "left_semi").count()
        assert counts[200] == want_ok
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_trailing_ranges_of_a_hot_key_are_linear(spark):
    """Four times the rows of one key, within one minute or at one instant, take a few times as long at most (a sliding
    frame takes sixteen times)."""
    import time

    from routelake.operators import timeseries as TS

    def seconds(df):
        best = []
        for _ in range(2):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        return min(best)

    def rows(n, spread):
        at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("id") * int(60_000_000 / n) if spread else F.lit(0)))
        return spark.range(n).select(F.lit("hot").alias("key"), at.alias("ts"), "id")
    for spread in (True, False):
        took = [seconds(scan.trailing_count(rows(n, spread), ["key"], "ts", "id", 60, F.lit(1), "n", include_lower=False)) for n in (20_000, 80_000)]
        assert took[1] < 5 * took[0] + 1, (spread, took)
    samples = [rows(n, True).select("ts", F.col("id").cast("double").alias("value"), F.lit("i").alias("instance"), F.lit("m").alias("metric")) for n in (20_000, 80_000)]
    for op in (TS.avg_over_time, TS.gauge_delta, TS.counter_increase):
        took = [seconds(op(s, 60, ["instance", "metric"])) for s in samples]
        assert took[1] < 5 * took[0] + 1, (op.__name__, took)


def test_ranges_equal_plain_windows_on_resets_and_block_edges(spark):
    import random

    from pyspark.sql import Window

    from routelake.operators import timeseries as TS
    rnd = random.Random(21)
    times = sorted(rnd.sample(range(0, 40_000), 700) + list(range(50_000, 50_000 + 600 * 9, 600)))
    value, rows = 0.0, []
    for t in times:
        value = rnd.choice([0.0, 0.1]) if rnd.random() < 0.05 else value + rnd.random() * 1e3
        rows.append((t, value, "i", "m"))
    df = spark.createDataFrame(rows, "t long, value double, instance string, metric string").select(F.timestamp_seconds("t").alias("ts"), "value", "instance", "metric")
    order = Window.partitionBy("instance", "metric").orderBy("ts")
    w = Window.partitionBy("instance", "metric").orderBy(F.unix_micros("ts")).rangeBetween(-600_000_000 + 1, 0)
    prev = F.lag("value").over(order)
    want = df.withColumn("d", F.when(prev.isNull(), None).when(F.col("value") >= prev, F.col("value") - prev).otherwise(F.col("value"))).select(
        "ts", F.avg("value").over(w).alias("a"), (F.col("value") - F.first("value").over(w)).alias("g"),
        (F.coalesce(F.sum("d").over(w), F.lit(0.0)) - F.coalesce(F.first("d").over(w), F.lit(0.0))).alias("inc"))
    want = {r.ts: r for r in want.collect()}
    series = ["instance", "metric"]
    for op, column, name in ((TS.avg_over_time, "avg_over_time", "a"), (TS.gauge_delta, "delta", "g"), (TS.counter_increase, "increase", "inc")):
        got = {r.ts: r[column] for r in op(df, 600, series).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[t] - want[t][name]) <= 1e-9 * max(1, abs(got[t])) for t in got), name


def test_resilience_report_equals_the_newest_window_rows(spark):
    import datetime as dt
    import random

    from routelake.operators import resilience as RS
    rnd = random.Random(31)
    t0 = dt.datetime(2024, 1, 1)

    def at():
        return t0 + dt.timedelta(seconds=rnd.randrange(900))
    calls = spark.createDataFrame([(rnd.choice("ab"), rnd.choice(["database", "redis"]), at(), k, rnd.random() < 0.4) for k in range(600)],
                                  "instance string, dependency string, ts timestamp, call_id long, is_failure boolean")
    retries = spark.createDataFrame([(rnd.choice("ab"), rnd.choice(["database", "redis"]), at(), k) for k in range(500)],
                                    "instance string, budget string, ts timestamp, retry_id long")
    spans = []
    for k in range(500):
        start = at()
        spans.append((rnd.choice("ab"), rnd.choice(["read", "write"]), k, start, start + dt.timedelta(seconds=rnd.randrange(1, 40))))
    spans = spark.createDataFrame(spans, "instance string, class string, span_id long, start_ts timestamp, end_ts timestamp")
    parts = [(RS.failure_window(calls, RS.breaker_limits(spark)), "dependency", "failures_in_window"),
             (RS.retry_budget_usage(retries, RS.budget_limits(spark)), "budget", "retries_in_window"),
             (RS.concurrency_profile(spans, RS.bulkhead_limits(spark)), "class", "in_flight")]
    windows = [(df.select("instance", F.col(name).alias("name"), "ts", F.col(reading).alias("reading")).collect()) for df, name, reading in parts]
    for as_of in (t0 + dt.timedelta(seconds=s) for s in (-1, 3, 200, 431, 2000)):
        got = RS.resilience_report(calls, retries, spans, RS.budget_limits(spark), RS.bulkhead_limits(spark), as_of).collect()
        want = set()
        for kind, rows in zip(("circuit_breaker", "retry_budget", "bulkhead"), windows):
            newest = {}
            for r in rows:
                if r.ts <= as_of:
                    key = (r.instance, kind, r.name)
                    newest[key] = max(newest.get(key, (t0 - dt.timedelta(days=1), 0)), (r.ts, float(r.reading)))
            want |= {(*k, *v) for k, v in newest.items()}
        assert {(r.instance, r.kind, r.name, r.ts, r.reading) for r in got} == want
