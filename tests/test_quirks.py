
import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from routelake.functions import expr as X
from routelake.operators import catalog as C
from routelake.operators import dml as D
from routelake.operators import metrics as M
from routelake.operators import quantiles as Q
from routelake.operators import resilience as RS
from routelake.operators import scan
from routelake.operators import timeseries as TS
from routelake.session import scratch_path
from routelake.sources import lake
from routelake.streaming import handlers as H

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def ts(sec: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=sec)


def test_required_fields_falsy(spark):  # Q1
    df = spark.createDataFrame(
        [(1, "t", "s", "e", "v", "http://x"), (2, None, "s", "e", "v", "http://x"), (3, "t", "", "e", "v", "u"),
         (4, "t", "s", "e", "v", "   "), (5, "t", "s", "e", "v", None)],
        "seq long, tenant string, service string, env string, version string, url string")
    ok, bad = D.validate_route_writes(df, need_url=True)
    assert [r.seq for r in ok.collect()] == [1]
    reasons = {r.seq: r.reject_reason for r in bad.collect()}
    assert reasons == {2: "missing_field", 3: "missing_field", 4: "missing_url", 5: "missing_url"}


def test_iso_parse_and_format(spark):  # Q4, Q5, Q6
    df = spark.createDataFrame([("2024-01-01T10:00:00Z",), ("2024-01-01T15:00:00+05:00",), ("2024-01-01T10:00:00",),
                                ("junk",), (None,)], "s string")
    out = df.select(X.parse_iso_timestamp("s", F.lit("2030-01-01 00:00:00").cast("timestamp")).alias("t")).collect()
    got = [r.t for r in out]
    assert got[:3] == [dt.datetime(2024, 1, 1, 10)] * 3
    assert got[3] == got[4] == dt.datetime(2030, 1, 1)
    f = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10),), (dt.datetime(2024, 1, 1, 10, 0, 0, 120),)], "t timestamp")
    iso = [r.i for r in f.select(X.format_iso_timestamp("t", zulu=True).alias("i")).collect()]
    assert iso == ["2024-01-01T10:00:00Z", "2024-01-01T10:00:00.000120Z"]


def _audit(spark, rows):
    return spark.createDataFrame(
        [(eid, "route_changed", a, ("t", "s", "e", "v"), "u" + eid, None, None, None, ts(sec), ts(sec + 1), {},
          "req-" + eid.zfill(16), ts(sec).date()) for eid, a, sec in rows],
        "event_id string, event_type string, action string, route struct<tenant:string,service:string,env:string,"
        "version:string>, url string, previous_url string, previous_state string, changed_by string, "
        "occurred_at timestamp, processed_at timestamp, metadata map<string,string>, correlation_id string, "
        "event_date date")


def test_newest_first_tie_break(spark):  # Q7
    from routelake.operators import audit as A
    a = _audit(spark, [("1", "created", 10), ("2", "activated", 10), ("3", "deactivated", 5)])
    top = A.route_history(a, "t", "s", "e", "v", limit=1).collect()
    assert top[0].event_id == "2"


def test_audit_dedupe_and_late_events(spark):  # Q10, Q22
    path = scratch_path(spark, "t-audit")
    a1 = _audit(spark, [("1", "created", 0), ("2", "activated", 100)])
    H.append_audit(spark, a1, path)
    a2 = _audit(spark, [("2", "activated", 100), ("3", "created", -86400 * 5)])  # replay + 5 days late
    H.append_audit(spark, a2, path)
    got = sorted(r.event_id for r in lake.read_audit(spark, path).collect())
    assert got == ["1", "2", "3"]
    env = spark.createDataFrame([("k", '{"event_id":"9","action":"created"}', 1, 5, ts(0)),
                                 ("k", '{"event_id":"9","action":"activated"}', 0, 7, ts(1))],
                                "key string, value string, partition int, offset long, timestamp timestamp")
    first = H.first_per_event_id(H.parse_envelope(env)).collect()
    assert len(first) == 1 and first[0].action == "activated"  # lowest (partition, offset)


def _catalog(spark):
    ten = spark.createDataFrame([(1, "t")], "id long, name string")
    svc = spark.createDataFrame([(1, 1, "s")], "id long, tenant_id long, name string")
    env = spark.createDataFrame([(1, 1, "e")], "id long, service_id long, name string")
    ep = spark.createDataFrame([(7, 1, "v1", "http://old", False, ts(0), ts(0))],
                               "id long, environment_id long, version string, url string, is_active boolean, "
                               "created_at timestamp, updated_at timestamp")
    return ten, svc, env, ep


def test_create_reactivates_and_reports_update(spark):  # Q11
    ten, svc, env, ep = _catalog(spark)
    req = spark.createDataFrame([(1, "t", "s", "e", "v1", "http://new"), (2, "t", "s", "e", "v2", "http://b"),
                                 (3, "t2", "s", "e", "v1", "http://c")],
                                "seq long, tenant string, service string, env string, version string, url string")
    r = D.catalog_create_routes(ten, svc, env, ep, req, "2024-02-01 00:00:00")
    rows = {(x.environment_id, x.version): x for x in r["endpoints"].collect()}
    old = rows[(1, "v1")]
    assert old.id == 7 and old.is_active and old.url == "http://new" and old.created_at == ts(0)
    assert rows[(1, "v2")].id == 8
    ev = {x.seq: x.was_update for x in r["events"].collect()}
    assert ev == {1: True, 2: False, 3: False}
    assert sorted((x.id, x.name) for x in r["tenants"].collect()) == [(1, "t"), (2, "t2")]


def test_activate_missing_is_reject_and_noop_bumps(spark):  # Q12, Q21
    ten, svc, env, ep = _catalog(spark)
    req = spark.createDataFrame([(1, "t", "s", "e", "v1"), (2, "t", "s", "e", "v1"), (3, "t", "s", "e", "v9")],
                                "seq long, tenant string, service string, env string, version string")
    r = D.activate_routes(ten, svc, env, ep, req, "2024-02-01 00:00:00")
    assert [x.seq for x in r["rejects"].collect()] == [3]
    e = r["endpoints"].collect()
    assert len(e) == 1 and e[0].is_active and e[0].updated_at == dt.datetime(2024, 2, 1)
    c = D.write_counters(r["events"], r["rejects"]).first()
    assert (c.writes_total, c.writes_success, c.writes_failure) == (3, 2, 1)


def test_change_log_order(spark):
    routes = spark.createDataFrame([("t", "s", "e", "v1", "http://a", True)],
                                   "tenant string, service string, env string, version string, url string, is_active boolean")
    cl = spark.createDataFrame([(1, "deactivate", "t", "s", "e", "v1", None), (2, "activate", "t", "s", "e", "v2", None),
                                (3, "create", "t", "s", "e", "v2", "http://b"), (4, "deactivate", "t", "s", "e", "v2", None)],
                               "seq long, op string, tenant string, service string, env string, version string, url string")
    r = D.apply_change_log(routes, cl, "2024-02-01 00:00:00")
    st = {x.version: (x.url, x.is_active, x.is_new) for x in r["state"].collect()}
    assert st == {"v1": ("http://a", False, False), "v2": ("http://b", False, True)}
    assert [x.seq for x in r["rejects"].collect()] == [2]


def test_failure_and_retry_window_bounds(spark):  # Q14
    calls = spark.createDataFrame([("i", "database", ts(0), 1, True), ("i", "database", ts(60), 2, True)],
                                  "instance string, dependency string, ts timestamp, call_id long, is_failure boolean")
    fw = RS.failure_window(calls, RS.breaker_limits(spark)).orderBy("call_id").collect()
    assert [r.failures_in_window for r in fw] == [1, 1]  # strict: the failure 60 s ago has left
    retries = spark.createDataFrame([("i", "database", ts(0), 1), ("i", "database", ts(60), 2)],
                                    "instance string, budget string, ts timestamp, retry_id long")
    rb = RS.retry_budget_usage(retries, RS.budget_limits(spark)).orderBy("retry_id").collect()
    assert [r.retries_in_window for r in rb] == [1, 2]  # closed: the retry 60 s ago still counts


@pytest.mark.parametrize("n", [20, 21, 100, 101, 997])
def test_exclusive_quantiles(spark, n):  # Q16
    rnd = random.Random(n)
    vals = [round(rnd.lognormvariate(3, 1), 3) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "elapsed_ms double")
    r = M.latency_quantile_exclusive(df).first()
    p95 = statistics.quantiles(vals, n=20)[18] if n > 20 else max(vals)
    p99 = statistics.quantiles(vals, n=100)[98] if n > 100 else max(vals)
    assert r.p95_ms == pytest.approx(p95, rel=1e-12) and r.p99_ms == pytest.approx(p99, rel=1e-12)
    med = Q.quantile_report(df, [], "elapsed_ms", [("median", "m")]).first().m
    assert med == pytest.approx(statistics.median(vals), rel=1e-12)


def test_quantiles_with_negative_zero_and_ties(spark):
    vals = [0.0] * 50 + [-3.5, -1.0, 2.0, 2.0, 2.0, 7.25] * 10
    df = spark.createDataFrame([(v,) for v in vals], "elapsed_ms double")
    r = M.latency_quantile_exclusive(df).first()
    assert r.p95_ms == pytest.approx(statistics.quantiles(vals, n=20)[18])
    assert r.p99_ms == pytest.approx(statistics.quantiles(vals, n=100)[98])


def test_outcome_classifiers(spark):  # Q17
    log = spark.createDataFrame([(0, "transport error", "resolve"), (200, None, "resolve"), (201, None, "create"),
                                 (404, None, "resolve"), (500, None, "create")],
                                "status_code int, error string, operation string")
    r = M.outcome_summary_read(log).first()
    assert (r.completed, r.successful, r.not_found, r.failed, r.errors) == (5, 1, 1, 3, 1)
    w = M.outcome_summary_write(log, groups=[]).first()
    assert (w.successful, w.failed, w.errors) == (2, 3, 1)


def test_cache_aside_expiry_empty_and_negative(spark):  # Q19
    as_of = "2024-01-01 00:00:00"
    req = spark.createDataFrame([(1, "t", "s", "e", "a"), (2, "t", "s", "e", "b"), (3, "t", "s", "e", "c"),
                                 (4, "t", "s", "e", "d")],
                                "request_id long, tenant string, service string, env string, version string")
    cache = spark.createDataFrame([("route:t:s:e:a", "http://a", False, ts(0)), ("route:t:s:e:b", "", False, ts(30)),
                                   ("route:t:s:e:c", None, True, ts(5)), ("route:t:s:e:d", "http://d", False, ts(9))],
                                  "route_key string, url string, is_negative boolean, expires_at timestamp")
    routes = spark.createDataFrame([("t", "s", "e", "a", "http://A", True), ("t", "s", "e", "b", "http://B", True)],
                                   "tenant string, service string, env string, version string, url string, is_active boolean")
    out = {r.request_id: (r.outcome, r.url, r.status_code)
           for r in C.resolve_cache_aside(req, cache, routes, as_of).collect()}
    assert out == {1: ("miss", "http://A", 200), 2: ("miss", "http://B", 200), 3: ("negative_hit", None, 404),
                   4: ("hit", "http://d", 200)}


def test_counter_reset(spark):
    s = spark.createDataFrame([(ts(i * 10), "i", "m", "e", v) for i, v in enumerate([5.0, 9.0, 2.0, 4.0])],
                              "ts timestamp, instance string, metric string, endpoint string, value double")
    d = [r.delta for r in TS.counter_deltas(s).orderBy("ts").collect()]
    assert d == [None, 4.0, 2.0, 2.0]
    inc = [r.increase for r in TS.counter_increase(s, 3600).orderBy("ts").collect()]
    assert inc == [0.0, 4.0, 6.0, 8.0]


def test_histogram_quantile_edges(spark):
    rows = [("g1", 0.1, 10), ("g1", 0.5, 10), ("g1", float("inf"), 10),      # all in the first bucket
            ("g2", 0.1, 0), ("g2", 0.5, 1), ("g2", float("inf"), 10),        # rank falls in +Inf
            ("g3", 0.1, 0), ("g3", 0.5, 0), ("g3", float("inf"), 0)]         # empty
    b = spark.createDataFrame(rows, "g string, le double, bucket_count long")
    q = {r.g: r.q50 for r in TS.histogram_quantile(b, 0.5, ["g"]).collect()}
    assert q["g1"] == pytest.approx(0.05) and q["g2"] == 0.5 and q["g3"] is None


def test_alert_hold(spark):
    evals = [(ts(60 * m), m < 4 or m > 4) for m in range(0, 11)]  # true 0..3, false at 4, true 5..10
    df = spark.createDataFrame([("A", "s", t, c, 300) for t, c in evals],
                               "alert string, series string, ts timestamp, condition boolean, for_seconds long")
    st = [r.state for r in TS.alert_firing(df).orderBy("ts").collect()]
    assert st[:4] == ["pending"] * 4 and st[4] == "inactive"
    assert st[5:10] == ["pending"] * 5 and st[10] == "firing"


def test_touching_spans(spark):
    spans = spark.createDataFrame([("i", "write", 1, ts(0), ts(10)), ("i", "write", 2, ts(10), ts(20))],
                                  "instance string, class string, span_id long, start_ts timestamp, end_ts timestamp")
    p = RS.concurrency_profile(spans, RS.bulkhead_limits(spark)).orderBy("ts", "delta").collect()
    assert max(r.in_flight for r in p) == 1 and p[-1].in_flight == 0 and min(r.in_flight for r in p) >= 0


def test_stream_parsing_rejects(spark):
    env = spark.createDataFrame([("k", "{not json", 0, 1, ts(0)),
                                 ("k", '{"event_id":"7","action":"created","tenant":"t","service":"s","env":"e","version":"v","x":1}', 0, 2, ts(0)),
                                 ("k", '{"action":"created","tenant":"t","service":"s","env":"e","version":"v"}', 0, 4, ts(0)),
                                 ("k", '{"action":"created","tenant":"t","service":"s","env":"e"}', 0, 3, ts(0))],
                                "key string, value string, partition int, offset long, timestamp timestamp")
    r = {x.offset: x.reject_reason for x in H.parse_envelope(env).collect()}
    assert r == {1: "malformed", 2: None, 3: "missing_field", 4: "missing_event_id"}


def test_dense_index_and_chunked_windows_match_plain_windows(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c"]), ts(rnd.randint(0, 40000)), k, float(rnd.randint(-3, 9))) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long, v double")
    w = Window.partitionBy("key").orderBy("ts", "id")
    ref = df.select("id", F.lag("v").over(w).alias("p"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    lag = scan.lag_within(df, ["key"], "ts", "id", ["v"], chunk_seconds=300)
    run = scan.running_sum(df, ["key"], "ts", "id", F.col("v"), "s2", chunk_seconds=300)
    j = ref.join(lag.select("id", "prev_v"), "id").join(run.select("id", "s2"), "id")
    bad = j.filter(~F.col("p").eqNullSafe(F.col("prev_v")) | (F.col("s") != F.col("s2"))).count()
    assert bad == 0
    idx = D.dense_index(df.select("id"), ["id"], num_partitions=5).collect()
    assert sorted((r.id, r.idx) for r in idx) == [(i, i) for i in range(3000)]


def test_chunked_asof_halo_and_trailing_match_plain_windows(spark):
    """Hot key 'a' holds most rows; chunks of 5 minutes force many chunk boundaries."""
    rnd = random.Random(11)
    rows = [(rnd.choice(["a"] * 8 + ["b", "c"]), ts(rnd.randint(0, 20000)), k, float(rnd.randint(0, 9)))
            for k in range(2500)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long, v double").dropDuplicates(["key", "ts"])
    # as-of: value of the newest row at or before ts - 600 s
    right = df.select("key", (F.col("ts") + F.expr("INTERVAL 600 SECONDS")).alias("ts"), "v")
    got = scan.asof_last(df.select("key", "ts", "id"), right, ["key"], "ts", "v", "before", chunk_seconds=300)
    u = (df.select("key", "ts", "id", F.lit(None).cast("double").alias("rv"), F.lit(1).alias("side"))
         .unionByName(right.select("key", "ts", F.lit(None).cast("long").alias("id"), F.col("v").alias("rv"),
                                   F.lit(0).alias("side"))))
    w = Window.partitionBy("key").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, 0)
    ref = u.withColumn("before", F.last("rv", ignorenulls=True).over(w)).filter("side = 1")
    j = got.select("id", "before").join(ref.select("id", F.col("before").alias("ref")), "id")
    assert j.filter(~F.col("before").eqNullSafe(F.col("ref"))).count() == 0
    # trailing sums (t - 900 s, t] and a mean from two blocks vs plain range frames
    wr = Window.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(-900 * 1_000_000 + 1, 0)
    ref2 = df.select("id", F.sum("v").over(wr).alias("s_ref"), F.avg("v").over(wr).alias("a_ref"))
    ts_ = scan.trailing_sums(df, ["key"], "ts", "id", 900, {"s": F.col("v")}, include_lower=False)

    def sums(w_):
        f = w_.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return {"_s": F.sum("v").over(f), "_n": F.count("v").over(f)}
    hw = scan.two_blocks(df, ["key"], "ts", 900, sums, sums).withColumn(
        "a", (F.col("_s") + F.coalesce("suffix._s", F.lit(0.0))) / (F.col("_n") + F.coalesce("suffix._n", F.lit(0))))
    j2 = ref2.join(ts_.select("id", "s"), "id").join(hw.select("id", "a"), "id")
    assert j2.filter((F.col("s") != F.col("s_ref")) | (F.abs(F.col("a") - F.col("a_ref")) > 1e-9)).count() == 0


def test_failure_predicate_excludes_not_found(spark):  # Q13
    calls = spark.createDataFrame([("i", "database", ts(0), 1, True, 404), ("i", "database", ts(1), 2, True, 500)],
                                  "instance string, dependency string, ts timestamp, call_id long, is_failure boolean, "
                                  "status int")
    fw = RS.failure_window(calls, RS.breaker_limits(spark), failure_predicate=F.col("status") >= 500)
    assert [r.failures_in_window for r in fw.orderBy("call_id").collect()] == [0, 1]


def test_trailing_sums_match_plain_windows(spark):
    rnd = random.Random(13)
    rows = [(rnd.choice(["a"] * 8 + ["b"]), ts(rnd.randint(0, 20000)), k, float(rnd.randint(-2, 9)))
            for k in range(2000)]
    rows += [("a", ts(500), 5000 + k, 1.0) for k in range(5)]  # ties at one instant
    df = spark.createDataFrame(rows, "key string, ts timestamp, id long, v double")
    for lower in (False, True):
        lo = -900 * 1_000_000 + (0 if lower else 1)
        wr = Window.partitionBy("key").orderBy(F.unix_micros("ts")).rangeBetween(lo, 0)
        wl = Window.partitionBy("key", "ts").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
        ref = df.select("id", (F.sum("v").over(wr) - F.coalesce(F.sum("v").over(wl), F.lit(0.0))).alias("r"),
                        (F.count(F.lit(1)).over(wr) - F.coalesce(F.count(F.lit(1)).over(wl), F.lit(0))).alias("c"))
        got = scan.trailing_sums(df, ["key"], "ts", "id", 900, {"s": F.col("v"), "n": F.lit(1)}, lower)
        j = ref.join(got.select("id", "s", "n"), "id")
        assert j.count() == len(rows)
        assert j.filter((F.col("s") != F.col("r")) | (F.col("n") != F.col("c"))).count() == 0, lower


def test_history_page_has_more_edges(spark):
    from routelake.operators import audit as A
    a3 = _audit(spark, [("1", "created", 1), ("2", "activated", 2), ("3", "deactivated", 3)])
    p = A.history_page(a3, "t", "s", "e", "v", limit=3).collect()
    assert len(p) == 3 and not any(r.has_more for r in p)
    p = A.history_page(a3, "t", "s", "e", "v", limit=2).collect()
    assert [r.event_id for r in p] == ["3", "2"] and all(r.has_more for r in p)


def test_route_state_at_with_changes_at_one_instant(spark):
    from routelake.operators import audit as A
    a = _audit(spark, [("1", "created", 0), ("2", "deactivated", 10), ("3", "activated", 10), ("4", "deactivated", 20)])
    probes = spark.createDataFrame([("t", "s", "e", "v", ts(5)), ("t", "s", "e", "v", ts(10)), ("t", "s", "e", "v", ts(15)),
                                    ("t", "s", "e", "v", ts(-1))],
                                   "tenant string, service string, env string, version string, at timestamp")
    got = {r.at: (r.action_then, r.active_then) for r in A.route_state_at(a, probes).collect()}
    assert got[ts(5)] == ("created", True)
    assert got[ts(10)] == ("activated", True) and got[ts(15)] == ("activated", True)  # tie: highest event_id
    assert got[ts(-1)] == (None, False)


def test_counters_do_not_depend_on_input_order_or_chunks(spark, monkeypatch):
    """Two samples at one instant count as one (the larger), whatever the order and the chunk size."""
    rnd = random.Random(3)
    rows = [(ts(10 * (k // 2)), "i", "m", "e", float(k % 37)) for k in range(200)] + [(ts(10), "i", "m", "e", 1.0), (ts(10), "i", "m", "e", 3.0)]
    schema = "ts timestamp, instance string, metric string, endpoint string, value double"
    want = None
    for chunk in (30, 900, 10**7):
        for part in (rows, rows[::-1], rnd.sample(rows, len(rows))):
            monkeypatch.setattr(TS.scan.lag_within, "__defaults__", ("prev_", chunk))
            monkeypatch.setattr(TS.scan.asof_last, "__defaults__", (chunk,))
            s = spark.createDataFrame(part, schema).repartition(3)
            got = [sorted(map(tuple, q.collect())) for q in (TS.counter_increase(s, 300), TS.gauge_delta(s, 300), TS.avg_over_time(s, 300), TS.counter_compare(s, 60))]
            assert want is None or got == want
            want = got
    assert len(want[0]) == 100


def test_quantiles_of_a_shared_value_infinity_and_nan(spark):
    rows = [(1.0,)] * 5000 + [(2.0,)] * 3 + [(float("inf"),)]
    df = spark.createDataFrame(rows, "v double")
    spec = [("median", "p50"), ("exclusive", "p99", 99, 100, 100)]
    r = Q.quantile_report(df, [], "v", spec).first()
    assert (r.p50, r.p99) == (1.0, 1.0)
    r = Q.quantile_report(spark.createDataFrame([(float("-inf"),), (float("inf"),), (float("inf"),)], "v double"), [], "v", spec[:1]).first()
    assert r.p50 == float("inf")
    r = Q.quantile_report(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "v double"), [], "v", spec[:1]).first()
    assert r.p50 == 2.5


def test_change_log_rejects_blank_urls_and_unknown_ops(spark):
    from routelake.operators import dml as D
    routes = spark.createDataFrame([("t", "s", "e", "v1", "http://a", True)], "tenant string, service string, env string, version string, url string, is_active boolean")
    log = spark.createDataFrame([(1, "create", "t", "s", "e", "v2", "  "), (2, "create", "t", "s", "e", "v3", None), (3, "purge", "t", "s", "e", "v1", None),
                                 (4, None, "t", "s", "e", "v1", None), (5, "activate", "t", "s", "e", "v2", None), (6, "deactivate", "t", "s", "e", "v1", None)],
                                "seq long, op string, tenant string, service string, env string, version string, url string")
    r = D.apply_change_log(routes, log, "2024-01-01 00:00:00")
    assert [(x.version, x.is_active) for x in r["state"].collect()] == [("v1", False)]
    assert sorted((x.seq, x.reject_reason) for x in r["rejects"].collect()) == [(1, "missing_url"), (2, "missing_url"), (3, "unknown_op"), (4, "unknown_op"), (5, "not_found")]


def test_iso_timestamps_need_a_date(spark):
    rows = ["12:30:00", "2024", "2024-01", "2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456+02:00", "junk", "", None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, s string")
    got = {r.k: r.t for r in df.select("k", X.parse_iso_timestamp("s").alias("t")).collect()}
    assert [k for k, v in got.items() if v is not None] == [3, 4, 5]
    assert got[5] == dt.datetime(2024, 1, 2, 1, 4, 5, 123456)


def test_audit_append_stores_an_id_once(spark):
    path = scratch_path(spark, "t-audit-ids")
    batch = _audit(spark, [("1", "created", 0), ("1", "created", 0), ("2", "created", 5)])
    H.append_audit(spark, batch, path)
    H.append_audit(spark, _audit(spark, [("1", "created", 86400 * 9), ("3", "created", 86400 * 9)]), path)
    assert sorted(r.event_id for r in lake.read_audit(spark, path).collect()) == ["1", "2", "3"]


def test_audit_arguments_are_checked(spark):
    from routelake.operators import audit as A
    a = _audit(spark, [("1", "created", 0)])
    for bad in (lambda: A.filter_recent(a, "2024-01-01", days=366), lambda: A.filter_recent(a, "2024-01-01", days=-1),
                lambda: A.filter_time_range(a, "2024-02-01", "2024-01-01")):
        with pytest.raises(ValueError):
            bad()
    assert A.filter_recent(a, "2024-01-02", days=0).count() == 1


def test_trace_of_a_hot_id_is_numbered_by_chunks(spark):
    from routelake.operators import ingest
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 4 + ["a", "b", None]), rnd.choice([ts(rnd.randint(0, 20000))] * 9 + [None]), f"d{k}") for k in range(1500)]
    df = spark.createDataFrame(rows, "correlation_id string, ts timestamp, detail string")
    got = ingest.trace_by_correlation({"x": df.filter("detail < 'd5'"), "y": df.filter("detail >= 'd5'")})
    want = (df.filter("correlation_id is not null").withColumn("source", F.when(F.col("detail") < "d5", "x").otherwise("y"))
            .withColumn("step", F.row_number().over(Window.partitionBy("correlation_id").orderBy("ts", "source", "detail")).cast("long")))
    columns = ["correlation_id", "ts", "source", "detail", "step"]
    assert got.columns == columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(columns).collect()))
    assert "row_number()" not in got._jdf.queryExecution().toString()      # no window sorts an id's rows
