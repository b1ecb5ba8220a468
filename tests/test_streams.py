"""Streams run with availableNow over envelope files; results compared with batch expectations."""

import datetime as dt
import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from routelake import schemas
from routelake.session import scratch_path
from routelake.sources import lake
from routelake.streaming import folds, ids
from routelake.streaming import handlers as H
from routelake.streaming import streams as S

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def env_row(eid, action, sec, partition, offset, route=("t", "s", "e", "v1"), **extra):
    occurred = (T0 + dt.timedelta(seconds=sec)).strftime("%Y-%m-%dT%H:%M:%S") + "Z"
    body = {"event_id": eid, "event_type": "route_changed", "action": action, "tenant": route[0],
            "service": route[1], "env": route[2], "version": route[3], "url": f"http://{eid}",
            "occurred_at": occurred, "correlation_id": f"req-{str(eid).zfill(16)}", **extra}
    return (":".join(route), json.dumps(body), partition, offset, T0 + dt.timedelta(seconds=sec + 1))


def write_batch(spark, path, rows):
    spark.createDataFrame(rows, schemas.ENVELOPE).coalesce(1).write.mode("append").parquet(path)


def test_audit_stream_exactly_once_across_restarts(spark):
    src, audit, rej, ck = (scratch_path(spark, n) for n in ("src", "audit", "rej", "ck"))
    write_batch(spark, src, [
        env_row("1", "created", 0, 0, 1),
        env_row("1", "created", 0, 1, 9),           # duplicate id in the same batch (later offset)
        env_row("2", "activated", 60, 0, 2, extra_field="x"),
        ("k", "{broken json", 0, 3, T0),            # malformed
        env_row(None, "created", 5, 0, 4),          # null id: rejected from the audit table
        env_row("3", None, 5, 0, 5),                # missing action
    ])
    S.run(S.audit_log_query(S.read_route_stream(spark, src), audit, rej, ck))
    write_batch(spark, src, [
        env_row("2", "activated", 60, 0, 2),        # replayed in a later batch
        env_row("4", "deactivated", -5 * 86400, 1, 10),  # five days late: kept
        env_row("1", "created", 3 * 86400, 1, 11),  # a stored id with another date: not stored again
    ])
    S.run(S.audit_log_query(S.read_route_stream(spark, src), audit, rej, ck))  # restart from the checkpoint
    S.run(S.audit_log_query(S.read_route_stream(spark, src), audit, rej, ck))  # nothing new
    a = lake.read_audit(spark, audit)
    ids = sorted(r.event_id for r in a.collect())
    assert ids == ["1", "2", "4"]
    first = a.filter("event_id = '1'").first()
    assert first.url == "http://1" and first.occurred_at == T0
    reasons = sorted(r.reject_reason for r in spark.read.parquet(rej).collect())
    assert reasons == ["malformed", "missing_event_id", "missing_field"]


def test_cache_invalidate_then_warm(spark):
    src, cache_path, ck = (scratch_path(spark, n) for n in ("src", "cache", "ck"))
    start = spark.createDataFrame(
        [("route:t:s:e:v1", "http://stale", False, T0 + dt.timedelta(days=1)),
         ("route:t:s:e:v9", "http://other", False, T0 + dt.timedelta(days=1))], schemas.CACHE)
    H.start_cache(start, cache_path)
    write_batch(spark, src, [env_row("1", "created", 0, 0, 1), env_row("2", "deactivated", 30, 0, 2, route=("t", "s", "e", "v2"))])
    routes = spark.createDataFrame([("t", "s", "e", "v1", "http://fresh", True), ("t", "s", "e", "v2", "http://x", False)],
                                   "tenant string, service string, env string, version string, url string, is_active boolean")
    S.run(S.cache_query(S.read_route_stream(spark, src), cache_path, lambda s: routes, ck))
    got = {r.route_key: (r.url, r.is_negative, r.expires_at) for r in H.read_cache(spark, cache_path).collect()}
    assert got["route:t:s:e:v9"][0] == "http://other"                       # untouched
    assert got["route:t:s:e:v1"] == ("http://fresh", False, T0 + dt.timedelta(seconds=61))
    assert got["route:t:s:e:v2"] == (None, True, T0 + dt.timedelta(seconds=41))  # negative, 10 s TTL


def _files(df):
    """The files that rows come from (those of pruned folders are listed, but not read)."""
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


COUNTS = "window_start timestamp, action string, count long"


def test_event_counters_match_batch(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("src", "cnt", "ck"))
    rows = [env_row(str(i), ["created", "activated"][i % 2], i * 17, i % 2, i) for i in range(40)]
    write_batch(spark, src, rows[:25])
    write_batch(spark, src, rows[25:])
    keys = ["window_start", "action"]
    S.run(S.counter_query(S.read_route_stream(spark, src, max_files_per_trigger=1), S.event_counters, keys, out, ck))
    got = {(r.window_start, r.action): r["count"] for r in S.read_counters(spark, out, keys, COUNTS).collect()}
    want = {}
    for i in range(40):
        t = T0 + dt.timedelta(seconds=i * 17)
        k = (t.replace(second=0), ["created", "activated"][i % 2])
        want[k] = want.get(k, 0) + 1
    assert got == want


def test_late_requests_count_and_replays_count_once(spark):
    src, out, ck = (scratch_path(spark, n) for n in ("req", "cnt", "ck"))
    schema = "ts timestamp, endpoint string, elapsed_ms double"
    keys = ["window_start", "endpoint"]
    partial = S.request_metrics(spark.createDataFrame([], schema)).schema
    total = {}
    for i, minutes in enumerate((0, 10, -180, 0, -181, 10)):                  # three hours late among them
        ts = T0 + dt.timedelta(minutes=minutes)
        batch = spark.createDataFrame([(ts, "r", 5.0), (ts, "r", 700.0)], schema)
        batch.coalesce(1).write.mode("append").parquet(src)
        S.run(S.counter_query(spark.readStream.schema(schema).parquet(src), S.request_metrics, keys, out, ck, compact_every=2))
        folds.append(S.request_metrics(batch), out, i)                         # the same micro-batch again
        total[ts] = total.get(ts, 0) + 2
        got = {r.window_start: r for r in S.read_counters(spark, out, keys, partial).collect()}
        assert {t: r.requests for t, r in got.items()} == total
    le = list(S.M.DEFAULT_BUCKETS).index(0.25)
    assert all(r[f"le_{le}"] * 2 == r.requests for r in got.values())


def test_cache_batch_appends_its_keys_and_compaction_shows_one_version(spark):
    cache_path = scratch_path(spark, "cache")
    keys = [f"route:t:s:e:v{i}" for i in range(200)]
    H.start_cache(spark.createDataFrame([(k, "http://x", False, T0) for k in keys], schemas.CACHE), cache_path)
    routes = spark.createDataFrame([("t", "s", "e", "v7", "http://new", True)],
                                   "tenant string, service string, env string, version string, url string, is_active boolean")
    refill = S.cache_batch_handler(cache_path, lambda s: routes, compact_every=None)
    remove = S.cache_batch_handler(cache_path, lambda s: routes, warm=False, compact_every=None)
    rows = [env_row("1", "created", 0, 0, 1, route=("t", "s", "e", "v7")), env_row("2", "created", 9, 0, 2, route=("t", "s", "e", "v7"))]
    for batch_id, handle, some in ((0, refill, rows), (1, remove, [env_row("3", "deactivated", 20, 0, 3, route=("t", "s", "e", "v8"))])):
        batch = spark.createDataFrame(some, schemas.ENVELOPE)
        handle(batch, batch_id)
        handle(batch, batch_id)                                                # replayed
        assert spark.read.parquet(folds.batch_folder(cache_path, batch_id)).count() == 1

    def content(df):
        return {r.route_key: r.url for r in df.collect()}
    want = {k: "http://x" for k in keys if k != "route:t:s:e:v8"} | {"route:t:s:e:v7": "http://new"}
    reader = H.read_cache(spark, cache_path)                                   # planned before the compaction, run after it
    H.compact_cache(spark, cache_path, 1)
    assert content(reader) == want and content(H.read_cache(spark, cache_path)) == want
    folded = f"{cache_path}/{folds.newest(spark, cache_path).base}/"
    assert all(folded in f for f in _files(folds.read(spark, cache_path, schemas.CACHE_CHANGE)))
    remove(spark.createDataFrame([env_row("3", "deactivated", 20, 0, 3, route=("t", "s", "e", "v9"))], schemas.ENVELOPE), 1)
    assert content(H.read_cache(spark, cache_path)) == want                    # a batch that is folded already adds nothing
    refill(spark.createDataFrame([env_row("4", "created", 50, 0, 4, route=("t", "s", "e", "v8"))], schemas.ENVELOPE), 2)
    assert content(H.read_cache(spark, cache_path)) == want | {"route:t:s:e:v8": None}
    some = spark.createDataFrame([("route:t:s:e:v8",), ("route:t:s:e:v3",)], "route_key string")
    assert content(H.read_cache(spark, cache_path, some)) == {"route:t:s:e:v8": None, "route:t:s:e:v3": "http://x"}


def test_unpublished_compaction_is_not_seen(spark):
    path = scratch_path(spark, "fold")
    for b in range(3):
        folds.append(spark.createDataFrame([("a", b), ("b", 1)], "k string, n long"), path, b)

    def fold(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"))
    folds.write_base(spark.createDataFrame([("a", 99)], "k string, n long"), path)   # an attempt that died before it was published
    assert sorted(map(tuple, fold(folds.read(spark, path, "k string, n long")).collect())) == [("a", 3), ("b", 3)]
    folds.compact(spark, path, "k string, n long", fold, 1)
    assert sorted(map(tuple, folds.read(spark, path, "k string, n long").collect())) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 2), ("b", 2, 1)]


def test_key_state_files_do_not_grow_with_batches(spark):
    src, state, ck = (scratch_path(spark, n) for n in ("src", "state", "ck"))
    for i in range(9):
        write_batch(spark, src, [env_row(str(i), "created", i, 0, 10 - i if i == 8 else 10 + i, route=("t", "s", "e", f"v{i % 2}"))])
    S.run(S.key_order_query(S.read_route_stream(spark, src, max_files_per_trigger=1), state, ck, compact_every=3))
    got = {r.version: r.event_id for r in S.read_key_state(spark, state).collect()}
    assert got == {"v0": "6", "v1": "7"}                                       # event 8 has an older offset
    assert len(_files(folds.read(spark, state, schemas.KEY_STATE))) == 1       # all batches are folded


def _bytes(df):
    import os
    return sum(os.path.getsize(f.removeprefix("file://")) for f in _files(df))


def test_id_lookup_does_not_grow_with_the_history(spark):
    wanted = spark.createDataFrame([("id-3",), ("id-77",), ("new",)], "event_id string")
    read = []
    for history in (4_000, 40_000):
        path = scratch_path(spark, "ids")
        for b, (lo, hi) in enumerate(((0, history // 2), (history // 2, history))):
            folds.append(spark.range(lo, hi).select(F.concat(F.lit("id-"), F.col("id").cast("string")).alias("event_id")), f"{path}/done", b)
            ids.compact(spark, path, b, ids_per_folder=250)
        found = ids.known(spark, path, wanted)
        assert sorted(r[0] for r in found.join(wanted, "event_id", "left_semi").collect()) == ["id-3", "id-77"]
        assert spark.read.parquet(f"{path}/done/{folds.newest(spark, f'{path}/done').base}").filter("event_id IS NOT NULL").count() == history
        read.append(_bytes(found))
    assert read[1] < 2 * read[0]


def test_audit_append_after_failures(spark, monkeypatch):
    """Attempts that die after their rows, or before them, leave every id stored exactly once."""
    path = scratch_path(spark, "audit")

    def rows(*eids, day=0):
        batch = spark.createDataFrame([env_row(e, "created", day * 86400, 0, 1) for e in eids], schemas.ENVELOPE)
        return H.to_audit_rows(H.split_valid(H.parse_envelope(batch))[0])

    def stored():
        return sorted(r.event_id for r in lake.read_audit(spark, path).collect())
    H.append_audit(spark, rows("1", "2"), path, 0)
    keep, lost = folds.append, {1, 2}

    def lossy(df, p, b):
        if p.endswith("/done") and b in lost:
            lost.discard(b)
            raise OSError("lost")
        keep(df, p, b)
    monkeypatch.setattr(folds, "append", lossy)
    for call in ((rows("3", "2"), path, 1), (rows("4"), path)):                # a batch of a stream, and a single call
        try:
            H.append_audit(spark, *call)
        except OSError:
            pass
    assert not lost
    assert stored() == ["1", "2", "3", "4"]
    H.append_audit(spark, rows("3", "2"), path, 1)                             # the replay
    assert stored() == ["1", "2", "3", "4"]
    H.append_audit(spark, rows("4", "3", "5", day=30), path, 3, compact_every=4)   # known ids with another date; then folded
    H.append_audit(spark, rows("1", "4", "5", "6", day=60), path, 4)
    assert stored() == ["1", "2", "3", "4", "5", "6"]


def test_published_offsets_follow_the_events(spark):
    topic = scratch_path(spark, "topic")
    sent = [env_row(f"{i:03}", "created", (i * 37) % 100, 0, 0, route=("t", "s", "e", f"v{i % 5}"))[:2] for i in range(100)]
    for part in (sent[:60], sent[60:], sent[:0]):
        S.publish_route_events(spark.createDataFrame(part, "key string, value string").repartition(7), path=topic, partitions=3)
    rows = spark.read.schema(schemas.ENVELOPE).parquet(topic).collect()
    assert len(rows) == 100
    for p in {r.partition for r in rows}:
        offsets = sorted(r.offset for r in rows if r.partition == p)
        assert offsets == list(range(len(offsets)))                             # gapless
    first = {v for _, v in sent[:60]}
    for key in {k for k, _ in sent}:
        mine = sorted((r for r in rows if r.key == key), key=lambda r: r.offset)
        assert len({r.partition for r in mine}) == 1
        for call in (True, False):
            times = [json.loads(r.value)["occurred_at"] for r in mine if (r.value in first) == call]
            assert times == sorted(times)
    assert [r.offset for r in S.peek(spark, 3, path=topic).collect()] == [0, 1, 2]


def test_audit_batch_replay_is_idempotent(spark):
    audit, rej = scratch_path(spark, "audit"), scratch_path(spark, "rej")
    batch = spark.createDataFrame([env_row("1", "created", 0, 0, 1), ("k", "{bad", 0, 2, T0),
                                   env_row("2", "activated", 5, 0, 3)], schemas.ENVELOPE)
    handle = S.audit_batch_handler(audit, rej)
    handle(batch, 7)
    handle(batch, 7)  # the same micro-batch again, as after a failure before the commit
    assert sorted(r.event_id for r in lake.read_audit(spark, audit).collect()) == ["1", "2"]
    assert spark.read.parquet(rej).count() == 1


def test_defaulted_time_flag_and_only_missing_warming(spark):
    # Q5: junk occurred_at -> ingest time, flagged
    batch = spark.createDataFrame([
        ("t:s:e:v1", json.dumps({"event_id": "1", "action": "created", "tenant": "t", "service": "s", "env": "e",
                                 "version": "v1", "occurred_at": "yesterday"}), 0, 1, T0)], schemas.ENVELOPE)
    rows = H.to_audit_rows(H.split_valid(H.parse_envelope(batch))[0]).collect()
    assert rows[0].occurred_at == T0 and rows[0].occurred_at_defaulted is True
    # Q20: only_missing keeps a live entry, refills an expired one
    cache = spark.createDataFrame([("route:t:s:e:v1", "http://cached", False, T0 + dt.timedelta(seconds=30)),
                                   ("route:t:s:e:v2", "http://old", False, T0 - dt.timedelta(seconds=1))],
                                  schemas.CACHE)
    ev = H.split_valid(H.parse_envelope(spark.createDataFrame(
        [env_row("1", "created", 0, 0, 1), env_row("2", "created", 0, 0, 2, route=("t", "s", "e", "v2"))],
        schemas.ENVELOPE)))[0]
    routes = spark.createDataFrame([("t", "s", "e", "v1", "http://fresh1", True), ("t", "s", "e", "v2", "http://fresh2", True)],
                                   "tenant string, service string, env string, version string, url string, is_active boolean")
    got = {r.route_key: r.url for r in H.warm(cache, ev, routes, only_missing=True).collect()}
    assert got == {"route:t:s:e:v1": "http://cached", "route:t:s:e:v2": "http://fresh2"}
    full = {r.route_key: r.url for r in H.warm(cache, ev, routes).collect()}
    assert full == {"route:t:s:e:v1": "http://fresh1", "route:t:s:e:v2": "http://fresh2"}


def test_published_events_are_consumed_in_order(spark):
    topic, audit, rej, ck = (scratch_path(spark, n) for n in ("topic", "audit", "rej", "ck"))
    for k, action in enumerate(("created", "deactivated")):
        key, value, *_ = env_row(str(k), action, k, 0, 0)
        S.publish_route_events(spark.createDataFrame([(key, value)], "key string, value string"), path=topic)
    rows = spark.read.schema(schemas.ENVELOPE).parquet(topic).orderBy("offset").collect()
    assert [json.loads(r.value)["action"] for r in rows] == ["created", "deactivated"] and len({r.partition for r in rows}) == 1
    S.run(S.audit_log_query(S.read_route_stream(spark, topic), audit, rej, ck))
    assert sorted(r.event_id for r in lake.read_audit(spark, audit).collect()) == ["0", "1"]


def test_streams_that_begin_again_lose_nothing(spark):
    """A batch job, a stream, the stream with a new checkpoint, a job in between and the first checkpoint again."""
    src, audit, rej, ck, ck2, cache_path, state = (scratch_path(spark, n) for n in ("src", "audit", "rej", "ck", "ck2", "cache", "state"))
    routes = spark.createDataFrame([("t", "s", "e", "v1", "http://fresh", True)],
                                   "tenant string, service string, env string, version string, url string, is_active boolean")

    def job(*eids):
        batch = spark.createDataFrame([env_row(e, "created", 0, 7, i) for i, e in enumerate(eids)], schemas.ENVELOPE)
        H.append_audit(spark, H.to_audit_rows(H.split_valid(H.parse_envelope(batch))[0]), audit)

    def stream(checkpoint):
        S.run(S.audit_log_query(S.read_route_stream(spark, src), audit, rej, checkpoint, compact_every=2))

    def stored():
        return sorted(r.event_id for r in lake.read_audit(spark, audit).collect())

    job("h1", "h2")
    write_batch(spark, src, [env_row("1", "created", 0, 0, 1), env_row("h2", "created", 0, 0, 2)])
    stream(ck)
    assert stored() == ["1", "h1", "h2"]                      # the stream's batch 0 is not the job's
    write_batch(spark, src, [env_row("2", "created", 9, 0, 3)])
    stream(ck2)                                               # from the beginning, as batch 0 again
    assert stored() == ["1", "2", "h1", "h2"]
    job("h3")
    write_batch(spark, src, [env_row("3", "created", 19, 0, 4)])
    stream(ck2)
    stream(ck)
    assert stored() == ["1", "2", "3", "h1", "h2", "h3"]

    # the newest change of a key is the one written last, whichever checkpoint wrote it
    ck, ck2 = scratch_path(spark, "ck"), scratch_path(spark, "ck2")
    S.run(S.cache_query(S.read_route_stream(spark, src), cache_path, lambda s: routes, ck, warm=False))
    assert H.read_cache(spark, cache_path).isEmpty()
    S.run(S.cache_query(S.read_route_stream(spark, src), cache_path, lambda s: routes, ck2, compact_every=1))
    assert [r.url for r in H.read_cache(spark, cache_path).collect()] == ["http://fresh"]


def test_counters_refuse_another_checkpoint(spark):
    src, out, ck, ck2 = (scratch_path(spark, n) for n in ("src", "out", "ck", "ck2"))
    keys = ["window_start", "action"]
    write_batch(spark, src, [env_row("1", "created", 0, 0, 1)])
    S.run(S.counter_query(S.read_route_stream(spark, src), S.event_counters, keys, out, ck))
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        S.run(S.counter_query(S.read_route_stream(spark, src), S.event_counters, keys, out, ck2))
    write_batch(spark, src, [env_row("2", "created", 1, 0, 2)])
    S.run(S.counter_query(S.read_route_stream(spark, src), S.event_counters, keys, out, ck))
    assert [r["count"] for r in S.read_counters(spark, out, keys, COUNTS).collect()] == [2]


def test_batch_numbers_of_writers(spark):
    path = scratch_path(spark, "numbers")

    def write(writer, batch_id):
        n = folds.number_of(spark, path, writer, batch_id)
        folds.append(spark.createDataFrame([(writer, n)], "k string, n long"), path, n)
        return n

    assert [write("a", 0), write("a", 1), write("a", 1)] == [0, 1, 1]
    assert folds.number_of(spark, path, "b", 0) == 2          # and dies before it writes
    assert [write("c", 0), write("a", 1), write("a", 2), write("b", 0)] == [2, 1, 3, 4]
    assert [write("a", 2), write("a", 3), write("c", 0)] == [3, 5, 2]
    assert folds.read(spark, path, "k string, n long").count() == 6
