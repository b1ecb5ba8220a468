"""Tasks of the stream queries stay small when the topic, or one of its partitions, is long."""

import datetime as dt

from pyspark.sql import functions as F

from routelake import schemas
from routelake.plans import q_streams
from routelake.session import scratch_path
from routelake.sources import lake
from routelake.sources.tables import Tables
from routelake.streaming import handlers as H
from routelake.streaming import streams as S

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def events_folder(spark, tmp_path, rows):
    d = str(tmp_path / "sf")
    (spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
     .withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{d}/events.parquet"))
    return d


def test_envelope_files_split_a_long_partition(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_streams, "ROWS_PER_FILE", 100, raising=False)
    rows = [(i, T0 + dt.timedelta(seconds=i), 4 * (i % 7), ("signup", "click")[i % 2], 1.0, '{"k": 1}') for i in range(1000)]   # partition 0 only
    rows += [(None, None, None, None, None, None), (5, T0, 0, "view", 1.0, None), (5, T0, 0, "view", 1.0, None)]
    t = Tables(spark, events_folder(spark, tmp_path, rows))
    path = q_streams.envelope_files(spark, t)
    read = spark.read.schema(schemas.ENVELOPE).parquet(path)
    assert read.exceptAll(t.stream_values).isEmpty() and t.stream_values.exceptAll(read).isEmpty()
    files = {}
    for r in read.withColumn("f", F.input_file_name()).collect():
        files.setdefault(r.f, []).append((r.partition is not None, r.partition, r.offset))
    assert len(files) > 5 and max(map(len, files.values())) <= 300
    assert all(f == sorted(f) for f in files.values())
    ranges = sorted((f[0], f[-1]) for f in files.values())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_micro_batches_are_spread_before_sorting_aggregates(spark, monkeypatch):
    body = '{"event_id":"%s","event_type":"route_changed","action":"created","tenant":"t","service":"s","env":"e","version":"v1","url":"u%d"}'
    rows = [("k", body % ("same" if i < 500 else i, i), 0, i, T0 + dt.timedelta(seconds=i)) for i in range(800)]
    rows += [("k", body % ("null", -1), None, None, None), ("k", "{broken", 0, 900, T0)]
    src, audit, rejects, state, ck1, ck2 = (scratch_path(spark, n) for n in ("src", "audit", "rej", "state", "ck1", "ck2"))
    spark.createDataFrame(rows, schemas.ENVELOPE).coalesce(1).write.parquet(src)
    sizes = {}

    def spied(module, name):
        real = getattr(module, name)

        def call(df):
            sizes.setdefault(name, [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
            return real(df)
        monkeypatch.setattr(module, name, call)
    spied(H, "first_per_event_id")
    spied(S, "_newest_event")
    S.run(S.audit_log_query(S.read_route_stream(spark, src), audit, rejects, ck1))
    S.run(S.key_order_query(S.read_route_stream(spark, src), state, ck2))
    for counts in (sizes["first_per_event_id"], sizes["_newest_event"]):
        assert sum(counts) == 801 and max(counts) <= 250
    stored = {r.event_id: r.url for r in lake.read_audit(spark, audit).collect()}
    assert stored == {"same": "u0", "null": "u-1", **{str(i): f"u{i}" for i in range(500, 800)}}
    assert spark.read.parquet(rejects).count() == 1
    assert [r.url for r in S.read_key_state(spark, state).collect()] == ["u799"]
