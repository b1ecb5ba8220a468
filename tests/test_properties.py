"""Properties over the fixture tables (sf0.001)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from routelake.functions import expr as X
from routelake.operators import audit as A
from routelake.operators import dml as D
from routelake.operators import metrics as M
from routelake.operators import resilience as RS
from routelake.session import scratch_path
from routelake.sources import lake
from routelake.sources.tables import CATALOG_AS_OF, Tables
from routelake.streaming import streams as S

EP = ["id", "environment_id", "version", "url", "is_active", "created_at", "updated_at"]


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upsert_twice_equals_once(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ch = t.endpoint_writes.select("environment_id", "version", F.concat("url", F.lit("?v2")).alias("url"),
                                  F.lit(True).alias("is_active"), F.lit(CATALOG_AS_OF).cast("timestamp").alias("updated_at"),
                                  F.col("id").alias("seq"))
    once = lake.cut_lineage(spark, D.upsert_endpoint(t.endpoints, ch), "once")
    twice = D.upsert_endpoint(once, ch)
    assert _rows(once, EP) == _rows(twice, EP)
    assert once.count() == t.endpoints.count()


def test_cumulative_buckets_non_decreasing(spark, sf_dir):
    h = M.latency_histogram(Tables(spark, sf_dir).request_log)
    w = Window.partitionBy("method", "endpoint").orderBy("le")
    bad = h.withColumn("p", F.lag("bucket_count").over(w)).filter(F.col("bucket_count") < F.col("p")).count()
    assert bad == 0
    inf = h.filter(F.col("le") == float("inf")).filter(F.col("bucket_count") != F.col("count")).count()
    assert inf == 0


def test_in_flight_never_negative_and_zero_at_end(spark, sf_dir):
    p = RS.concurrency_profile(Tables(spark, sf_dir).operation_spans, RS.bulkhead_limits(spark))
    assert p.filter(F.col("in_flight") < 0).count() == 0
    last = p.groupBy("instance", "class").agg(F.max_by("in_flight", F.struct("ts", "delta", "span_id")).alias("f"))
    assert last.filter(F.col("f") != 0).count() == 0


def test_stream_state_equals_batch_state(spark, sf_dir):
    """Latest state per route from the stream (many small batches) = the batch operator."""
    t = Tables(spark, sf_dir)
    src = scratch_path(spark, "events-src")
    t.stream_values.repartition(6).write.parquet(src)
    state, ck = scratch_path(spark, "state"), scratch_path(spark, "ck")
    S.run(S.key_order_query(S.read_route_stream(spark, src, max_files_per_trigger=2), state, ck))
    got = S.read_key_state(spark, state).filter(F.col("action").isin(*X.ACTIONS))
    # batch: newest event by (partition, offset) per route among events with an action
    ev = t.event_rows.filter(F.col("action").isNotNull())
    want = (ev.groupBy(*X.ROUTE_COLS)
            .agg(F.max(F.struct(F.pmod("user_id", F.lit(4)), "event_seq", "action", "url")).alias("l"))
            .select(*X.ROUTE_COLS, F.col("l.action").alias("action"), F.col("l.url").alias("url"))
            .filter(F.col("action").isin(*X.ACTIONS)))
    cols = [*X.ROUTE_COLS, "action", "url"]
    assert _rows(got, cols) == _rows(want, cols)


def test_route_state_as_of_end_equals_latest(spark, sf_dir):
    a = Tables(spark, sf_dir).audit
    cols = [*X.ROUTE_COLS, "last_action", "url", "is_active", "n_changes"]
    assert _rows(A.route_state_as_of(a, "2030-01-01 00:00:00"), cols) == _rows(A.route_state_latest(a), cols)
