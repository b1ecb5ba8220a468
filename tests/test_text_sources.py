"""Exposition-text and application-log parsing on tricky lines."""

import datetime as dt
import math

from routelake.operators import ingest as I


def test_exposition_lines(spark):
    lines = spark.createDataFrame([
        ("# HELP resolve_requests_total Total resolve requests",),
        ("# TYPE resolve_requests_total counter",),
        ('resolve_requests_total{endpoint="/resolve",status="200"} 1027',),
        ('resolve_requests_total{path="a\\"b,c=d"} 3 1700000000000',),       # escaped quote, comma, timestamp
        ("# TYPE resolve_latency_seconds histogram",),
        ('resolve_latency_seconds_bucket{le="+Inf"} +Inf',),
        ("process_up NaN",),
        ("",),
        ("garbage line without value",),
    ], "value string")
    got = I.parse_exposition(lines).collect()
    by = {(r.metric, tuple(sorted((r.labels or {}).items()))): r for r in got}
    assert len(got) == 5
    assert [(r.line, r.value) for r in got if r.reject_reason] == [("garbage line without value", None)]
    r = by[("resolve_requests_total", (("endpoint", "/resolve"), ("status", "200")))]
    assert r.value == 1027.0 and r.type == "counter"
    assert by[("resolve_requests_total", (("path", 'a"b,c=d'),))].value == 3.0
    inf = by[("resolve_latency_seconds_bucket", (("le", "+Inf"),))]
    assert inf.value == float("inf") and inf.type == "histogram"  # family type
    assert math.isnan(by[("process_up", ())].value)


def test_app_log_lines(spark):
    lines = spark.createDataFrame([
        ("2024-01-14 17:30:00,123 - [req-abc123def4567890] - src.service.routing - INFO - Resolved t/s/e/v",),
        ("2024-01-14 17:30:01,000 - [-] - api.app - WARNING - Route not found: a/b/c/d - retry",),
        ("not a log line",),
    ], "value string")
    every = I.parse_app_log(lines).orderBy("ts").collect()
    assert [(r.message, r.reject_reason) for r in every if r.reject_reason] == [("not a log line", "not_a_log_line")]
    rows = [r for r in every if not r.reject_reason]
    assert len(rows) == 2
    assert rows[0].ts == dt.datetime(2024, 1, 14, 17, 30, 0, 123000) and rows[0].correlation_id == "req-abc123def4567890"
    assert rows[0].logger == "src.service.routing" and rows[0].level == "INFO"
    assert rows[1].correlation_id is None and rows[1].message == "Route not found: a/b/c/d - retry"
