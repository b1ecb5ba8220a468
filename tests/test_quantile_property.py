"""Distributed exact quantiles vs Python's statistics, per group, on generated data."""

import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from routelake.operators import metrics as M
from routelake.operators import quantiles as Q

values = st.one_of(st.integers(-5, 5).map(float),
                   st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False),
                   st.sampled_from([0.0, 1e-9, 2.5, 2.5, 1e12]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(groups=st.dictionaries(st.sampled_from(["a", "b", "c"]), st.lists(values, min_size=1, max_size=260),
                              min_size=1))
def test_grouped_quantiles_match_statistics(spark, groups):
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, elapsed_ms double")
    got = {r.g: r for r in M.latency_quantile_exclusive(df, ["g"]).collect()}
    med = {r.g: r.m for r in Q.quantile_report(df, ["g"], "elapsed_ms", [("median", "m")]).collect()}
    for g, vs in groups.items():
        p95 = statistics.quantiles(vs, n=20)[18] if len(vs) > 20 else max(vs)
        p99 = statistics.quantiles(vs, n=100)[98] if len(vs) > 100 else max(vs)
        tol = 1e-9 * max(1.0, max(abs(v) for v in vs))
        assert abs(got[g].p95_ms - p95) <= tol
        assert abs(got[g].p99_ms - p99) <= tol
        assert abs(med[g] - statistics.median(vs)) <= tol
