"""Time filters over the written audit table prune date folders and push down to parquet."""

from routelake.operators import audit as A
from routelake.sources import lake
from routelake.sources.tables import Tables


def test_time_range_prunes_partitions_and_pushes_filters(spark, sf_dir):
    t = Tables(spark, sf_dir)
    path = lake.write_audit(spark, t.audit)
    a = lake.read_audit(spark, path)
    q = A.events_in_time_range(a, "2024-01-10 00:00:00", "2024-01-12 12:00:00", env="prod", limit=50)
    plan = q._jdf.queryExecution().executedPlan().toString()
    import re
    part = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert ">= 2024-01-10" in part and "<= 2024-01-12" in part       # date folders pruned
    pushed = re.search(r"PushedFilters: \[([^\]]*)", plan).group(1)
    assert "GreaterThanOrEqual(occurred_at" in pushed and "route.env" in pushed  # to parquet
    got = q.collect()
    assert 0 < len(got) <= 50 and all(r.route.env == "prod" for r in got)
