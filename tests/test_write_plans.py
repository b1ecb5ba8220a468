"""A small write batch against a table: the batch is broadcast from its measured size, without
any hint or eager count of the library's own."""

from pyspark.sql import functions as F

from routelake.operators import dml as D
from routelake.sources import lake
from routelake.sources.tables import Tables


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_upsert_probes_the_snapshot(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ep = lake.cut_lineage(spark, t.endpoints, "endpoints")
    changes = (ep.limit(20).select("environment_id", "version", F.concat("url", F.lit("?new")).alias("url"),
                                   F.lit(True).alias("is_active"), F.col("updated_at"), F.col("id").alias("seq"))
               .unionByName(ep.limit(1).select((F.col("environment_id") + 10**9).alias("environment_id"),
                                               "version", "url", F.lit(True).alias("is_active"), "updated_at",
                                               F.lit(0).cast("long").alias("seq"))))
    changes = lake.cut_lineage(spark, changes, "changes")
    out = D.upsert_endpoint(ep, changes)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ResolvedHint") == 0
    plan = _plan(out).split("+- == Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    old = {r.id: r for r in ep.collect()}
    new = {r.id: r for r in out.collect()}
    assert len(new) == len(old) + 1 and sum(r.url.endswith("?new") for r in new.values()) == 20
    assert all(new[i].created_at == r.created_at for i, r in old.items())




def test_ids_of_three_levels_equal_level_by_level_creation(spark):
    """Many names over several partitions, some of them known: the one pass numbers them as get-or-create does."""
    import random
    rnd = random.Random(5)
    tenants = spark.createDataFrame([(3, "t3"), (9, "t1")], "id long, name string")
    services = spark.createDataFrame([(4, 3, "s0"), (6, 9, "s2")], "id long, tenant_id long, name string")
    environments = spark.createDataFrame([(2, 4, "e1"), (5, 6, "e0")], "id long, service_id long, name string")
    endpoints = spark.createDataFrame([(7, 2, "v0", "http://old", False, None, None)],
                                      "id long, environment_id long, version string, url string, is_active boolean, created_at timestamp, updated_at timestamp")
    rows = [(k, f"t{rnd.randrange(6)}", f"s{rnd.randrange(4)}", f"e{rnd.randrange(3)}", f"v{rnd.randrange(3)}", f"http://{k}") for k in range(300)]
    rows += [(400 + k, "hot", "hot", f"e{k:03}", "v1", "http://h") for k in range(150)]      # one service with many environments
    batch = spark.createDataFrame(rows, "seq long, tenant string, service string, env string, version string, url string").repartition(5)
    got = D.catalog_create_routes(tenants, services, environments, endpoints, batch, "2024-02-01 00:00:00")
    t2 = D.get_or_create_tenant(tenants, batch)
    s2 = D.get_or_create_service(services, t2, batch)
    e2 = D.get_or_create_environment(environments, s2, t2, batch)
    for name, want in (("tenants", t2), ("services", s2), ("environments", e2)):
        assert sorted(map(tuple, got[name].collect())) == sorted(map(tuple, want.collect())), name
    assert got["endpoints"].count() == len({r[1:5] for r in rows} | {("t3", "s0", "e1", "v0")})
    assert got["events"].filter("NOT was_update").count() == got["endpoints"].count() - 1


def test_create_path_snapshot_reads_the_endpoints_once(spark, tmp_path):
    """Once the ids are found, the snapshot reads the endpoints once and the name tables not at all."""
    tables = {}
    for name, rows, schema in (("tenants", [(1, "t")], "id long, name string"), ("services", [(1, 1, "s")], "id long, tenant_id long, name string"),
                               ("environments", [(1, 1, "e")], "id long, service_id long, name string"),
                               ("endpoints", [(1, 1, "v", "u", True, None, None)],
                                "id long, environment_id long, version string, url string, is_active boolean, created_at timestamp, updated_at timestamp")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    batch = spark.createDataFrame([(1, "t", "s2", "e", "v", "u"), (2, "t", "s", "e", "v", "u2")],
                                  "seq long, tenant string, service string, env string, version string, url string")
    got = D.catalog_create_routes(*tables.values(), batch, "2024-02-01 00:00:00")
    plan = got["endpoints"]._jdf.queryExecution().optimizedPlan().toString()
    relations = [line for line in plan.splitlines() if "Relation [" in line]
    assert sum("created_at" in line for line in relations) == 1                  # the endpoints themselves
    assert not any("name#" in line for line in relations)                       # no name table: their ids are written already
    assert {(r.environment_id, r.version, r.url) for r in got["endpoints"].collect()} == {(1, "v", "u2"), (2, "v", "u")}
