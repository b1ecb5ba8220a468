"""Catalog writes (2.4) as snapshot operators, and data-quality checks.

Parquet has no MERGE: every write returns a *new* snapshot DataFrame that the caller
writes to a fresh folder (see ``sources.lake``). Only touched keys are recomputed;
untouched rows pass through a ``left_anti`` join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X

ROUTE = list(X.ROUTE_COLS)
EP_KEY = ["environment_id", "version"]
EP_COLS = ["id", "environment_id", "version", "url", "is_active", "created_at", "updated_at"]


def fold_endpoint_writes(writes: DataFrame) -> DataFrame:
    """Fold repeated upserts of (environment_id, version): the first write keeps id and
    created_at (ON CONFLICT keeps them), the newest by (updated_at, id) sets the rest.
    min/max over structs aggregate partially on the map side, so a hot key never reaches
    one task whole."""
    g = writes.groupBy(*EP_KEY).agg(
        F.min(F.struct("updated_at", "id", "created_at")).alias("f"),
        F.max(F.struct("updated_at", "id", "url", "is_active")).alias("l"))
    return g.select(F.col("f.id").alias("id"), *EP_KEY, F.col("l.url").alias("url"),
                    F.col("l.is_active").alias("is_active"), F.col("f.created_at").alias("created_at"),
                    F.col("l.updated_at").alias("updated_at"))


def dense_index(df: DataFrame, order_cols, out: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """0-based position of every row in the global order of ``order_cols`` (ties broken by
    the full column list), without a single-partition window: the rows are range-partitioned,
    sorted and written once with their partition and position, then every partition adds the
    row count of all earlier ones. Both steps read the written copy, so they see the same
    partitions. The offsets have one row per partition."""
    from ..sources.lake import cut_lineage
    spark = df.sparkSession
    order = list(order_cols) + [c for c in df.columns if c not in order_cols]
    # an explicit partition count is never coalesced by AQE, so partition ids are stable
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
             .withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()))
    local = cut_lineage(spark, local, "numbered")
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    # monotonically_increasing_id = (partition id << 33) + position inside the partition
    pos = F.col("_mono") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return local.join(offs, "_pid").withColumn(out, F.col("_off") + pos).drop("_pid", "_mono", "_off")


def get_or_create(existing: DataFrame, wanted: DataFrame, keys, name_col: str = "name") -> DataFrame:
    """Insert-if-absent for a name table. Returns the full table: existing rows plus new
    rows with ids ``max(id) + 1 ...`` in key order (repeatable)."""
    keys = list(keys)
    w = wanted.select(*keys).filter(X.all_present(*keys)).dropDuplicates(keys)
    new = w.join(existing.select(*keys), keys, "left_anti")
    max_id = existing.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    new_rows = dense_index(new, keys).select((max_id + F.col("idx") + 1).alias("id"), *keys)
    return existing.select("id", *keys).unionByName(new_rows)


def get_or_create_tenant(tenants: DataFrame, wanted: DataFrame) -> DataFrame:
    return get_or_create(tenants, wanted.select(F.col("tenant").alias("name")), ["name"])


def get_or_create_service(services: DataFrame, tenants: DataFrame, wanted: DataFrame) -> DataFrame:
    w = wanted.select(F.col("tenant"), F.col("service").alias("name")).join(
        tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant")), "tenant")
    return get_or_create(services, w, ["tenant_id", "name"])


def get_or_create_environment(environments: DataFrame, services: DataFrame, tenants: DataFrame,
                              wanted: DataFrame) -> DataFrame:
    t = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant"))
    s = services.select(F.col("id").alias("service_id"), "tenant_id", F.col("name").alias("service"))
    w = (wanted.select("tenant", "service", F.col("env").alias("name"))
         .join(t, "tenant").join(s, ["tenant_id", "service"]))
    return get_or_create(environments, w, ["service_id", "name"])


def _touched(endpoints: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per changed key: ``c`` (its last change by seq), ``first`` (its first seq) and ``old_id`` (null for a new key)."""
    last = changes.groupBy(*EP_KEY).agg(F.max(F.struct("seq", "url", "is_active", "updated_at")).alias("c"), F.min("seq").alias("first"))
    return last.join(endpoints.select(*EP_KEY, F.col("id").alias("old_id")), EP_KEY, "left")


def _written_over(endpoints: DataFrame, touched: DataFrame, max_id: int) -> DataFrame:
    """The snapshot with the touched keys' changes: one left join for the rows that are there, new ones are numbered."""
    hit = F.col("c").isNotNull()
    kept = endpoints.select(*EP_COLS).join(touched.filter("old_id IS NOT NULL").select(*EP_KEY, "c"), EP_KEY, "left").select(
        "id", *EP_KEY, *[F.when(hit, F.col(f"c.{c}")).otherwise(F.col(c)).alias(c) for c in ("url", "is_active")], "created_at",
        F.when(hit, F.col("c.updated_at")).otherwise(F.col("updated_at")).alias("updated_at"))
    ins = touched.filter("old_id IS NULL").select(*EP_KEY, "c.url", "c.is_active", "c.updated_at")
    ins = dense_index(ins, EP_KEY).select((max_id + F.col("idx") + 1).alias("id"), *EP_KEY, "url", "is_active",
                                          F.col("updated_at").alias("created_at"), "updated_at")
    return kept.unionByName(ins)


def _max_ids(*tables: DataFrame) -> list[int]:
    """The largest id of every table (0 if there is none), in one job."""
    each = [t.agg(F.max("id").cast("long").alias("id")).select(F.lit(i).alias("i"), "id") for i, t in enumerate(tables)]
    found = {r["i"]: r["id"] or 0 for r in reduce(lambda a, b: a.unionByName(b), each).collect()}
    return [found[i] for i in range(len(tables))]


def upsert_endpoint(endpoints: DataFrame, changes: DataFrame) -> DataFrame:
    """INSERT ... ON CONFLICT (environment_id, version) DO UPDATE as a new snapshot.

    ``changes``: environment_id, version, url, is_active, updated_at, seq. Repeated keys in
    the change set: the highest ``seq`` wins. Existing rows keep id and created_at."""
    from ..sources.lake import cut_lineage
    touched = cut_lineage(endpoints.sparkSession, _touched(endpoints, changes), "touched")
    return _written_over(endpoints, touched, _max_ids(endpoints)[0])


def validate_route_writes(df: DataFrame, need_url: bool):
    """Split a write batch into (valid, rejects) on the reference's falsy checks (Q1)."""
    ok = X.all_present(*ROUTE)
    reason = F.when(~ok, F.lit("missing_field"))
    if need_url:
        url_ok = F.col("url").isNotNull() & (F.trim(F.col("url")) != "")
        reason = reason.when(~url_ok, F.lit("missing_url"))
    d = df.withColumn("reject_reason", reason)
    return (d.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            d.filter(F.col("reject_reason").isNotNull()))


def _route_ids(tenants, services, environments) -> DataFrame:
    t = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant"))
    s = services.select(F.col("id").alias("service_id"), "tenant_id", F.col("name").alias("service"))
    e = environments.select(F.col("id").alias("environment_id"), "service_id", F.col("name").alias("env"))
    return e.join(s, "service_id").join(t, "tenant_id")


def _ids_for(batch: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the environment ids a write batch names."""
    names = batch.select(*ROUTE[:3]).distinct()
    return ids.join(names, ROUTE[:3], "left_semi")


def _event_rows(df: DataFrame, action_col, as_of, *more) -> DataFrame:
    """Change events of applied writes, with further columns ``more``; ids repeatable from (seq, action)."""
    seed = F.concat_ws("|", F.col("seq").cast("string"), action_col)
    return df.select(
        X.new_event_id(seed).alias("event_id"),
        F.lit(X.DEFAULT_EVENT_TYPE).alias("event_type"),
        action_col.alias("action"), *ROUTE, "url",
        F.lit(as_of).cast("timestamp").alias("occurred_at"), "seq", *more)


def number_names(named: DataFrame, tenants_to: int, services_to: int, environments_to: int) -> DataFrame:
    """Ids of three levels of names in one pass.

    ``named``: distinct (tenant, service, env) with the ids that exist (tenant_id, service_id, environment_id,
    else null); the numbers are the largest ids so far. Returns the rows with all ids, and new_tenant,
    new_service, new_environment on one row for each new name. New ids go by (parent id, name), as if the
    levels were filled one after the other.

    All three orders are one: existing parents come by their ids, new ones after them by their names. So the
    rows are range-partitioned, sorted and written once; a name is new where it differs from the row
    before, and its number is the count of new names up to it: counted within each partition, plus those of
    the partitions before (a table of one row per partition)."""
    from ..sources.lake import cut_lineage
    spark = named.sparkSession
    end = F.lit((1 << 63) - 1)
    order = [F.coalesce("service_id", end), F.coalesce("tenant_id", end), F.col("tenant"), F.col("service"), F.col("env")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(spark, named.repartitionByRange(n, *order).sortWithinPartitions(*order)
                         .withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()), "names")
    name = F.struct("tenant", "service")
    ends = placed.groupBy("_pid").agg(F.max_by(name, "_mono").alias("_last"))
    ends = ends.select("_pid", F.lag("_last").over(Window.orderBy("_pid")).alias("_end"))
    within = Window.partitionBy("_pid").orderBy("_mono")
    d = placed.join(ends, "_pid").withColumn("_prev", F.coalesce(F.lag(name).over(within), "_end"))
    d = d.withColumns({
        "new_tenant": F.col("tenant_id").isNull() & ~F.col("tenant").eqNullSafe(F.col("_prev.tenant")),
        "new_service": F.col("service_id").isNull() & ~name.eqNullSafe(F.col("_prev")),
        "new_environment": F.col("environment_id").isNull()})
    flags = ["new_tenant", "new_service", "new_environment"]
    sums = d.groupBy("_pid").agg(*[F.sum(F.col(f).cast("long")).alias(f"_{f}") for f in flags])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_pid", *[F.coalesce(F.sum(f"_{f}").over(before), F.lit(0)).alias(f"_{f}") for f in flags])
    d = d.join(sums, "_pid")
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ids = {"tenant_id": ("new_tenant", tenants_to), "service_id": ("new_service", services_to), "environment_id": ("new_environment", environments_to)}
    return d.select("tenant", "service", "env", *flags, *[
        F.coalesce(c, F.lit(top) + F.col(f"_{f}") + F.sum(F.col(f).cast("long")).over(so_far)).alias(c) for c, (f, top) in ids.items()])


def catalog_create_routes(tenants, services, environments, endpoints, requests: DataFrame, as_of):
    """create_route over a batch: validate -> ids of all three name levels -> upsert (always active,
    Q11) -> events. Returns a dict of DataFrames.

    The name tables and the endpoints are joined once each to what the batch names (written, and small beside
    them) and asked once for their largest ids; the snapshots that are returned are their rows plus the new ones."""
    from ..sources.lake import cut_lineage
    spark = requests.sparkSession
    valid, rejects = validate_route_writes(requests, need_url=True)
    valid = cut_lineage(spark, valid, "create-batch")
    t = tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant"))
    s = services.select(F.col("id").alias("service_id"), "tenant_id", F.col("name").alias("service"))
    e = environments.select(F.col("id").alias("environment_id"), "service_id", F.col("name").alias("env"))
    named = (valid.select(*ROUTE[:3]).distinct().join(t, "tenant", "left").join(s, ["tenant_id", "service"], "left")
             .join(e, ["service_id", "env"], "left"))
    *tops, last_endpoint = _max_ids(tenants, services, environments, endpoints)
    names = cut_lineage(spark, number_names(cut_lineage(spark, named, "named"), *tops), "ids")

    def with_new(table, level: str, *parent):
        new = names.filter(f"new_{level}").select(F.col(f"{level}_id").alias("id"), *parent, F.col("env" if level == "environment" else level).alias("name"))
        return table.select("id", *parent, "name").unionByName(new)
    t2, s2 = with_new(tenants, "tenant"), with_new(services, "service", "tenant_id")
    e2 = with_new(environments, "environment", "service_id")

    ts = F.lit(as_of).cast("timestamp")
    v = valid.join(names.select(*ROUTE[:3], "environment_id"), ROUTE[:3])
    changes = v.select(*EP_KEY, "url", F.lit(True).alias("is_active"), ts.alias("updated_at"), "seq")
    touched = cut_lineage(spark, _touched(endpoints, changes), "touched")
    ep2 = _written_over(endpoints, touched, last_endpoint)
    # an update when the key existed before the batch or an earlier create of the batch made it
    v = v.join(touched.select(*EP_KEY, "first", "old_id"), EP_KEY)
    was = F.col("old_id").isNotNull() | (F.col("seq") > F.col("first"))
    events = _event_rows(v, F.lit("created"), as_of, was.alias("was_update"))
    return {"tenants": t2, "services": s2, "environments": e2, "endpoints": ep2,
            "events": events, "rejects": rejects}


def set_active(tenants, services, environments, endpoints, requests: DataFrame, active: bool, as_of):
    """activate_route / deactivate_route over a batch. Missing routes go to rejects (Q12);
    a no-op change still bumps updated_at."""
    valid, rejects = validate_route_writes(requests, need_url=False)
    ids = _ids_for(valid, _route_ids(tenants, services, environments).select("environment_id", *ROUTE[:3]))
    keyed = valid.join(ids, ROUTE[:3], "left")
    ep = endpoints.select(*EP_KEY, F.col("url").alias("_ep_url"))
    found = ep.join(keyed.drop(*[c for c in ("url",) if c in keyed.columns]), EP_KEY) \
        .withColumnRenamed("_ep_url", "url")
    nf = (keyed.join(found.select("seq"), "seq", "left_anti").select(*requests.columns)
          .withColumn("reject_reason", F.lit("not_found")))
    ts = F.lit(as_of).cast("timestamp")
    changes = found.select(*EP_KEY, "url", F.lit(active).alias("is_active"), ts.alias("updated_at"), "seq")
    ep2 = upsert_endpoint(endpoints, changes)
    action = F.lit("activated" if active else "deactivated")
    return {"endpoints": ep2, "events": _event_rows(found, action, as_of),
            "rejects": rejects.unionByName(nf)}


def activate_routes(tenants, services, environments, endpoints, requests, as_of):
    return set_active(tenants, services, environments, endpoints, requests, True, as_of)


def deactivate_routes(tenants, services, environments, endpoints, requests, as_of):
    return set_active(tenants, services, environments, endpoints, requests, False, as_of)


OP_ACTION = {"create": "created", "activate": "activated", "deactivate": "deactivated"}


def apply_change_log(routes: DataFrame, change_log: DataFrame, as_of):
    """Apply an ordered mixed batch of create/activate/deactivate per route key.

    ``routes``: the current route table (names, url, is_active). Rejects: a missing name, an
    op that is none of the three, a create without URL, and an activate or deactivate of a
    route that neither exists before the batch nor was created earlier in it. Result per key from partial aggregates (no per-key sort)."""
    from ..sources.lake import cut_lineage
    # the batch is read by five branches below: write it once to the shared folder
    change_log = cut_lineage(change_log.sparkSession, change_log, "change-batch")
    known = F.coalesce(F.col("op").isin(*OP_ACTION), F.lit(False))
    cl, no_url = validate_route_writes(change_log.filter(known & (F.col("op") == "create")), need_url=True)
    others, no_name = validate_route_writes(change_log.filter(known & (F.col("op") != "create")), need_url=False)
    cl = cl.unionByName(others)
    bad = no_url.unionByName(no_name).unionByName(change_log.filter(~known).withColumn("reject_reason", F.lit("unknown_op")))
    # one aggregate per key, joined once to the route table
    per_key = cl.groupBy(*ROUTE).agg(
        F.max(F.struct("seq", "op")).alias("last"),
        F.max(F.when(F.col("op") == "create", F.struct("seq", "url"))).alias("last_create"),
        F.min(F.when(F.col("op") == "create", F.col("seq"))).alias("first_create"),
        F.count(F.lit(1)).alias("n"))
    cur = per_key.join(routes.select(*ROUTE, F.col("url").alias("cur_url"), F.lit(True).alias("existed")), ROUTE, "left")
    cur = cut_lineage(change_log.sparkSession, cur, "touched-routes")
    # a new route has nothing to change before its first create
    tagged = cl.join(cur.select(*ROUTE, "first_create", "existed"), ROUTE)
    applied_c = F.coalesce(F.col("existed"), F.lit(False)) | F.coalesce(F.col("seq") >= F.col("first_create"), F.lit(False))
    applied, early = tagged.filter(applied_c), tagged.filter(~applied_c)
    rejects = early.select(*change_log.columns).withColumn("reject_reason", F.lit("not_found")).unionByName(bad)
    fresh = cur.filter("existed IS NULL").select(*ROUTE, "first_create")
    too_early = (cl.join(fresh, ROUTE).filter(~F.coalesce(F.col("seq") >= F.col("first_create"), F.lit(False)))
                 .groupBy(*ROUTE).agg(F.count(F.lit(1)).alias("early")))
    # where any op applies, the last one does: no op comes after the last and before the first create
    state = cur.filter("existed IS NOT NULL OR first_create IS NOT NULL").join(too_early, ROUTE, "left").select(
        *ROUTE,
        F.coalesce(F.col("last_create.url"), F.col("cur_url")).alias("url"),
        (F.col("last.op") != "deactivate").alias("is_active"),
        F.col("cur_url").isNull().alias("is_new"),
        (F.col("n") - F.coalesce("early", F.lit(0))).alias("n_ops"),
        F.lit(as_of).cast("timestamp").alias("updated_at"))
    action = F.coalesce(*[F.when(F.col("op") == k, F.lit(v)) for k, v in OP_ACTION.items()])
    ev = applied.withColumn("url", F.when(F.col("op") == "create", F.col("url")))
    events = _event_rows(ev, action, as_of)
    return {"state": state, "events": events, "rejects": rejects}


def write_counters(events: DataFrame, rejects: DataFrame) -> DataFrame:
    """writes_total / success / failure; each failed write counted once (Q21)."""
    u = (events.select(F.lit(1).alias("ok"), F.lit(0).alias("bad"))
         .unionByName(rejects.select(F.lit(0).alias("ok"), F.lit(1).alias("bad"))))
    return u.agg(F.count(F.lit(1)).alias("writes_total"),
                 F.coalesce(F.sum("ok"), F.lit(0)).cast("long").alias("writes_success"),
                 F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("writes_failure"))


# ------------------------------------------------------------------ data quality
def dq_unique_violations(df: DataFrame, keys, table: str) -> DataFrame:
    keys = list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
            .select(F.lit(table).alias("table_name"),
                    F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("dup_key"), "n_rows"))


def dq_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, table: str) -> DataFrame:
    p = parent.select(F.col(pk).alias(fk)).dropDuplicates([fk])
    return (child.filter(F.col(fk).isNotNull()).join(p, fk, "left_anti")
            .select(F.lit(table).alias("table_name"), F.col("id").cast("long").alias("row_id"),
                    F.col(fk).cast("long").alias("missing_parent")))


def dq_check_violations(df: DataFrame, table: str, not_null=(), enums: dict | None = None) -> DataFrame:
    """One row per (table, column, rule) with the violating-row count (a single scan)."""
    aggs, labels = [], []
    for c in not_null:
        aggs.append(F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long"))
        labels.append((c, "not_null"))
    for c, allowed in (enums or {}).items():
        aggs.append(F.sum(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), 1).otherwise(0)).cast("long"))
        labels.append((c, "enum"))
    row = df.agg(*[a.alias(f"v{i}") for i, a in enumerate(aggs)])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"),
                                         F.coalesce(F.col(f"v{i}"), F.lit(0)).alias("violations"))
                                for i, (c, r) in enumerate(labels)]))
    return row.select(stack.alias("s")).select(F.lit(table).alias("table_name"), "s.*")


def audit_retention(audit: DataFrame, as_of, days: int = 365) -> DataFrame:
    """Rows a 365-day TTL index keeps. The date-partition bound is added beside the
    timestamp bound so whole partitions are pruned at the scan."""
    cut = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    cond = F.col("occurred_at") >= cut
    if "event_date" in audit.columns:
        cond = cond & (F.col("event_date") >= F.to_date(cut))
    return audit.filter(cond)


def union_all(dfs):
    return reduce(lambda a, b: a.unionByName(b), dfs)
