"""Fixture views of the reference's data model over the driver's read-only tables.

Mapping (see FIXTURES.md part B): region/nation/customer/orders form the route
catalog, ``events`` drives everything that happens in time. Each property is a
lazily built DataFrame; nothing is collected. Parquet timestamps come in as
``timestamp_ntz`` and are cast to ``timestamp`` (session zone UTC) so that
watermarks and interval arithmetic work.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..session import configure

# Fixed reference times instead of "now" (deterministic results).
EVENTS_AS_OF = "2024-01-31 00:00:00"
CATALOG_AS_OF = "2001-09-01 00:00:00"

CATALOG_SEQ_OFFSET = 1_000_000_000
ACTION_OF_EVENT = {"signup": "created", "purchase": "activated", "error": "deactivated"}
# stream values: "view" carries an action outside the enum, "click" none at all
STREAM_ACTION_OF_EVENT = {**ACTION_OF_EVENT, "view": "viewed"}
OPERATION_OF_EVENT = {"signup": "create", "purchase": "activate", "error": "deactivate"}
DEPENDENCIES = ("database", "redis", "mongodb")
BUDGETS = ("database", "redis", "redis")
CLASSES = ("read", "write", "audit")
ENVS = ("prod", "staging", "dev")


def _case(col, mapping: dict, default=None):
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def _by_mod(col, n: int, values):
    out = None
    for i, v in enumerate(values):
        cond = F.pmod(col, F.lit(n)) == i
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out


def utc_timestamps(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            cols.append(F.col(f.name).cast("timestamp").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


class Tables:
    """All fixture frames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return utc_timestamps(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    # ---------------------------------------------------------------- catalog
    @cached_property
    def tenants(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").cast("long").alias("id"),
                                         F.col("r_name").alias("name"))

    @cached_property
    def services(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"),
                                         F.col("n_regionkey").cast("long").alias("tenant_id"),
                                         F.col("n_name").alias("name"))

    @cached_property
    def environments(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"),
                                           F.col("c_nationkey").cast("long").alias("service_id"),
                                           F.col("c_name").alias("name"))

    @cached_property
    def endpoint_writes(self) -> DataFrame:
        """Raw upsert stream into ``endpoints``: repeated (environment_id, version) keys."""
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("environment_id"),
            F.concat(F.lit("v"), (F.col("o_orderkey") % 20 + 1).cast("string")).alias("version"),
            F.concat(F.lit("https://env-"), F.col("o_custkey").cast("string"), F.lit(".example.com/"),
                     F.col("o_orderkey").cast("string")).alias("url"),
            (F.col("o_orderstatus") != "F").alias("is_active"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderdate").alias("updated_at"),
        )

    @cached_property
    def endpoints(self) -> DataFrame:
        """Upsert fold of the writes: first write keeps id/created_at, last sets the rest."""
        from ..operators.dml import fold_endpoint_writes
        return fold_endpoint_writes(self.endpoint_writes)

    @cached_property
    def route_table(self) -> DataFrame:
        from ..operators.catalog import route_table
        return route_table(self.tenants, self.services, self.environments, self.endpoints)

    @cached_property
    def route_requests(self) -> DataFrame:
        return self._orders_with_route.drop("o_orderpriority")

    @cached_property
    def _orders_with_route(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
        shift = F.when(F.col("o_orderkey") % 3 == 0, 7).otherwise(0)
        env = self.environments.select(F.col("id").alias("o_custkey"), "service_id",
                                       F.col("name").alias("env"))
        svc = self.services.select(F.col("id").alias("service_id"), "tenant_id",
                                   F.col("name").alias("service"))
        ten = self.tenants.select(F.col("id").alias("tenant_id"), F.col("name").alias("tenant"))
        j = o.join(env, "o_custkey")
        j = j.join(svc, "service_id")
        j = j.join(ten, "tenant_id")
        return j.select(
            F.col("o_orderkey").alias("request_id"),
            F.col("o_orderdate").alias("ts"),
            "tenant", "service", "env",
            F.concat(F.lit("v"), ((F.col("o_orderkey") + shift) % 20 + 1).cast("string")).alias("version"),
            "o_orderpriority",
        )

    @cached_property
    def change_log(self) -> DataFrame:
        """Mixed ordered write batch: the change events of ``events`` (new team-* routes) and,
        for every order, by its priority, a deactivate / create / activate of its catalog route, an
        unknown op, or a create whose URL is blank for odd orders."""
        ev = self.event_rows.filter(F.col("action").isin(*X.ACTIONS)).select(
            F.col("event_seq").alias("seq"),
            _case(F.col("action"), {v: k for k, v in {"create": "created", "activate": "activated",
                                                          "deactivate": "deactivated"}.items()}).alias("op"),
            "tenant", "service", "env", "version",
            F.when(F.col("action") == "created", F.col("url")).alias("url"))
        priority, url = F.col("o_orderpriority"), F.concat(F.lit("https://new.example.com/"), F.col("request_id").cast("string"))
        cat = self._orders_with_route.select(
            (F.col("request_id") + F.lit(CATALOG_SEQ_OFFSET)).alias("seq"),
            F.when(priority == "1-URGENT", F.lit("deactivate")).when(priority == "3-MEDIUM", F.lit("activate"))
            .when(priority == "4-NOT SPECIFIED", F.lit("purge")).otherwise(F.lit("create")).alias("op"),
            "tenant", "service", "env", "version",
            F.when((priority == "2-HIGH") | ((priority == "5-LOW") & (F.col("request_id") % 2 == 0)), url)
            .when(priority == "5-LOW", F.lit("  ")).alias("url"))
        return ev.unionByName(cat)

    # ---------------------------------------------------------------- events
    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    @staticmethod
    def route_columns(user_id="user_id"):
        u = F.col(user_id)
        return [
            F.concat(F.lit("team-"), (u % 5).cast("string")).alias("tenant"),
            F.concat(F.lit("svc-"), (u % 12).cast("string")).alias("service"),
            _by_mod(u, 3, ENVS).alias("env"),
            F.concat(F.lit("v"), (u % 20 + 1).cast("string")).alias("version"),
        ]

    @cached_property
    def event_rows(self) -> DataFrame:
        """Flat change events (one per events row) with the raw action mapping."""
        return self.change_events(self.events)

    def change_events(self, e: DataFrame) -> DataFrame:
        eid = F.col("event_id").cast("string")
        return e.select(
            eid.alias("event_id"),
            F.col("event_id").alias("event_seq"),
            F.col("event_type").alias("source_type"),
            _case(F.col("event_type"), STREAM_ACTION_OF_EVENT).alias("action"),
            *self.route_columns(),
            F.col("ts").alias("occurred_at"),
            F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("changed_by"),
            F.concat(F.lit("req-"), F.lpad(eid, 16, "0")).alias("correlation_id"),
            F.col("props"),
            F.col("user_id"),
            F.col("value"),
        ).withColumn("url", F.concat(F.lit("https://"), F.col("tenant"), F.lit(".example.com/"),
                                     F.col("service"), F.lit("/"), F.col("env"), F.lit("/"),
                                     F.col("version"), F.lit("/"), F.col("event_id")))

    @cached_property
    def audit(self) -> DataFrame:
        """Audit documents: created/activated/deactivated events only."""
        r = self.event_rows.filter(F.col("action").isin(*X.ACTIONS))
        return r.select(
            "event_id",
            F.lit(X.DEFAULT_EVENT_TYPE).alias("event_type"),
            "action",
            F.struct("tenant", "service", "env", "version").alias("route"),
            "url",
            F.lit(None).cast("string").alias("previous_url"),
            F.lit(None).cast("string").alias("previous_state"),
            "changed_by",
            "occurred_at",
            X.ts_plus_seconds(F.col("occurred_at"), 1).alias("processed_at"),
            F.from_json("props", "map<string,string>").alias("metadata"),
            "correlation_id",
            F.lit(False).alias("occurred_at_defaulted"),
            F.to_date("occurred_at").alias("event_date"),
        )

    @staticmethod
    def topic_order():
        """Partition and offset of an ``events`` row in the change stream."""
        return F.pmod(F.col("user_id"), F.lit(4)).cast("int"), F.col("event_id")

    @cached_property
    def stream_values(self) -> DataFrame:
        """Envelope of the change stream: key, JSON value, partition, offset, timestamp."""
        return self.envelopes(self.events)

    def envelopes(self, events: DataFrame) -> DataFrame:
        r = self.change_events(events)
        value = F.to_json(F.struct(
            F.col("event_id"), F.lit(X.DEFAULT_EVENT_TYPE).alias("event_type"), F.col("action"),
            "tenant", "service", "env", "version", "url",
            X.format_iso_timestamp(F.col("occurred_at"), zulu=True).alias("occurred_at"),
            "correlation_id"))
        return r.select(
            X.route_partition_key().alias("key"),
            value.alias("value"),
            F.pmod(F.col("user_id"), F.lit(4)).cast("int").alias("partition"),
            F.col("event_seq").alias("offset"),
            F.col("occurred_at").alias("timestamp"),
        )

    @cached_property
    def request_log(self) -> DataFrame:
        e = self.events
        k = F.get_json_object("props", "$.k").cast("int")
        status = (F.when(k == 1, 0).when(F.col("event_type") == "error", 500)
                  .when(k % 10 == 0, 404).otherwise(200))
        return e.select(
            F.col("event_id").alias("request_id"),
            F.col("ts"),
            F.lit("GET").alias("method"),
            F.col("event_type").alias("endpoint"),
            _case(F.col("event_type"), OPERATION_OF_EVENT, "resolve").alias("operation"),
            (F.col("value") * 10).alias("elapsed_ms"),
            status.alias("status_code"),
            F.when(k == 1, F.lit("transport error")).alias("error"),
            F.concat(F.lit("req-"), F.lpad(F.col("event_id").cast("string"), 16, "0")).alias("correlation_id"),
            (k % 2 == 0).alias("cid_from_client"),
            *self.route_columns(),
        )

    @cached_property
    def cache_snapshot(self) -> DataFrame:
        rt = self.route_table
        expires = X.ts_plus_seconds(X.lit_ts(CATALOG_AS_OF), (F.col("endpoint_id") % 120 - 60).cast("double"))
        return rt.select(
            X.route_cache_key().alias("route_key"),
            F.when(F.col("is_active"), F.col("url")).alias("url"),
            (~F.col("is_active")).alias("is_negative"),
            expires.alias("expires_at"),
        )

    @cached_property
    def counter_samples(self) -> DataFrame:
        """Counter ``http_requests_total`` per (instance, endpoint); resets every day."""
        from pyspark.sql import Window as W
        e = self.events.select(
            "ts", "event_id",
            F.concat(F.lit("i-"), (F.col("user_id") % 3).cast("string")).alias("instance"),
            F.col("event_type").alias("endpoint"))
        w = W.partitionBy("instance", "endpoint", F.to_date("ts")).orderBy("ts", "event_id")
        return e.select("ts", "instance", F.lit("http_requests_total").alias("metric"), "endpoint",
                        F.row_number().over(w).cast("double").alias("value"))

    @cached_property
    def gauge_samples(self) -> DataFrame:
        e = self.events
        k = F.get_json_object("props", "$.k").cast("int")
        inst = F.concat(F.lit("i-"), (F.col("user_id") % 3).cast("string")).alias("instance")
        in_use = e.select("ts", inst, F.lit("db_pool_in_use").alias("metric"), (k % 11).cast("double").alias("value"))
        size = e.select("ts", inst, F.lit("db_pool_size").alias("metric"), F.lit(10.0).alias("value"))
        return in_use.unionByName(size)

    @cached_property
    def call_log(self) -> DataFrame:
        e = self.events
        return e.select(
            F.concat(F.lit("i-"), (F.col("user_id") % 2).cast("string")).alias("instance"),
            _by_mod(F.col("user_id"), 3, DEPENDENCIES).alias("dependency"),
            F.col("ts"), F.col("event_id").alias("call_id"),
            (F.col("event_type") == "error").alias("is_failure"))

    @cached_property
    def retry_log(self) -> DataFrame:
        e = self.events
        return e.select(
            F.concat(F.lit("i-"), (F.col("user_id") % 2).cast("string")).alias("instance"),
            _by_mod(F.col("user_id"), 3, BUDGETS).alias("budget"),
            F.col("ts"), F.col("event_id").alias("retry_id"))

    @cached_property
    def operation_spans(self) -> DataFrame:
        e = self.events
        return e.select(
            F.concat(F.lit("i-"), (F.col("user_id") % 2).cast("string")).alias("instance"),
            _by_mod(F.col("user_id"), 3, CLASSES).alias("class"),
            F.col("event_id").alias("span_id"),
            F.col("ts").alias("start_ts"),
            X.ts_plus_seconds(F.col("ts"), F.col("value")).alias("end_ts"))

    @cached_property
    def outages(self) -> DataFrame:
        """One hour-long outage window after every severe error (value > 250)."""
        e = self.events.filter((F.col("event_type") == "error") & (F.col("value") > 250))
        return e.select(F.col("event_id").alias("outage_id"), F.col("ts").alias("start_ts"),
                        X.ts_plus_seconds(F.col("ts"), 3600).alias("end_ts"))


def flat_route(df: DataFrame, struct_col: str = "route") -> DataFrame:
    """Replace a ``route`` struct by its four columns (for SQL comparison)."""
    keep = [c for c in df.columns if c != struct_col]
    idx = df.columns.index(struct_col)
    cols = [F.col(c) for c in keep[:idx]] + [F.col(f"{struct_col}.{n}").alias(n) for n in X.ROUTE_COLS] \
        + [F.col(c) for c in keep[idx:]]
    return df.select(*cols)
