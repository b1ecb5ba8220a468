"""Explicit schemas (no inference anywhere)."""

from pyspark.sql import types as T

S = T.StringType()

ROUTE = T.StructType([T.StructField(n, S) for n in ("tenant", "service", "env", "version")])

# Change-event payload (v1 has ten fields; the optional ones may be absent). All nullable,
# so from_json in PERMISSIVE mode tolerates missing and extra fields.
ROUTE_EVENT = T.StructType([
    T.StructField("event_id", S), T.StructField("event_type", S), T.StructField("action", S),
    T.StructField("tenant", S), T.StructField("service", S), T.StructField("env", S),
    T.StructField("version", S), T.StructField("url", S), T.StructField("occurred_at", S),
    T.StructField("correlation_id", S), T.StructField("previous_url", S),
    T.StructField("previous_state", S), T.StructField("changed_by", S),
    T.StructField("metadata", T.MapType(S, S)),
])

ENVELOPE = T.StructType([
    T.StructField("key", S), T.StructField("value", S), T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("timestamp", T.TimestampType()),
])

AUDIT = T.StructType([
    T.StructField("event_id", S), T.StructField("event_type", S), T.StructField("action", S),
    T.StructField("route", ROUTE), T.StructField("url", S), T.StructField("previous_url", S),
    T.StructField("previous_state", S), T.StructField("changed_by", S),
    T.StructField("occurred_at", T.TimestampType()), T.StructField("processed_at", T.TimestampType()),
    T.StructField("metadata", T.MapType(S, S)), T.StructField("correlation_id", S),
    T.StructField("occurred_at_defaulted", T.BooleanType()),
    T.StructField("event_date", T.DateType()),
])

CACHE = T.StructType([
    T.StructField("route_key", S), T.StructField("url", S), T.StructField("is_negative", T.BooleanType()),
    T.StructField("expires_at", T.TimestampType()),
])

#: A change of the cache: a new entry, or (``deleted``) none any more.
CACHE_CHANGE = T.StructType(CACHE.fields + [T.StructField("deleted", T.BooleanType())])

#: Newest event of a route, by (partition, offset).
KEY_STATE = T.StructType([*ROUTE.fields, T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()),
                          T.StructField("action", S), T.StructField("url", S), T.StructField("event_id", S)])

L, TS, B = T.LongType(), T.TimestampType(), T.BooleanType()
TENANTS = T.StructType([T.StructField("id", L), T.StructField("name", S)])
SERVICES = T.StructType([T.StructField("id", L), T.StructField("tenant_id", L), T.StructField("name", S)])
ENVIRONMENTS = T.StructType([T.StructField("id", L), T.StructField("service_id", L), T.StructField("name", S)])
ENDPOINTS = T.StructType([T.StructField("id", L), T.StructField("environment_id", L), T.StructField("version", S),
                          T.StructField("url", S), T.StructField("is_active", B), T.StructField("created_at", TS),
                          T.StructField("updated_at", TS)])
CATALOG = {"tenants": TENANTS, "services": SERVICES, "environments": ENVIRONMENTS, "endpoints": ENDPOINTS}
