"""2.4 catalog writes and data quality, 2.1 bulk load."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dml as D
from ..sources.tables import CATALOG_AS_OF, Tables
from .registry import register

ASOF = f"TIMESTAMP '{CATALOG_AS_OF}'"
VALID = ("tenant IS NOT NULL AND tenant <> '' AND service IS NOT NULL AND service <> '' AND env IS NOT NULL "
         "AND env <> '' AND version IS NOT NULL AND version <> ''")
VALID_URL = VALID + " AND url IS NOT NULL AND trim(url) <> ''"

# The create path in SQL: get-or-create of the three name tables, then the endpoint upsert.
CREATE_CTES = f"""WITH creates AS (SELECT * FROM change_log WHERE op = 'create' AND {VALID_URL}),
t_new AS (SELECT DISTINCT tenant AS name FROM creates WHERE tenant NOT IN (SELECT name FROM tenants)),
t2 AS (SELECT id, name FROM tenants UNION ALL
       SELECT (SELECT coalesce(max(id), 0) FROM tenants) + row_number() OVER (ORDER BY name) AS id, name FROM t_new),
s_w AS (SELECT DISTINCT t2.id AS tenant_id, c.service AS name FROM creates c JOIN t2 ON c.tenant = t2.name),
s_new AS (SELECT * FROM s_w WHERE NOT EXISTS (SELECT 1 FROM services s WHERE s.tenant_id = s_w.tenant_id AND s.name = s_w.name)),
s2 AS (SELECT id, tenant_id, name FROM services UNION ALL
       SELECT (SELECT coalesce(max(id), 0) FROM services) + row_number() OVER (ORDER BY tenant_id, name) AS id, tenant_id, name
         FROM s_new),
e_w AS (SELECT DISTINCT s2.id AS service_id, c.env AS name FROM creates c JOIN t2 ON c.tenant = t2.name
          JOIN s2 ON s2.tenant_id = t2.id AND s2.name = c.service),
e_new AS (SELECT * FROM e_w WHERE NOT EXISTS (SELECT 1 FROM environments e WHERE e.service_id = e_w.service_id AND e.name = e_w.name)),
e2 AS (SELECT id, service_id, name FROM environments UNION ALL
       SELECT (SELECT coalesce(max(id), 0) FROM environments) + row_number() OVER (ORDER BY service_id, name) AS id,
              service_id, name FROM e_new),
ch AS (SELECT e2.id AS environment_id, c.* FROM creates c JOIN t2 ON c.tenant = t2.name
         JOIN s2 ON s2.tenant_id = t2.id AND s2.name = c.service JOIN e2 ON e2.service_id = s2.id AND e2.name = c.env),
lastc AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY environment_id, version ORDER BY seq DESC) = 1),
ep2 AS (
  SELECT ep.id, ep.environment_id, ep.version, ep.url, ep.is_active, ep.created_at, ep.updated_at FROM endpoints ep
   WHERE NOT EXISTS (SELECT 1 FROM lastc l WHERE l.environment_id = ep.environment_id AND l.version = ep.version)
  UNION ALL
  SELECT ep.id, l.environment_id, l.version, l.url, TRUE, ep.created_at, {ASOF} FROM lastc l
    JOIN endpoints ep ON l.environment_id = ep.environment_id AND l.version = ep.version
  UNION ALL
  SELECT (SELECT coalesce(max(id), 0) FROM endpoints) + row_number() OVER (ORDER BY l.environment_id, l.version),
         l.environment_id, l.version, l.url, TRUE, {ASOF}, {ASOF} FROM lastc l
   WHERE NOT EXISTS (SELECT 1 FROM endpoints ep WHERE l.environment_id = ep.environment_id AND l.version = ep.version))
"""


def _creates(t: Tables):
    valid, _ = D.validate_route_writes(t.change_log.filter(F.col("op") == "create"), need_url=True)
    return valid


@register("get_or_create_tenant", CREATE_CTES + "SELECT id, name FROM t2")
def q_get_or_create_tenant(spark, d):
    t = Tables(spark, d)
    return D.get_or_create_tenant(t.tenants, _creates(t))


@register("get_or_create_service", CREATE_CTES + "SELECT id, tenant_id, name FROM s2")
def q_get_or_create_service(spark, d):
    t = Tables(spark, d)
    c = _creates(t)
    t2 = D.get_or_create_tenant(t.tenants, c)
    return D.get_or_create_service(t.services, t2, c)


@register("get_or_create_environment", CREATE_CTES + "SELECT id, service_id, name FROM e2")
def q_get_or_create_environment(spark, d):
    t = Tables(spark, d)
    c = _creates(t)
    t2 = D.get_or_create_tenant(t.tenants, c)
    s2 = D.get_or_create_service(t.services, t2, c)
    return D.get_or_create_environment(t.environments, s2, t2, c)


def _create_result(t: Tables):
    return D.catalog_create_routes(t.tenants, t.services, t.environments, t.endpoints, _creates(t), CATALOG_AS_OF)


@register("upsert_endpoint", CREATE_CTES + "SELECT * FROM ep2")
def q_upsert_endpoint(spark, d):
    return _create_result(Tables(spark, d))["endpoints"]


def _event_id_sql(action: str) -> str:
    h = f"sha256(CAST(seq AS VARCHAR) || '|' || '{action}')"
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
            f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")


@register("catalog_create_routes", CREATE_CTES + f""", fc AS (SELECT environment_id, version, min(seq) AS first_seq FROM ch
  GROUP BY environment_id, version)
SELECT {_event_id_sql('created')} AS event_id, 'route_changed' AS event_type, 'created' AS action,
       ch.tenant, ch.service, ch.env, ch.version, ch.url, {ASOF} AS occurred_at, ch.seq,
       EXISTS (SELECT 1 FROM endpoints ep WHERE ep.environment_id = ch.environment_id AND ep.version = ch.version)
         OR ch.seq > fc.first_seq AS was_update
  FROM ch JOIN fc ON ch.environment_id = fc.environment_id AND ch.version = fc.version""")
def q_catalog_create_routes(spark, d):
    return _create_result(Tables(spark, d))["events"]


IDS_SQL = """SELECT en.id AS environment_id, t.name AS tenant, s.name AS service, en.name AS env FROM environments en
  JOIN services s ON en.service_id = s.id JOIN tenants t ON s.tenant_id = t.id"""


@register("activate_routes", f"""WITH req AS (SELECT * FROM change_log WHERE op = 'activate'), ids AS ({IDS_SQL})
SELECT r.seq, r.tenant, r.service, r.env, r.version,
       CASE WHEN ep.id IS NOT NULL THEN 'activated' ELSE 'not_found' END AS outcome
  FROM req r LEFT JOIN ids ON r.tenant = ids.tenant AND r.service = ids.service AND r.env = ids.env
  LEFT JOIN endpoints ep ON ep.environment_id = ids.environment_id AND ep.version = r.version""")
def q_activate_routes(spark, d):
    t = Tables(spark, d)
    req = t.change_log.filter(F.col("op") == "activate")
    res = D.activate_routes(t.tenants, t.services, t.environments, t.endpoints, req, CATALOG_AS_OF)
    ok = res["events"].select("seq", "tenant", "service", "env", "version", F.col("action").alias("outcome"))
    bad = res["rejects"].select("seq", "tenant", "service", "env", "version", F.col("reject_reason").alias("outcome"))
    return ok.unionByName(bad)


@register("deactivate_routes", f"""WITH req AS (SELECT * FROM change_log WHERE op = 'deactivate'), ids AS ({IDS_SQL}),
found AS (SELECT ids.environment_id, r.version, r.seq FROM req r
  JOIN ids ON r.tenant = ids.tenant AND r.service = ids.service AND r.env = ids.env
  JOIN endpoints ep ON ep.environment_id = ids.environment_id AND ep.version = r.version),
k AS (SELECT DISTINCT environment_id, version FROM found)
SELECT ep.* FROM endpoints ep WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.environment_id = ep.environment_id AND k.version = ep.version)
UNION ALL
SELECT ep.id, ep.environment_id, ep.version, ep.url, FALSE, ep.created_at, {ASOF} FROM endpoints ep
  JOIN k ON k.environment_id = ep.environment_id AND k.version = ep.version""")
def q_deactivate_routes(spark, d):
    t = Tables(spark, d)
    req = t.change_log.filter(F.col("op") == "deactivate")
    return D.deactivate_routes(t.tenants, t.services, t.environments, t.endpoints, req, CATALOG_AS_OF)["endpoints"]


APPLY_CTES = f"""WITH cl AS (SELECT * FROM change_log WHERE (op = 'create' AND {VALID_URL})
             OR (op IN ('activate', 'deactivate') AND {VALID})),
fc AS (SELECT tenant, service, env, version, min(seq) AS first_create FROM cl WHERE op = 'create'
        GROUP BY tenant, service, env, version),
cur AS (SELECT tenant, service, env, version, url AS cur_url FROM route_table),
tg AS (SELECT cl.*, coalesce(cur.cur_url IS NOT NULL OR cl.seq >= fc.first_create, FALSE) AS applied
         FROM cl LEFT JOIN fc ON cl.tenant = fc.tenant AND cl.service = fc.service AND cl.env = fc.env
                              AND cl.version = fc.version
         LEFT JOIN cur ON cl.tenant = cur.tenant AND cl.service = cur.service AND cl.env = cur.env
                      AND cl.version = cur.version),
a AS (SELECT * FROM tg WHERE applied),
k AS (SELECT tenant, service, env, version, arg_max(op, seq) AS last_op,
             arg_max(url, seq) FILTER (WHERE op = 'create') AS last_url, count(*) AS n_ops
        FROM a GROUP BY tenant, service, env, version)
"""


@register("apply_change_log", APPLY_CTES + f"""SELECT k.tenant, k.service, k.env, k.version, coalesce(k.last_url, cur.cur_url) AS url,
       k.last_op <> 'deactivate' AS is_active, cur.cur_url IS NULL AS is_new, k.n_ops, {ASOF} AS updated_at
  FROM k LEFT JOIN cur ON k.tenant = cur.tenant AND k.service = cur.service AND k.env = cur.env AND k.version = cur.version""")
def q_apply_change_log(spark, d):
    t = Tables(spark, d)
    return D.apply_change_log(t.route_table, t.change_log, CATALOG_AS_OF)["state"]


@register("write_counters", APPLY_CTES + """SELECT count(*) AS writes_total, (SELECT count(*) FROM a) AS writes_success,
       count(*) - (SELECT count(*) FROM a) AS writes_failure FROM change_log""")
def q_write_counters(spark, d):
    t = Tables(spark, d)
    r = D.apply_change_log(t.route_table, t.change_log, CATALOG_AS_OF)
    return D.write_counters(r["events"], r["rejects"])


@register("write_error_pct", APPLY_CTES + """SELECT CAST(count(*) - (SELECT count(*) FROM a) AS DOUBLE) / count(*) * 100 AS write_error_pct,
       CAST((SELECT count(*) FROM a) AS DOUBLE) / count(*) AS write_success_ratio FROM change_log""")
def q_write_error_pct(spark, d):
    t = Tables(spark, d)
    r = D.apply_change_log(t.route_table, t.change_log, CATALOG_AS_OF)
    c = D.write_counters(r["events"], r["rejects"])
    return c.select((F.col("writes_failure") / F.col("writes_total") * 100).alias("write_error_pct"),
                    (F.col("writes_success") / F.col("writes_total")).alias("write_success_ratio"))


@register("write_success_ratio", APPLY_CTES + """SELECT (SELECT count(*) FROM a) AS writes_success, count(*) AS writes_total,
       CAST((SELECT count(*) FROM a) AS DOUBLE) / count(*) AS write_success_ratio FROM change_log""")
def q_write_success_ratio(spark, d):
    t = Tables(spark, d)
    r = D.apply_change_log(t.route_table, t.change_log, CATALOG_AS_OF)
    c = D.write_counters(r["events"], r["rejects"])
    return c.select("writes_success", "writes_total",
                    (F.col("writes_success") / F.col("writes_total")).alias("write_success_ratio"))


@register("dq_unique_violations", """SELECT 'tenants' AS table_name, name AS dup_key, count(*) AS n_rows FROM tenants
 GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'services', CAST(tenant_id AS VARCHAR) || '|' || name, count(*) FROM services
 GROUP BY tenant_id, name HAVING count(*) > 1
UNION ALL SELECT 'environments', CAST(service_id AS VARCHAR) || '|' || name, count(*) FROM environments
 GROUP BY service_id, name HAVING count(*) > 1
UNION ALL SELECT 'endpoint_writes', CAST(environment_id AS VARCHAR) || '|' || version, count(*) FROM endpoint_writes
 GROUP BY environment_id, version HAVING count(*) > 1
UNION ALL SELECT 'endpoints', CAST(environment_id AS VARCHAR) || '|' || version, count(*) FROM endpoints
 GROUP BY environment_id, version HAVING count(*) > 1""")
def q_dq_unique_violations(spark, d):
    t = Tables(spark, d)
    return D.union_all([
        D.dq_unique_violations(t.tenants, ["name"], "tenants"),
        D.dq_unique_violations(t.services, ["tenant_id", "name"], "services"),
        D.dq_unique_violations(t.environments, ["service_id", "name"], "environments"),
        D.dq_unique_violations(t.endpoint_writes, ["environment_id", "version"], "endpoint_writes"),
        D.dq_unique_violations(t.endpoints, ["environment_id", "version"], "endpoints")])


@register("dq_orphans", """SELECT 'services' AS table_name, id AS row_id, tenant_id AS missing_parent FROM services
 WHERE tenant_id IS NOT NULL AND tenant_id NOT IN (SELECT id FROM tenants)
UNION ALL SELECT 'environments', id, service_id FROM environments
 WHERE service_id IS NOT NULL AND service_id NOT IN (SELECT id FROM services)
UNION ALL SELECT 'endpoint_writes', id, environment_id FROM endpoint_writes
 WHERE environment_id IS NOT NULL AND environment_id NOT IN (SELECT id FROM environments)""")
def q_dq_orphans(spark, d):
    t = Tables(spark, d)
    return D.union_all([
        D.dq_orphans(t.services, "tenant_id", t.tenants, "id", "services"),
        D.dq_orphans(t.environments, "service_id", t.services, "id", "environments"),
        D.dq_orphans(t.endpoint_writes, "environment_id", t.environments, "id", "endpoint_writes")])


DQ_COLS = ["event_id", "action", "tenant", "service", "env", "version", "url", "occurred_at"]


@register("dq_check_violations", " UNION ALL ".join(
    [f"SELECT 'change_events' AS table_name, '{c}' AS column_name, 'not_null' AS rule, "
     f"count(*) FILTER (WHERE {c} IS NULL) AS violations FROM event_rows" for c in DQ_COLS]
    + ["SELECT 'change_events', 'action', 'enum', count(*) FILTER (WHERE action IS NOT NULL AND action NOT IN "
       "('created', 'activated', 'deactivated')) FROM event_rows"]))
def q_dq_check_violations(spark, d):
    return D.dq_check_violations(Tables(spark, d).event_rows, "change_events", not_null=DQ_COLS,
                                 enums={"action": ["created", "activated", "deactivated"]})


@register("load_routes_bulk", CREATE_CTES + """, fc AS (SELECT environment_id, version, min(seq) AS first_seq FROM ch
  GROUP BY environment_id, version),
ev AS (SELECT EXISTS (SELECT 1 FROM endpoints ep WHERE ep.environment_id = ch.environment_id AND ep.version = ch.version)
                OR ch.seq > fc.first_seq AS was_update
         FROM ch JOIN fc ON ch.environment_id = fc.environment_id AND ch.version = fc.version)
SELECT count(*) AS ok, (SELECT count(*) FROM change_log WHERE op = 'create') - count(*) AS errors,
       count(*) FILTER (WHERE NOT was_update) AS created, count(*) FILTER (WHERE was_update) AS updated FROM ev""")
def q_load_routes_bulk(spark, d):
    """Every create of the change log through the create path; ok / error counts."""
    t = Tables(spark, d)
    r = D.catalog_create_routes(t.tenants, t.services, t.environments, t.endpoints, t.change_log.filter(F.col("op") == "create"),
                                CATALOG_AS_OF)
    ev = r["events"].select(F.lit(1).alias("ok"), F.lit(0).alias("err"), F.col("was_update"))
    rj = r["rejects"].select(F.lit(0).alias("ok"), F.lit(1).alias("err"), F.lit(False).alias("was_update"))
    u = ev.unionByName(rj)
    return u.agg(F.sum("ok").cast("long").alias("ok"), F.sum("err").cast("long").alias("errors"),
                 F.sum(F.when(~F.col("was_update") & (F.col("ok") == 1), 1).otherwise(0)).cast("long").alias("created"),
                 F.sum(F.when(F.col("was_update"), 1).otherwise(0)).cast("long").alias("updated"))
