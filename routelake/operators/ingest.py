"""Text sources (metric exposition, application log), their renderers, the per-request
trace across sources, and the outage range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from . import scan

# Exposition line and log line formats of the reference.
EXPO_LINE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{(.*)\})?\s+(\S+)(\s+(-?[0-9]+))?\s*$"
EXPO_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'
EXPO_META = r"^#\s+(HELP|TYPE)\s+([a-zA-Z_:][a-zA-Z0-9_:]*)\s*(.*)$"
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - \[([^\]]*)\] - (\S+) - ([A-Z]+) - (.*)$"
LOG_TS_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"


# ------------------------------------------------------------------ exposition text
def render_exposition(samples: DataFrame, labels=("instance", "endpoint"), kind: str = "counter",
                      help_text: str = "Total requests") -> DataFrame:
    """Latest sample of every series as exposition lines, plus # HELP / # TYPE per metric."""
    series = ["metric", *labels]
    last = samples.groupBy(*series).agg(F.max(F.struct("ts", "value")).alias("l"))
    lab = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c), F.lit('"')) for c in labels])
    body = last.select(F.concat(F.col("metric"), F.lit("{"), lab, F.lit("} "),
                                F.col("l.value").cast("string")).alias("value"))
    metrics = last.select("metric").distinct()
    head = (metrics.select(F.concat(F.lit("# HELP "), F.col("metric"), F.lit(" " + help_text)).alias("value"))
            .unionByName(metrics.select(F.concat(F.lit("# TYPE "), F.col("metric"), F.lit(" " + kind)).alias("value"))))
    return head.unionByName(body)


def _unescaped(text) -> F.Column:
    """Label value without its escapes: backslash, quote, line end."""
    held = F.replace(text, F.lit("\\\\"), F.lit("\x00"))
    held = F.replace(F.replace(held, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.replace(held, F.lit("\x00"), F.lit("\\"))


def parse_exposition(lines: DataFrame) -> DataFrame:
    """``value`` text lines -> (metric, labels map, value, ts, type, line, reject_reason). HELP/TYPE
    give the type (of several TYPE lines of a metric the smallest text); ``ts`` is the sample's own
    time if it has one. Lines that are neither sample, comment nor blank are kept with a reason."""
    v = F.col("value")
    meta = lines.filter(v.rlike(EXPO_META)).select(
        F.regexp_extract(v, EXPO_META, 1).alias("kw"), F.regexp_extract(v, EXPO_META, 2).alias("metric"),
        F.regexp_extract(v, EXPO_META, 3).alias("arg"))
    types = meta.filter(F.col("kw") == "TYPE").groupBy("metric").agg(F.min("arg").alias("type"))
    s = lines.filter(v.isNotNull() & ~v.startswith("#") & (F.trim(v) != ""))
    raw_labels = F.regexp_extract(v, EXPO_LINE, 3)
    num = F.regexp_extract(v, EXPO_LINE, 4)
    num = (F.when(num.isin("+Inf", "Inf"), F.lit("Infinity")).when(num == "-Inf", F.lit("-Infinity"))
           .otherwise(num))
    good = v.rlike(EXPO_LINE) & num.try_cast("double").isNotNull()
    names, texts = (F.regexp_extract_all(raw_labels, F.lit(EXPO_LABEL), i) for i in (1, 2))
    unique = F.size(F.array_distinct(names)) == F.size(names)
    reason = F.when(~good, F.lit("not_a_sample")).when(~unique, F.lit("repeated_label"))
    ok = reason.isNull()
    parsed = s.select(
        F.when(ok, F.regexp_extract(v, EXPO_LINE, 1)).alias("metric"),
        F.when(ok, F.map_from_arrays(names, F.transform(texts, _unescaped))).alias("labels"),
        F.when(ok, num.try_cast("double")).alias("value"),
        F.when(ok, F.timestamp_millis(F.regexp_extract(v, EXPO_LINE, 6).try_cast("long"))).alias("ts"),
        v.alias("line"), reason.alias("reject_reason"))
    # histogram / summary series (_bucket, _sum, _count) take the type of their family
    family = F.regexp_replace(F.col("metric"), r"_(bucket|sum|count)$", "")
    exact = parsed.join(types, "metric", "left")
    fam = types.select(F.col("metric").alias("_family"), F.col("type").alias("_ftype"))
    return (exact.withColumn("_family", family).join(fam, "_family", "left")
            .withColumn("type", F.coalesce("type", "_ftype")).drop("_family", "_ftype"))


# ------------------------------------------------------------------ application log
def log_level(status) -> F.Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when((s >= 500) | (s == 0), F.lit("ERROR")).when(s >= 400, F.lit("WARNING")).otherwise(F.lit("INFO"))


def render_app_log(log: DataFrame, logger: str = "api.app") -> DataFrame:
    msg = F.concat(F.col("method"), F.lit(" /api/"), F.col("endpoint"), F.lit(" -> "),
                   F.col("status_code").cast("string"))
    return log.select(F.concat_ws(" - ", F.date_format("ts", LOG_TS_FORMAT),
                                  F.concat(F.lit("["), X.log_correlation_id("correlation_id"), F.lit("]")),
                                  F.lit(logger), log_level("status_code"), msg).alias("value"))


def parse_app_log(lines: DataFrame) -> DataFrame:
    """(ts, correlation_id, logger, level, message, reject_reason). A line that is no log line (part
    of a stack trace, say) is kept whole as its message, with a reason."""
    v = F.col("value")
    ok = v.rlike(LOG_LINE)

    def part(i: int):
        return F.when(ok, F.regexp_extract(v, LOG_LINE, i))
    return lines.filter(v.isNotNull()).select(
        F.try_to_timestamp(part(1), F.lit(LOG_TS_FORMAT)).alias("ts"), F.when(part(2) != "-", part(2)).alias("correlation_id"),
        part(3).alias("logger"), part(4).alias("level"), F.when(ok, part(5)).otherwise(v).alias("message"),
        F.when(~ok, F.lit("not_a_log_line")).alias("reject_reason"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


# ------------------------------------------------------------------ joins over time
def trace_by_correlation(parts: dict) -> DataFrame:
    """One timeline per correlation id over several sources. ``parts``: source name ->
    DataFrame(correlation_id, ts, detail). ``step`` numbers the rows of an id in time order;
    rows at one instant by source, then detail. An id that many requests share is numbered by
    chunks of time, so no task sorts all its rows."""
    u = None
    for name, df in parts.items():
        d = df.select("correlation_id", "ts", F.lit(name).alias("source"), F.col("detail").cast("string"))
        u = d if u is None else u.unionByName(d)
    u = u.filter(F.col("correlation_id").isNotNull())
    u = u.withColumn("_ts", F.coalesce("ts", F.lit("0001-01-01 00:00:00").cast("timestamp"))).withColumn("_tb", F.struct("source", "detail"))
    u = scan.running_sum(u, ["correlation_id"], "_ts", "_tb", F.lit(1), "step")
    return u.select("correlation_id", "ts", "source", "detail", F.col("step").cast("long").alias("step"))


def outage_changes(changes: DataFrame, outages: DataFrame, ts: str = "occurred_at",
                   bucket_seconds: int = 3600) -> DataFrame:
    """Changes inside each outage window ``[start_ts, end_ts]``: both sides get hour
    buckets (an outage one per hour it covers), equi-join on the bucket, then the exact
    range test. No nested-loop join, and work grows with matches, not with the product."""
    B = bucket_seconds * 1_000_000
    ob = outages.withColumn("_b", F.explode(F.sequence(
        F.floor(F.unix_micros("start_ts") / B).cast("long"), F.floor(F.unix_micros("end_ts") / B).cast("long"))))
    cb = changes.withColumn("_b", F.floor(F.unix_micros(ts) / B).cast("long"))
    j = cb.join(ob, "_b").filter((F.col(ts) >= F.col("start_ts")) & (F.col(ts) <= F.col("end_ts")))
    return j.drop("_b")
