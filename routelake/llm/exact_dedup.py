"""Exact deduplication by content sort.

The normalised text goes through one range shuffle: Spark samples splitters over (leading
bytes, fingerprint, salt), sends each range to one partition and sorts it externally by
(leading bytes, fingerprint, salt, whole text, id). Equal texts are then neighbours, and a
window whose partition keys hold the whole text compares neighbours in full; the smallest id
of each run stays. The splitter columns are short, so the sample that Spark gathers on the
driver does not grow with the length of the texts.

Hot texts. A text whose copies hold more than ``max(hot_bytes, all bytes / MAX_HOT)`` bytes
is salted: its copies are sorted as several runs, of about that many bytes each. At most
``MAX_HOT`` texts can reach the limit, so the broadcast table of hot fingerprints is bounded
at any input size. The runs of a hot text are joined by an aggregate over the whole text,
which Spark combines on the map side. Salting changes the plan only, never a result.

Defined cases: null text equals empty text; a repeated row (same id and text) is kept once;
rows with a null id come last within their text, ``keep_id`` is null only if all ids of the
text are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import normalised

#: Most texts that can be hot at once: the size bound of what is broadcast.
MAX_HOT = 4096
#: Bytes of copies of one text that a single task sorts and compares.
HOT_BYTES = 1 << 20
#: Leading characters that take part in the splitters.
LEADING = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_bytes: int = HOT_BYTES,
                normalise=normalised) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("body"))
    sizes = docs.select(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"))
    return _sorted_runs(rows, rows.select("doc_id", "body"), F.col("body"), sizes, hot_bytes).select(*RESULT)


#: Columns of ``exact_dedup``.
RESULT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def _sorted_runs(rows: DataFrame, carried: DataFrame, body: Column, sizes: DataFrame, hot_bytes: int) -> DataFrame:
    """The result columns beside those of ``carried``, which go through the one range shuffle. ``rows``: (doc_id, body) of
    every row; ``body``: the normalised text from the carried columns."""
    rows = rows.withColumn("print", F.xxhash64("body"))
    limit = _hot_limit(sizes, hot_bytes)
    hot = (rows.groupBy("print").agg(F.count(F.lit(1)).alias("copies"), F.sum(F.octet_length("body") + F.lit(16).cast("long")).alias("bytes"))
           .filter((F.col("copies") > 1) & (F.col("bytes") > limit))
           .select("print", F.ceil(F.col("bytes") / F.lit(limit)).cast("int").alias("runs")))
    salted = (carried.withColumn("print", F.xxhash64(body)).withColumn("lead", F.substring(body, 1, LEADING))
              .join(F.broadcast(hot), "print", "left")
              .withColumn("salt", F.when(F.col("runs") > 1, F.pmod(F.xxhash64("doc_id"), F.col("runs").cast("long"))).otherwise(F.lit(0).cast("long")).cast("int"))
              .drop("runs"))
    ranged = salted.repartitionByRange("lead", "print", "salt").withColumn("_body", body)
    run = Window.partitionBy("lead", "print", "salt", "_body")
    runs = ranged.select(
        *carried.columns, F.sha2("_body", 256).alias("text_sha256"),
        F.min("doc_id").over(run).alias("run_keep"), F.count(F.lit(1)).over(run).alias("run_size"),
        F.row_number().over(run.orderBy(F.col("doc_id").asc_nulls_last())).alias("place"))
    whole = (rows.join(F.broadcast(hot), "print", "left_semi")
             .groupBy("body").agg(F.min("doc_id").alias("hot_keep"), F.count(F.lit(1)).alias("hot_size"))
             .select(F.sha2("body", 256).alias("text_sha256"), "hot_keep", "hot_size"))
    out = runs.join(F.broadcast(whole), "text_sha256", "left")
    is_hot = F.col("hot_size").isNotNull()
    keep: Column = F.when(is_hot, F.col("hot_keep")).otherwise(F.col("run_keep"))
    return out.select(*carried.columns, keep.alias("keep_id"), F.coalesce("hot_size", "run_size").alias("group_size"),
                      ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep)).alias("kept"),
                      "text_sha256")


def _hot_limit(sizes: DataFrame, hot_bytes: int) -> int:
    total = sizes.agg(F.sum(F.col("n") + F.lit(16).cast("long"))).first()[0] or 0
    return max(hot_bytes, total // MAX_HOT)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_bytes: int = HOT_BYTES) -> DataFrame:
    """The rows that stay, with all their columns; of rows with equal id and text, one. The rows go through the range
    shuffle as they are (their text once) and stay or go where they are compared."""
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("body"))
    carried = docs.select(F.col(id_col).alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    sizes = docs.select(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"))
    found = _sorted_runs(rows, carried, normalised(F.col("row").getField(text_col)), sizes, hot_bytes)
    return found.filter("kept").select("row.*")
