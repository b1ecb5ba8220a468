"""Skew-safe window primitives.

A window ``partitionBy(key)`` sends every row of a key to one task. Keys here are few and
hot (3 dependencies, one busy route), so each primitive cuts a key's time line into
chunks, works per (key, chunk) in parallel, and stitches the chunks together with a small
per-(key, chunk) table whose size is (#keys x #chunks), independent of the row count.

* ``lag_within``      previous row's values per key (order: ts, tie-break)
* ``running_sum(s)``  inclusive running sums per key (rows frame, exact with ties)
* ``asof_last``       newest right-side value at or before each left row's time
* ``trailing_sums``   whole-number sums over a trailing time range: every row leaves again after the width
* ``two_blocks``      anything over a trailing range: a prefix of this block and a suffix of the one before
* ``top_n_per_group`` newest n per group (map-side group limit, salted above the limit)

``chunk_seconds`` bounds the work of one task: it holds the rows of one key in that time. It
is a plain parameter; nothing is measured and no plan depends on the size of the data, so
results never depend on it. No primitive uses a sliding frame, which Spark sums up anew for every
row: all frames begin at their partition's first row, so the work is linear in the rows of a key,
also where all of them fall into one instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK_SECONDS = 900


def _micros(ts) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def chunk_id(ts, seconds: int) -> Column:
    return F.floor(_micros(ts) / F.lit(int(seconds) * 1_000_000)).cast("long")


def lag_within(df: DataFrame, keys, ts: str, tiebreak: str, cols, prefix: str = "prev_",
               chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """Adds ``prev_<c>`` for every c in ``cols``: the value on the previous row of the same
    key in (ts, tiebreak) order; null on the key's first row."""
    keys, cols = list(keys), list(cols)
    d = df.withColumn("_b", chunk_id(ts, chunk_seconds))
    w = Window.partitionBy(*keys, "_b").orderBy(ts, tiebreak)
    d = d.withColumn("_rn", F.row_number().over(w))
    for c in cols:
        d = d.withColumn(prefix + c, F.lag(c).over(w))
    fields = [F.col(ts).alias("_o1"), F.col(tiebreak).alias("_o2")] + [F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)]
    last = d.groupBy(*keys, "_b").agg(F.max(F.struct(*fields)).alias("_l"))
    w2 = Window.partitionBy(*keys).orderBy("_b")
    last = last.select(*keys, "_b", F.lag("_l").over(w2).alias("_pl"))
    d = _stitched(d, last, keys)
    for i, c in enumerate(cols):
        d = d.withColumn(prefix + c, F.when(F.col("_rn") == 1, F.col(f"_pl._c{i}")).otherwise(F.col(prefix + c)))
    return d.drop("_b", "_rn", "_pl")


def _stitched(d: DataFrame, chunks: DataFrame, keys) -> DataFrame:
    """``d`` with the columns of its (key, chunk) row of ``chunks``; null keys are keys too."""
    c = chunks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_b"])], *[x for x in chunks.columns if x not in [*keys, "_b"]])
    on = None
    for i, k in enumerate([*keys, "_b"]):
        same = d[k].eqNullSafe(c[f"_k{i}"])
        on = same if on is None else on & same
    return d.join(c, on, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def running_sums(df: DataFrame, keys, at: Column, order, values: dict, chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """For each ``name: value``: the sum of ``value`` over all rows of the key up to and including
    this one, in the order of ``order`` (columns, the first of them ``at`` in microseconds)."""
    keys, names = list(keys), list(values)
    d = df.withColumn("_b", F.floor(at / F.lit(int(chunk_seconds) * 1_000_000)).cast("long"))
    d = d.withColumns({f"_v_{n}": v for n, v in values.items()})
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(w) for n in names})
    totals = d.groupBy(*keys, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_b", *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in names])
    d = _stitched(d, carried, keys)
    d = d.withColumns({n: F.col(f"_s_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in names})
    return d.drop("_b", *[f"{x}{n}" for x in ("_v_", "_s_", "_o_") for n in names])


def running_sum(df: DataFrame, keys, ts: str, tiebreak: str, value: Column, out: str,
                chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """One running sum in (ts, tiebreak) order (see ``running_sums``)."""
    return running_sums(df, keys, _micros(ts), [ts, tiebreak], {out: value}, chunk_seconds)


def trailing_sums(df: DataFrame, keys, ts: str, tiebreak: str, width_seconds: int, values: dict,
                  include_lower: bool, lifetime: dict | None = None, chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """For each ``name: value`` in ``values``: the sum of ``value`` over earlier-or-same rows
    of the key whose ts lies in ``(t - width, t]`` (``include_lower=False``) or
    ``[t - width, t]`` (True); for those of ``lifetime``: over all of them. Rows with the same ts
    that come later in tie-break order are not counted, so the sum is what a one-at-a-time
    recorder sees.

    Every row enters at its time and leaves, with its value negated, when the range has passed it: one
    running sum over twice the rows. Values must be whole numbers (or others whose sums are exact)."""
    lifetime = lifetime or {}
    gone_after = int(width_seconds) * 1_000_000 + (1 if include_lower else 0)
    every = {**values, **lifetime}
    rows = df.withColumns({"_at": _micros(ts), "_side": F.lit(1), **{f"_in_{n}": v for n, v in every.items()}})
    out_cols = {"_at": F.col("_at") + F.lit(gone_after), "_side": F.lit(0)}
    out_cols |= {f"_in_{n}": -F.col(f"_in_{n}") for n in values} | {f"_in_{n}": F.lit(0).cast(rows.schema[f"_in_{n}"].dataType) for n in lifetime}
    kept = set(keys) | {tiebreak}
    leaving = rows.select(*[F.col(c) if c in kept else F.lit(None).cast(rows.schema[c].dataType).alias(c)
                            for c in rows.columns if c not in out_cols], *[c.alias(n) for n, c in out_cols.items()])
    # what leaves at an instant does so before that instant's rows enter
    d = running_sums(rows.unionByName(leaving), keys, F.col("_at"), ["_at", "_side", tiebreak],
                     {n: F.col(f"_in_{n}") for n in every}, chunk_seconds)
    return d.filter("_side = 1").drop("_at", "_side", *[f"_in_{n}" for n in every])


def trailing_count(df: DataFrame, keys, ts: str, tiebreak: str, width_seconds: int, value: Column,
                   out: str, include_lower: bool) -> DataFrame:
    """One trailing sum (see ``trailing_sums``)."""
    return trailing_sums(df, keys, ts, tiebreak, width_seconds, {out: value}, include_lower)


def two_blocks(df: DataFrame, keys, ts: str, width_seconds: int, here, ahead) -> DataFrame:
    """Trailing ranges ``(t - width, t]`` without a sliding frame, for series with one row per instant.

    Time is cut into blocks of the width, so a range is a prefix of its own block and a suffix of the
    block before. ``here(up)`` gives {name: column} for the prefix: ``up`` is the window over the
    row's own block in time order; its columns are added. ``ahead(down)`` gives {name: column} for
    suffixes: ``down`` is the window over a block in reverse order, so a column at a row covers the
    row and all later ones of its block. They are added as struct ``suffix``: their values at the first row inside the
    range that lies in the block before, null if the range does not reach into it.

    Nothing is subtracted, so sums of doubles keep their precision however long the series is. A
    task holds one block of one key, in linear time."""
    keys = list(keys)
    width = int(width_seconds) * 1_000_000
    d = df.withColumns({"_us": _micros(ts)}).withColumn("_b", F.floor(F.col("_us") / F.lit(width)).cast("long"))
    block = Window.partitionBy(*keys, "_b")
    d = d.withColumns(here(block.orderBy("_us")))
    d = d.withColumn("_mine", F.struct(*[c.alias(n) for n, c in ahead(block.orderBy(F.col("_us").desc())).items()]))
    none = F.lit(None).cast(d.schema["_mine"].dataType)
    rows = d.withColumns({"_side": F.lit(0), "_at": F.col("_us")})
    # a row of the block before, where it leaves the range: it counts for the rows before that instant
    before = d.select(*[F.col(c) if c in [*keys, "_mine"] else F.lit(None).cast(d.schema[c].dataType).alias(c) for c in d.columns if c != "_b"],
                      (F.col("_b") + 1).alias("_b"), F.lit(1).alias("_side"), (F.col("_us") + F.lit(width)).alias("_at"))
    u = rows.withColumn("_given", none).unionByName(before.withColumnRenamed("_mine", "_given").withColumn("_mine", none))
    later = (Window.partitionBy(*keys, "_b").orderBy(F.col("_at").desc(), "_side")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumn("suffix", F.last("_given", ignorenulls=True).over(later)).filter("_side = 0")
    return u.drop("_us", "_b", "_mine", "_side", "_at", "_given")


def top_n_per_group(df: DataFrame, keys, order_cols, n: int, salt_buckets: int = 64,
                    salt_col: str | None = None) -> DataFrame:
    """Newest-n style top-k per group without sending a hot group to one task.

    For n up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000 by default) the plain
    ``row_number() <= n`` is planned with a map-side WindowGroupLimit: every input partition
    forwards at most n rows per group, so a hot group's task receives n x #partitions rows,
    not the group. Above it: a salted first pass keeps n rows per (group, salt), the second
    ranks at most n * salts. ``order_cols`` must give a total order (add a unique tie-break)."""
    keys = list(keys)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    if n <= limit:
        return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
    salt = F.pmod(F.xxhash64(F.col(salt_col) if salt_col else F.struct(*df.columns)), F.lit(salt_buckets))
    d = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order_cols)
    d = d.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n)
    d = d.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)
    return d.drop("_salt", "_r1")


def asof_last(left: DataFrame, right: DataFrame, keys, ts: str, value: str, out: str,
              chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """As-of join: for every left row, ``value`` (any type; a struct carries several fields)
    of the newest right row of the same key with right.ts <= left.ts; of right rows at the same
    instant the largest value counts, whatever the input order. Union + running last-non-null,
    chunked so a hot key spreads out."""
    keys = list(keys)
    right = right.groupBy(*keys, ts).agg(F.max(value).alias(value))
    vtype = right.schema[value].dataType
    L = left.withColumn("_side", F.lit(1)).withColumn("_rv", F.lit(None).cast(vtype))
    R = right.select(*keys, F.col(ts), F.col(value).alias("_rv")).withColumn("_side", F.lit(0))
    for c in L.columns:
        if c not in R.columns:
            R = R.withColumn(c, F.lit(None).cast(L.schema[c].dataType))
    u = L.unionByName(R.select(*L.columns)).withColumn("_b", chunk_id(ts, chunk_seconds))
    # right rows sort before left rows at the same ts (<= semantics)
    w = (Window.partitionBy(*keys, "_b").orderBy(ts, "_side")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumn("_loc", F.last("_rv", ignorenulls=True).over(w))
    lastr = (R.withColumn("_b", chunk_id(ts, chunk_seconds)).groupBy(*keys, "_b")
             .agg(F.max(F.struct(ts, "_rv")).alias("_m")))
    # carry-in per chunk: the newest right value of all earlier chunks (chunks holding only
    # left rows need it too, so the chunk table covers both sides)
    lch = L.select(*keys, chunk_id(ts, chunk_seconds).alias("_b")).distinct()
    allc = lch.join(lastr.select(*keys, "_b", F.lit(True).alias("_has")), keys + ["_b"], "full")
    w3 = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (allc.join(lastr, keys + ["_b"], "left")
             .select(*keys, "_b", F.last("_m._rv", ignorenulls=True).over(w3).alias("_carry")))
    res = u.filter(F.col("_side") == 1).join(carry, keys + ["_b"], "left")
    return res.withColumn(out, F.coalesce("_loc", "_carry")).drop("_side", "_rv", "_b", "_loc", "_carry")
