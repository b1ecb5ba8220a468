"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds ``capacity`` length units. Documents are taken longest first; each goes to the
fullest bin that has room for it and no conflict. Two documents conflict if they have the same
source or the same duplicate cluster; a bin carries a bitmap of the sources and one of the
clusters that it holds, so a conflict is one AND. Bins are ordered by residual room: the
search starts at the first bin with enough room and goes on to the next tighter ones until one
is compatible, and opens a new bin if none is.

A document longer than a bin is cut into whole bins plus a rest; only the rest competes. Whole
bins hold nothing else.

Scale. Rows are dealt to shards by a hash of their id, about ``shard_rows`` rows each, so a hot
source or a large cluster is spread evenly, and each shard is packed on its own by one task
(narrow rows: id, length, source, cluster). Work per shard is bounded, so the whole grows in
proportion to the input. A bin belongs to one shard: (shard, bin) names it.

Defined cases: rows of length 0 (null or empty text) are in no bin (bin and offset null); null
sources and null clusters conflict with nothing; rows with equal id and length are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import python_ready

CAPACITY = 2048
SHARD_ROWS = 8192
SCHEMA = "doc_id long, length long, shard int, bin long, piece int, start long, offset long, n long"


def pack(items: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of every item (length, source bitmap, cluster bitmap), given longest first; 0 < length <= capacity."""
    order: list[tuple[int, int]] = []     # (residual, bin) of the bins with room, tightest first
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in items:
        at = bisect_left(order, (length, -1))
        while at < len(order) and (sources[order[at][1]] & source or clusters[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        if residual > length:
            insort(order, (residual - length, b))
        out.append(b)
    return out


def _bits(values: list) -> list[int]:
    """A bit for every value that occurs twice or more; none for others and for null."""
    often: dict = {}
    for v in values:
        often[v] = often.get(v, 0) + 1
    bit = {v: i for i, v in enumerate(v for v, n in often.items() if n > 1 and v is not None)}
    return [1 << bit[v] if v in bit else 0 for v in values]


def pack_shard(rows: list[tuple], capacity: int) -> list[tuple]:
    """rows: (doc_id, length, source, cluster). Returns (doc_id, length, bin, piece, start, offset, n)."""
    rows = sorted(rows, key=lambda r: (-(r[1] % capacity), r[0] is None, r[0] or 0, r[1], str(r[2]), str(r[3])))
    rest = [r for r in rows if r[1] % capacity]
    items = list(zip((r[1] % capacity for r in rest), _bits([r[2] for r in rest]), _bits([r[3] for r in rest]), strict=True))
    bins = iter(pack(items, capacity))
    filled: dict[int, int] = {}
    out, whole = [], []
    for doc_id, length, _, _ in rows:
        full, left = divmod(length, capacity)
        whole += [(doc_id, length, piece, piece * capacity) for piece in range(full)]
        if left:
            b = next(bins)
            out.append((doc_id, length, b, full, full * capacity, filled.get(b, 0), left))
            filled[b] = filled.get(b, 0) + left
        elif not full:
            out.append((doc_id, 0, None, 0, 0, None, 0))
    return out + [(d, n, len(filled) + k, piece, start, 0, capacity) for k, (d, n, piece, start) in enumerate(whole)]


def best_fit(docs: DataFrame, length: Column, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id",
             source: Column | None = None, cluster: Column | None = None, n_docs: int | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, length, shard, bin, piece, start (in the document), offset (in the bin), n.
    ``n_docs``: the number of rows, where it is known more cheaply than by counting ``docs``."""
    spark = docs.sparkSession
    python_ready(spark)
    none = F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"),
                       (none if source is None else source).cast("string").alias("source"),
                       (none if cluster is None else cluster).cast("string").alias("cluster"))
    shards = max(1, -(-(docs.count() if n_docs is None else n_docs) // shard_rows))
    # rows without an id, or repeated ones, are spread by their other columns
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "cluster"), F.lit(shards).cast("long")).cast("int"))

    def run(batches):
        import pyarrow as pa
        schema = pa.schema([(k, pa.int32() if t == "int" else pa.int64()) for k, t in (c.split() for c in SCHEMA.split(", "))])

        def packed(shard, rows):
            found = [(d, n, shard, b, p, s, o, k) for d, n, b, p, s, o, k in pack_shard(rows, capacity)]
            for at in range(0, len(found), 10_000):
                part = found[at:at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

        shard, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row[4] != shard:
                    yield from packed(shard, rows)
                    shard, rows = row[4], []
                rows.append(row[:4])
        yield from packed(shard, rows)

    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, SCHEMA)


def word_count(text) -> Column:
    """Words (runs of ``[^\\x20\\x09-\\x0D]+``) of a text; null has none."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
