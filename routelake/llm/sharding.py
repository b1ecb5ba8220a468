"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. Every shard owns ``virtual_nodes`` cells, chosen by a hash of
(shard, node); a row's cell is a hash of its id, and the row belongs to the next owned cell
clockwise. No shard may hold more than its bound; rows that overflow a full shard go on
clockwise to the next node whose shard has room.

All rows between two neighbouring nodes (an arc) meet the same nodes in the same order, so
only the number of rows per arc decides how many of them each node takes. These counts are
one aggregate with at most ``shards * virtual_nodes`` rows, whatever the input size; the walk
clockwise runs over them, and gives for each arc the ranges of ranks that each shard takes.
Each row then needs its rank within its arc (one window over narrow rows, arcs being hashed
evenly) and a broadcast lookup in the table of ranges.

With ``slack`` 0 the bounds add up to the number of rows, so shard sizes are at most one
apart (law ``rows``). With more slack fewer rows move when a shard joins.

Defined cases: null text has no bytes and CRC 0; null ids hash like any other value; rows with
the same id are ranked by CRC and size, and identical rows are interchangeable; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16
SHARDS = 40
VIRTUAL_NODES = 64
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def ring_nodes(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise. A shard's nodes never depend on the other shards."""
    def cell(s: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:4], "big") % CELLS
    return sorted({(cell(s, v), s) for s in range(shards) for v in range(virtual_nodes)})


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """The most rows of each shard; the sum is ``rows`` at least."""
    if slack > 0:
        return [-int(-rows * (1 + slack) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(nodes: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank, shard, slot of the first rank): every arc offers its rows to its own
    node, then what is left over to the following nodes, all arcs one step at a time."""
    room, left, begun = list(room), dict(counts), dict.fromkeys(counts, 0)
    filled = [0] * len(room)
    out = []
    for step in range(len(nodes)):
        for arc in sorted(left):
            shard = nodes[(arc + step) % len(nodes)][1]
            n = min(left[arc], room[shard])
            if n:
                out.append((arc, begun[arc] + 1, begun[arc] + n, shard, filled[shard]))
                begun[arc] += n
                filled[shard] += n
                room[shard] -= n
                left[arc] -= n
        left = {a: n for a, n in left.items() if n}
        if not left:
            break
    return out


def assign_shards(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    nodes = ring_nodes(shards, virtual_nodes)
    cells, at = [], 0
    for cell in range(CELLS):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        cells.append(at % len(nodes))
    # arcs as runs of cells: one row per node, spread over its cells by sequence()
    first: dict[int, list[tuple[int, int]]] = {}
    start = 0
    for cell in range(1, CELLS + 1):
        if cell == CELLS or cells[cell] != cells[start]:
            first.setdefault(cells[start], []).append((start, cell - 1))
            start = cell
    spans = spark.createDataFrame([(a, lo, hi) for a, runs in first.items() for lo, hi in runs], "arc int, lo int, hi int")
    ring = spans.select("arc", F.explode(F.sequence("lo", "hi")).alias("cell"))

    point = F.xxhash64(F.col(id_col))
    cell = F.pmod(point, F.lit(CELLS).cast("long")).cast("int")
    counts = (docs.select(cell.alias("cell")).join(F.broadcast(ring), "cell").groupBy("arc").count().collect())
    # at most shards * virtual_nodes rows
    per_arc = {r["arc"]: r["count"] for r in counts}
    pieces = walk(nodes, per_arc, bounds(sum(per_arc.values()), shards, slack))
    lookup = spark.createDataFrame(pieces, "arc int, lo long, hi long, shard int, base long")

    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), cell.alias("cell"), point.alias("point"),
        (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    ranked = (rows.join(F.broadcast(ring), "cell")
              .withColumn("rank", F.row_number().over(
                  Window.partitionBy("arc").orderBy("cell", "point", F.col("doc_id").asc_nulls_last(), "text_crc32", "size")).cast("long")))
    placed = ranked.join(F.broadcast(lookup.withColumnRenamed("arc", "piece_arc")),
                         (F.col("arc") == F.col("piece_arc")) & F.col("rank").between(F.col("lo"), F.col("hi")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows" if slack <= 0 else "bounded").alias("law"), "shard",
                         (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
