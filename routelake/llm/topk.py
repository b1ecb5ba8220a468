"""Exact top-k by inner product: ball trees per shard, searched by branch and bound.

Vectors are integers, floor(256 * x) of every component, so scores are exact. For a query q and a
ball with centre c and radius r no score exceeds q.c + |q| r; this bound rules out shards, and
nodes of the tree of a shard.

Shards. The top of one ball tree is built on a bounded sample; its leaves are cells, at most
``MAX_CELLS``, and every vector belongs to the cell whose centre is nearest. The radius of a cell is
the largest distance of its vectors. A cell with more than ``shard_rows`` vectors is cut into pieces
by a hash. The task of a shard builds a ball tree over it. Nodes are taken in the order of their
bound, and the search of a query ends when the best bound left is below the query's current k-th
score (equal bounds are still searched: ties go to the smaller id).

The k-th score is shared between shards: in a first round every query is searched in its own shard
only. The k-th score found there decides which cells it is sent to, and is where its search
begins in them, so these return only what can still enter the result.

Scale. Query vectors are sent to the shards that their bound reaches, in blocks, never candidates
to every query; a task streams the blocks past the one tree that it holds. Rows of a result are at
most k per query and shard before the last aggregate. Centres and radii of the cells are all that is
broadcast. On vectors without any clusters no bound rules a cell out, and every query reaches every shard.

Defined cases: vectors that are null, empty or hold a null or non-finite component, and rows
without id, take no part; vectors meet only vectors of the same dimension; a candidate with the
query's id counts as its own, and rows that repeat an id and vector count once; scores beyond 64 bits are cut to
its ends; with fewer than k candidates all are returned; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import python_ready, written

K = 5
SCALE = 256
SHARD_ROWS = 8192
LEAF_ROWS = 64
#: Cells of a dimension's space, and components of the sample that they are built on.
MAX_CELLS = 1024
SAMPLE_VALUES = 1 << 21
#: Query vectors in a block.
BLOCK_ROWS = 256
FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes in arrays; leaves are ranges of the reordered rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        centres, radii, self.children, self.ranges = [], [], [], []

        def node(lo: int, hi: int) -> int:
            n = len(centres)
            part = rows[order[lo:hi]]
            centre = part.mean(axis=0)
            far = np.sqrt(((part - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(far.max())
            self.children.append(None)
            self.ranges.append((lo, hi))
            if hi - lo > leaf_rows and radii[n] > 0:
                # split along the line between a far point and the point farthest from it
                a = part[far.argmax()]
                b = part[((part - a) ** 2).sum(axis=1).argmax()]
                along = part @ (b - a)
                middle = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(along, middle)]
                self.children[n] = (node(lo, lo + middle), node(lo + middle, hi))
            return n

        node(0, len(ids))
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.ids, self.rows = ids[order], rows[order]
        self.exact = float(np.abs(self.rows).max(initial=0))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, k: int):
        """(query_id, vec_id, score) of every query's k best candidates of at least its score ``least``."""
        length = np.sqrt((queries ** 2).sum(axis=1))
        bounds = queries @ self.centres.T + length[:, None] * self.radii[None, :]
        bounds += 1e-9 * (1 + np.abs(bounds) + length[:, None] * np.sqrt((self.centres ** 2).sum(axis=1))[None, :])
        out = []
        for i, own in enumerate(query_ids):
            bound, q = bounds[i], queries[i]
            whole = self.exact * float(np.abs(q).max(initial=0)) * len(q) < 2 ** 53
            floor, best = least[i], []                     # best: heap of (score, -vec_id)
            nodes = [(-bound[0], 0)]
            while nodes and -nodes[0][0] >= floor:
                n = heapq.heappop(nodes)[1]
                if self.children[n]:
                    for child in self.children[n]:
                        if bound[child] >= floor:
                            heapq.heappush(nodes, (-bound[child], child))
                    continue
                lo, hi = self.ranges[n]
                if whole:
                    scores = self.rows[lo:hi] @ q
                    some = np.flatnonzero(scores >= floor)
                    pairs = zip(scores[some].tolist(), self.ids[lo:hi][some].tolist(), strict=True)
                else:                                      # beyond exact doubles: whole numbers
                    big = [int(x) for x in q]
                    pairs = ((max(-2 ** 63, min(2 ** 63 - 1, sum(a * int(b) for a, b in zip(big, r, strict=True)))), v)
                             for r, v in zip(self.rows[lo:hi], self.ids[lo:hi].tolist(), strict=True))
                for score, v in pairs:
                    if v == own or score < floor:
                        continue
                    item = (int(score), -v)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    if len(best) == k:
                        floor = max(floor, best[0][0])
            out += [(int(own), -v, s) for s, v in best]
        return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & finite
    return df.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"), F.size(vector_col).alias("dim"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS, scale: int = SCALE,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest scores: query_id, rank (from 1), vec_id, score. ``is_query``: condition on the id column."""
    spark = vectors.sparkSession
    python_ready(spark)
    rows = usable(vectors, id_col, vector_col).dropDuplicates(["vec_id", "v"])
    centres = _cell_centres(rows, shard_rows, scale)
    located = written(_located(rows, centres, scale), "vectors")
    cells = located.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("pieces"), F.max("far").alias("radius"))
    # every (dimension, cell) has its own shards; their number follows its number of rows
    piece = F.pmod(F.xxhash64("vec_id"), F.col("pieces").cast("long"))
    dealt = located.join(cells.drop("radius"), ["dim", "cell"]).withColumn("shard", _shard(F.col("cell"), piece))
    queries = (dealt.withColumnRenamed("vec_id", id_col).filter(is_query).select(F.col(id_col).alias("vec_id"), "v", "dim", "shard"))
    first = written(_search(dealt, queries.withColumn("least", F.lit(None).cast("double")), k, scale), "seeds")
    # a query without k results so far has no k-th score to share
    kth = (first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
           .select("vec_id", F.when(F.col("n") >= k, F.col("least").cast("double")).alias("least")))
    radii: dict[int, dict[int, float]] = {}
    for r in cells.filter(F.col("dim").isin(list(centres))).select("dim", "cell", "radius").collect() if centres else ():
        radii.setdefault(r["dim"], {})[r["cell"]] = r["radius"]     # at most MAX_CELLS numbers for each of these dimensions
    reached = _reached(queries.join(kth, "vec_id", "left").withColumnRenamed("shard", "home"), centres, radii, scale)
    spread = (reached.join(cells.drop("radius"), ["dim", "cell"])
              .withColumn("shard", F.explode(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: _shard(F.col("cell"), p.cast("long")))))
              .filter("shard <> home").drop("home"))
    rest = _search(dealt, spread, k, scale)
    # a query id with several vectors: each score counts for the id
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (first.unionByName(rest).distinct().withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _shard(cell: Column, piece: Column) -> Column:
    return cell.cast("long") * F.lit(1 << 32) + piece


def _rows_of(part, at: int) -> list[np.ndarray]:
    """A list column of an Arrow batch as arrays."""
    values = part.column(at)
    flat, ends = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _cell_centres(rows: DataFrame, shard_rows: int, scale: int) -> dict[int, np.ndarray]:
    """Centres of the cells of every dimension that needs more than one shard, from a sample taken by a hash."""
    out, cut = {}, 1 << 30
    for dim, n in rows.groupBy("dim").count().filter(F.col("count") > shard_rows).collect():
        leaves = min(MAX_CELLS, math.ceil(n / shard_rows))
        size = max(leaves, SAMPLE_VALUES // dim)
        some = rows.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("v", F.lit(3)), F.lit(cut)) < F.lit(math.ceil(cut * min(1.0, size / n)))))
        x = np.floor(scale * np.array([r[0] for r in some.select("v").collect()], float).reshape(-1, dim))
        if len(x):
            tree = BallTree(np.arange(len(x)), x, leaf_rows=math.ceil(len(x) / leaves))
            out[dim] = np.array([c for c, below in zip(tree.centres, tree.children, strict=True) if below is None])
    return out


def _located(rows: DataFrame, centres: dict[int, np.ndarray], scale: int) -> DataFrame:
    """The rows with their cell and their distance from its centre (one cell where there are no centres)."""
    def run(batches):
        import pyarrow as pa
        for part in batches:
            vectors, dims = _rows_of(part, 1), part.column(2).to_numpy()
            cell, far = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            for dim in set(dims.tolist()) & centres.keys():
                mine = np.flatnonzero(dims == dim)
                c = centres[dim]
                for at in range(0, len(mine), 512):
                    some = mine[at:at + 512]
                    x = np.floor(scale * np.stack([vectors[i] for i in some]))
                    cell[some] = ((c ** 2).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)
                    far[some] = np.sqrt(((x - c[cell[some]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(far)], names=["vec_id", "v", "dim", "cell", "far"])

    return rows.select("vec_id", "v", "dim").mapInArrow(run, "vec_id long, v array<double>, dim int, cell int, far double")


def _reached(queries: DataFrame, centres: dict[int, np.ndarray], radii: dict[int, dict[int, float]], scale: int) -> DataFrame:
    """The queries (vec_id, v, dim, home, least) once for every cell in which a score of at least ``least`` is possible."""
    def run(batches):
        import pyarrow as pa
        for part in batches:
            vectors, dims, least = _rows_of(part, 1), part.column(2).to_pylist(), part.column(4).to_pylist()
            row, cell = [], []
            for i, (v, dim) in enumerate(zip(vectors, dims, strict=True)):
                if dim not in centres:
                    row.append(i)
                    cell.append(0)
                    continue
                q, c = np.floor(scale * v), centres[dim]
                length = np.sqrt((q ** 2).sum())
                radius = np.array([radii[dim].get(j, 0.0) for j in range(len(c))])
                bound = c @ q + length * radius
                bound += 1e-9 * (1 + np.abs(bound) + length * np.sqrt((c ** 2).sum(axis=1)))
                some = np.arange(len(c)) if least[i] is None else np.flatnonzero(~(bound < least[i]))
                row += [i] * len(some)
                cell += some.tolist()
            taken = part.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32())], names=["vec_id", "v", "dim", "home", "least", "cell"])

    return (queries.select("vec_id", "v", "dim", "home", "least")
            .mapInArrow(run, "vec_id long, v array<double>, dim int, home long, least double, cell int"))


def _search(candidates: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    """Searches each query in the shard that it names; candidates come first in every shard, then the queries in blocks."""
    side = candidates.select("dim", "shard", F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("double").alias("least"))
    stream = side.unionByName(queries.select("dim", "shard", F.lit(True).alias("asks"), "vec_id", "v", "least"))

    def run(batches):
        import pyarrow as pa

        def vectors(rows):
            return np.floor(scale * np.stack([r[4] for r in rows])), np.array([r[3] for r in rows], np.int64)

        def answers(tree, rows):
            if tree is None or not rows:
                return []
            q, ids = vectors(rows)
            return tree.search(q, ids, np.array([-np.inf if r[5] is None else r[5] for r in rows]), k)

        def batch(found):
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        shard, tree, points, block = None, None, [], []
        for part in batches:
            columns = [part.column(i).to_pylist() for i in (0, 1, 2, 3)] + [_rows_of(part, 4), part.column(5).to_pylist()]
            for row in zip(*columns, strict=True):
                if row[:2] != shard:
                    yield batch(answers(tree, block))
                    shard, tree, points, block = row[:2], None, [], []
                if not row[2]:
                    points.append(row)
                    continue
                if points:
                    rows, ids = vectors(points)
                    tree, points = BallTree(ids, rows), []
                block.append(row)
                if len(block) >= BLOCK_ROWS:
                    yield batch(answers(tree, block))
                    block = []
        yield batch(answers(tree, block))

    return stream.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks").mapInArrow(run, FOUND)
