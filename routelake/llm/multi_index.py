"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes. Vectors are divided by the largest length of the table and lengthened by one component to
length one (queries: scaled to it, the component is zero): the largest inner product is then the
smallest distance.
On a bounded sample the principal components are taken and turned by the rotation with which
the signs of the components lose least (alternating: signs for a rotation, rotation for the
signs). The signs of the turned components are the code, ``BITS`` at most.

Index. A code is split into m substrings of about log2(rows) bits, and every vector is indexed
under each of them. Codes within Hamming radius r of a query's have, by the pigeonhole
principle, a substring within r div m (or one less for the substrings after the r mod m + first).
So a query probes, in every substring's index, the values within that distance. What is found
is kept if the whole code is within r and no earlier substring finds it too, and then ranked by
the inner products of the floats.

Radius. ``CALIBRATION`` queries are answered exactly over the whole table, and r is the distance
within which ``RECALL`` of their true neighbours lie. A query that finds fewer than k rows is asked
again with a larger radius, at last with all bits, so small tables are answered exactly.

Scale. Equal vectors are one row of the index, whatever their number. A shard of a substring's
index holds the values with the same leading bits (as many as the table needs for about
``SHARD_VALUES`` components in a shard); a shard that holds more is cut into pieces by a hash. A query is
sent only to shards whose leading bits are within its probing distance. A task holds one piece and
blocks of queries, and returns k rows per query, never pairs.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows
without id, take no part; of rows with one id the vector that sorts first counts; vectors whose
dimension is not the most frequent one (ties: the larger) cannot be compared and take no part;
with fewer than k candidates all are returned; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import python_ready, written

K = 20
#: Bits of a code (one long), fewer if the vectors have fewer components.
BITS = 64
#: Components of the sample that the rotation is learned on (rows: divided by the dimension).
SAMPLE_VALUES = 1 << 20
ROUNDS = 30
#: Queries that are answered exactly to choose the radius, and the share of their neighbours that it must reach.
CALIBRATION = 256
RECALL = 0.97
#: Components of the vectors in a shard.
SHARD_VALUES = 1 << 21


class Codes:
    """Learned rotation: codes of vectors and of queries."""

    def __init__(self, sample: np.ndarray, length: float, bits: int = BITS, rounds: int = ROUNDS, seed: int = 0):
        self.length = length
        x = self._lengthened(sample)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        bits = min(bits, x.shape[1])
        _, axes = np.linalg.eigh(x.T @ x)                  # by rising variance
        axes = axes[:, ::-1][:, :bits]
        projected = x @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
            turn = (u @ v).T
        self.turn, self.bits = axes @ turn, bits

    def _lengthened(self, x: np.ndarray) -> np.ndarray:
        x = x / self.length
        return np.column_stack([x, np.sqrt(np.maximum(1 - (x ** 2).sum(axis=1), 0))])

    def _signs(self, x: np.ndarray) -> np.ndarray:
        on = (x - self.mean) @ self.turn >= 0
        return on.astype(np.uint64) @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        return self._signs(self._lengthened(x))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))
        return self._signs(np.column_stack([x, np.zeros(len(x))]))


def substrings(bits: int, rows: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of substrings of about log2(rows) bits."""
    m = max(1, math.ceil(bits / max(1.0, math.log2(max(2, rows)))))
    ends = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def probing_radii(radius: int, parts: int) -> list[int]:
    """Per substring the distance within which one of them must be (-1: not probed)."""
    whole, rest = divmod(radius, parts)
    return [whole if i <= rest else whole - 1 for i in range(parts)]


def part_of(codes: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    low, size = part
    return (codes >> np.uint64(low)) & np.uint64((1 << size) - 1)


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; the same for the same two vectors wherever they stand."""
    return (rows * query).sum(axis=1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Shard:
    """Vectors of one substring's index, by the substring's value."""

    def __init__(self, j: int, parts, ids: np.ndarray, codes: np.ndarray, rows: np.ndarray):
        value = part_of(codes, parts[j])
        order = np.lexsort((ids, value))
        self.j, self.parts = j, parts
        self.ids, self.codes, self.rows = ids[order], codes[order], rows[order]
        self.values, starts = np.unique(value[order], return_index=True)
        self.ends = np.append(starts, len(ids))
        self.masks: dict[int, np.ndarray | None] = {}

    def _masks(self, distance: int) -> np.ndarray | None:
        """All differences within the distance; None where the index has fewer values than that."""
        if distance not in self.masks:
            size = self.parts[self.j][1]
            if sum(math.comb(size, d) for d in range(distance + 1)) >= len(self.values):
                self.masks[distance] = None
            else:
                self.masks[distance] = np.array([sum(1 << b for b in some) for d in range(distance + 1)
                                                 for some in combinations(range(size), d)], np.uint64)
        return self.masks[distance]

    def probe(self, value: np.uint64, distance: int) -> np.ndarray:
        """Positions of the vectors whose substring is within the distance."""
        masks = self._masks(distance)
        if masks is None:
            hit = np.flatnonzero(np.bitwise_count(self.values ^ value) <= distance)
        else:
            wanted = masks ^ value
            hit = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
            hit = hit[self.values[hit] == wanted]
        size = self.ends[hit + 1] - self.ends[hit]
        return np.repeat(self.ends[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())

    def search(self, query: np.ndarray, code: np.uint64, radius: int, k: int):
        """(id, score) of the k best vectors within the radius that no earlier substring finds."""
        radii = probing_radii(radius, len(self.parts))
        if radii[self.j] < 0:
            return []
        found = self.probe(part_of(code, self.parts[self.j]), radii[self.j])
        differ = self.codes[found] ^ code
        keep = np.bitwise_count(differ) <= radius
        for i in range(self.j):
            keep &= np.bitwise_count(part_of(differ, self.parts[i])) > radii[i]
        found = found[keep]
        scores = inner(self.rows[found], query)
        top = best(scores, self.ids[found], k)
        return list(zip(self.ids[found][top].tolist(), scores[top].tolist(), strict=True))


def _matrix(column, dim: int) -> np.ndarray:
    """A list column of an Arrow batch as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, one per id, all of one dimension."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    ok = (F.col(id_col).isNotNull() & (F.size(vector_col) > 0)
          & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0))
    rows = df.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).limit(1).collect()
    if dims:
        rows = rows.filter(F.size("v") == dims[0]["dim"])
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _calibrate(reps: DataFrame, codes: Codes, asked: np.ndarray, dim: int, k: int, recall: float) -> int:
    """The radius within which ``recall`` of the true neighbours of ``asked`` lie, found over all rows."""
    asked_codes = codes.of_queries(asked)

    def run(batches):
        import pyarrow as pa
        kept = [(np.empty(0), np.empty(0, np.int64)) for _ in asked]
        for part in batches:
            if not part.num_rows:
                continue
            rows, code = _matrix(part.column(0), dim), part.column(1).to_numpy().view(np.uint64)
            for i, (q, c) in enumerate(zip(asked, asked_codes, strict=True)):
                scores = np.append(kept[i][0], rows @ q)
                far = np.append(kept[i][1], np.bitwise_count(code ^ c).astype(np.int64))
                top = np.argpartition(-scores, k)[:k] if len(scores) > k else slice(None)
                kept[i] = scores[top], far[top]
        yield pa.RecordBatch.from_pydict({"q": np.repeat(np.arange(len(asked)), [len(s) for s, _ in kept]),
                                          "score": np.concatenate([s for s, _ in kept]), "far": np.concatenate([f for _, f in kept])})

    near = reps.select("v", "code").mapInArrow(run, "q long, score double, far long")
    place = Window.partitionBy("q").orderBy(F.col("score").desc(), "far")
    near = near.withColumn("at", F.row_number().over(place)).filter(F.col("at") <= k)
    # at most one row per distance
    far = sorted((r["far"], r["count"]) for r in near.groupBy("far").count().collect())
    wanted, seen = recall * sum(n for _, n in far), 0
    for distance, n in far:
        seen += n
        if seen >= wanted:
            return int(distance)
    return codes.bits


def _search(index: DataFrame, asks: DataFrame, parts, radius: int, prefix_bits: int, shard_rows: int, dim: int, k: int) -> DataFrame:
    """(asker, cls, score): per asking row the k best rows of every piece that it reaches."""
    radii = probing_radii(radius, len(parts))

    def leading(low: int, size: int) -> Column:
        top = min(prefix_bits, size)
        return F.shiftrightunsigned("code", low + size - top).bitwiseAND(F.lit((1 << top) - 1))

    def per_part(of) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(j).alias("j"), of(j, *p).alias("prefix")) for j, p in enumerate(parts) if radii[j] >= 0]))

    held = index.select("cls", "code", "v", per_part(lambda j, low, size: leading(low, size)))
    pieces = held.groupBy("j", "prefix").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("pieces"))
    held = held.join(pieces, ["j", "prefix"]).select(
        "j", "prefix", F.pmod(F.xxhash64("cls"), F.col("pieces").cast("long")).cast("int").alias("piece"), F.lit(False).alias("asks"), "cls", "code", "v")

    def reached(j: int, low: int, size: int) -> Column:
        every = F.sequence(F.lit(0).cast("long"), F.lit((1 << min(prefix_bits, size)) - 1).cast("long"))
        return F.filter(every, lambda x: F.bit_count(x.bitwiseXOR(leading(low, size))) <= radii[j])

    sent = (asks.select("cls", "code", "v", per_part(reached)).withColumn("prefix", F.explode("prefix"))
            .join(pieces, ["j", "prefix"])
            .select("j", "prefix", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("asks"), "cls", "code", "v"))

    def run(batches):
        import pyarrow as pa

        def joined(blocks):
            return (np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks]), np.concatenate([b[2] for b in blocks]))

        key, shard, points = None, None, []
        for part in batches:
            names = list(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True))
            ids, code, rows = part.column(4).to_numpy(), part.column(5).to_numpy().view(np.uint64), _matrix(part.column(6), dim)
            out, at = [], 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if names[at][:3] != key:
                    key, shard, points = names[at][:3], None, []
                if not names[at][3]:
                    points.append((ids[at:end], code[at:end], rows[at:end]))
                elif shard is None and points:
                    shard, points = Shard(key[0], parts, *joined(points)), []
                if names[at][3] and shard:
                    out += [(int(ids[i]), c, s) for i in range(at, end) for c, s in shard.search(rows[i], code[i], radius, k)]
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                              pa.array([r[2] for r in out], pa.float64())], names=["asker", "cls", "score"])

    dealt = held.unionByName(sent).repartition("j", "prefix", "piece").sortWithinPartitions("j", "prefix", "piece", "asks")
    return dealt.mapInArrow(run, "asker long, cls long, score double")


def _ranked(df: DataFrame, key: str, other: str, k: int) -> DataFrame:
    place = Window.partitionBy(key).orderBy(F.col("score").desc(), other)
    return df.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, shard_values: int = SHARD_VALUES,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest rows found: query_id, rank (from 1), vec_id, score. ``is_query``: condition on the id column."""
    spark = vectors.sparkSession
    python_ready(spark)
    rows = written(usable(vectors, id_col, vector_col).withColumnRenamed("vec_id", id_col).withColumn("asks", F.coalesce(is_query, F.lit(False)))
                   .withColumnRenamed(id_col, "vec_id"), "vectors")
    # one row per distinct vector, named by its smallest id
    classes = written(rows.groupBy("v").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("size"), F.max("asks").alias("asks")), "classes")
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest"), F.max(F.size("v")).alias("dim"),
                        F.count(F.when(F.col("asks"), 1)).alias("asking")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dim = facts["n"], facts["dim"]
    # in units of the largest component, so squares neither overflow nor vanish
    unit = F.lit(facts["largest"])
    length = facts["largest"] * math.sqrt(classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / unit) * (x / unit)))).first()[0])

    def sample(df: DataFrame, size: int, of: int) -> np.ndarray:
        """About ``size`` rows, by a hash of the vector."""
        cells = 1 << 30
        some = df.filter(F.pmod(F.xxhash64("v", F.lit(7)), F.lit(cells)) < F.lit(math.ceil(cells * min(1.0, size / max(1, of)))))
        return np.array([r[0] for r in some.select("v").collect()], float).reshape(-1, dim)

    few = sample(classes, max(CALIBRATION, SAMPLE_VALUES // dim), n)
    codes = Codes(few if len(few) else np.ones((1, dim)), length)

    def encode(batches):
        import pyarrow as pa
        for part in batches:
            if part.num_rows:
                x = _matrix(part.column(2), dim)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes.of_vectors(x).view(np.int64)), pa.array(codes.of_queries(x).view(np.int64))],
                                                 names=["cls", "asks", "v", "code", "query_code"])

    index = written(classes.select("cls", "asks", "v").mapInArrow(encode, "cls long, asks boolean, v array<double>, code long, query_code long"), "codes")
    asks = index.filter("asks").select("cls", F.col("query_code").alias("code"), "v")
    asked = sample(classes.filter("asks"), CALIBRATION, facts["asking"])
    held = index.select("cls", "code", "v")
    radius = _calibrate(held, codes, asked, dim, k + 1, recall) if len(asked) else 0

    parts, shard_rows = substrings(codes.bits, n), max(1, shard_values // dim)
    prefix_bits = max(0, math.ceil(math.log2(n / shard_rows)))
    found, wanted, waiting, step = [], min(k + 1, n), asks, len(parts)
    while True:
        # k + 1: a row finds itself too
        new = written(_ranked(_search(held, waiting, parts, radius, prefix_bits, shard_rows, dim, k + 1), "asker", "cls", k + 1).drop("rank"), "found")
        enough = new.groupBy(F.col("asker").alias("cls")).count().filter(F.col("count") >= wanted).select("cls")
        done = new.join(enough.withColumnRenamed("cls", "asker"), "asker", "left_semi") if radius < codes.bits else new
        found.append(done)
        if radius >= codes.bits:
            break
        waiting = written(waiting.join(enough, "cls", "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        radius, step = min(codes.bits, radius + step), 2 * step
    classes_near = found[0]
    for more in found[1:]:
        classes_near = classes_near.unionByName(more)

    # members of the classes: a class of one row is its own member, others are looked up by their vector
    several = classes.filter("size > 1").select("v", "cls")
    members = (classes.filter("size = 1").select("cls", F.col("cls").alias("vec_id"), "asks")
               .unionByName(rows.join(several, "v").select("cls", "vec_id", "asks")))
    first = Window.partitionBy("cls").orderBy("vec_id")
    firsts = members.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1).select("cls", "vec_id")
    per_class = written(_ranked(classes_near.join(firsts, "cls").select("asker", "vec_id", "score"), "asker", "vec_id", k + 1).drop("rank"), "answers")
    queries = members.filter("asks").select(F.col("cls").alias("asker"), F.col("vec_id").alias("query_id"))
    pairs = queries.join(per_class, "asker").filter("vec_id <> query_id")
    return _ranked(pairs.select("query_id", "vec_id", "score"), "query_id", "vec_id", k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: np.ndarray, ids: np.ndarray, query: int, k: int = K) -> list[tuple[int, float]]:
    """The true answer for the row at position ``query``, to measure recall against."""
    scores = inner(vectors, vectors[query])
    others = np.flatnonzero(ids != ids[query])
    top = others[best(scores[others], ids[others], k)]
    return list(zip(ids[top].tolist(), scores[top].tolist(), strict=True))
