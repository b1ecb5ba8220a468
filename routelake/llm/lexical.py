"""Ranked lexical search: hashed max-sketches give upper bounds, exact rescoring ends at the threshold.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with only A-Z
lower-cased. With N documents that hold a term, L terms in all of them and df documents with a
term, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))). A document of n terms has
m = 100 - 75 + (75 n N) div L; a term that occurs tf times in it has the impact
(10^9 tf) div (1000 tf + 8 m), and the document's score is the sum of w * impact over the
query's terms with repeats.

Sketch. A document's impacts are folded into ``CELLS`` hashed cells; a cell holds the maximum of
the impacts that fall into it. The sum of w * cell over a query's terms therefore is at least the
score. Since m is the same for all terms of a document and the impact grows with tf, the maximum
of the impacts is the impact of the maximal tf: the cells take tf.

Steps:

1. queries travel to the tasks in blocks of about ``BLOCK_TERMS`` terms and ``BLOCK_QUERIES`` queries at
   most, each a broadcast of that size;
2. a pass over the texts counts N, L, and df of the terms of several blocks, ``COUNT_TERMS`` at most
   (more only where one block has more), so nothing of the vocabulary is shuffled or kept;
3. in a pass per block a task folds a batch of documents into sketches, multiplies them with the
   block's weights (one matrix product gives all bounds of batch and block), and takes every
   query's documents in the order of falling bounds. They are rescored exactly until the bound is
   below the query's k-th score so far, which goes on from batch to batch;
4. a task returns k rows per query at most; the best of all tasks' rows are ranked.

Texts are never shuffled. A task holds one batch of documents and k results per query.

Defined cases: null texts and texts without a term are not counted in N and never returned; rows
without id count in N, L and df but cannot be returned; repeated rows are documents of their
own; query rows with a null id are left out, and rows with one id are one query with the terms
of all its distinct texts; ties go to the smaller id; an empty table gives an empty result; other columns
are ignored. Products stay exact while (10^9 tf) is below 2^63.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import python_ready, slices, written

K = 10
#: Cells of a sketch.
CELLS = 2048
#: Documents whose sketches are multiplied with the queries' weights at once.
BATCH_DOCS = 256
#: Terms, and queries, that are broadcast together.
BLOCK_TERMS = 50_000
BLOCK_QUERIES = 1024
#: Terms whose document frequencies are counted in one pass over the texts.
COUNT_TERMS = 500_000
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20

# ASCII characters that separate terms become spaces; A-Z become a-z; all other bytes of UTF-8 are kept
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes):
    """The terms of a text in UTF-8, piece by piece (lists), so a very long text needs no list of all its terms."""
    if len(text) <= PIECE:
        yield text.translate(_FOLD).split()
        return
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(text: bytes) -> Counter:
    out: Counter = Counter()
    for terms in terms_of(text):
        out.update(terms)
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_factor(n, n_docs: int, n_terms: int):
    return 100 - 75 + (75 * n * n_docs) // n_terms


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, n) of the queries' terms with their number of occurrences; terms are binary."""
    python_ready(queries.sparkSession)

    def run(batches):
        import pyarrow as pa
        for part in slices(batches):
            rows = [(i, t, n) for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    if text for t, n in term_counts(text).items()]
            yield pa.RecordBatch.from_pydict({c: [r[k] for r in rows] for k, c in enumerate(("item_id", "term", "n"))},
                                             schema=pa.schema([("item_id", pa.int64()), ("term", pa.binary()), ("n", pa.int64())]))

    rows = (queries.filter(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).distinct())
    return rows.mapInArrow(run, "item_id long, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def corpus_counts(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, n_docs, n_terms): per given term its document frequency; the row with a null term has N and L."""
    known = docs.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches):
        import pyarrow as pa
        df: Counter = Counter()
        n_docs = n_terms = 0
        wanted = known.value
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                if not text:
                    continue
                found, n = set(), 0
                for piece in terms_of(text):
                    n += len(piece)
                    found |= wanted.intersection(piece)
                if n:
                    n_docs += 1
                    n_terms += n
                    df.update(found)
        yield pa.RecordBatch.from_pydict({"term": [None, *df], "n_docs": [n_docs, *df.values()], "n_terms": [n_terms] + [0] * len(df)},
                                         schema=pa.schema([("term", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())]))

    rows = _texts(docs, id_col, text_col).select("text").mapInArrow(run, "term binary, n_docs long, n_terms long")
    return rows.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms"))


class Sketches:
    """A batch of documents: exact term counts, and maxima of tf per hashed cell."""

    def __init__(self, counts: list[Counter], cells: int):
        self.counts = counts
        size = [len(c) for c in counts]
        cell = np.fromiter((zlib.crc32(t) % cells for c in counts for t in c), np.int64, sum(size))
        tf = np.fromiter((n for c in counts for n in c.values()), np.int64, sum(size))
        self.n = np.fromiter((sum(c.values()) for c in counts), np.int64, len(counts))
        self.most = np.zeros((len(counts), cells), np.int64)
        np.maximum.at(self.most, (np.repeat(np.arange(len(counts)), size), cell), tf)

    def impacts(self, n_docs: int, n_terms: int) -> np.ndarray:
        m = length_factor(self.n, n_docs, n_terms)[:, None]
        out = np.zeros(self.most.shape)
        d, c = np.nonzero(self.most)
        out[d, c] = impact(self.most[d, c], m[d, 0])
        return out


class QueryBlock:
    """Queries with their terms' weights, and the same folded into the cells of a sketch."""

    def __init__(self, rows: list[tuple[int, bytes, int, int]], cells: int):
        """rows: (item_id, term, occurrences, w)."""
        by: dict[int, list] = {}
        for item, term, n, w in rows:
            by.setdefault(item, []).append((term, n * w))
        self.items = list(by)
        self.terms = [by[i] for i in self.items]
        self.folded = np.zeros((cells, len(self.items)))
        for i, terms in enumerate(self.terms):
            for t, w in terms:
                self.folded[zlib.crc32(t) % cells, i] += w


class Search:
    """The k best documents of every query of a block, over batches of documents."""

    def __init__(self, block: QueryBlock, n_docs: int, n_terms: int, k: int = K):
        self.block, self.n_docs, self.n_terms, self.k = block, n_docs, n_terms, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in block.items]      # heaps of (score, -doc_id)
        self.rescored = 0

    def add(self, ids: np.ndarray, sketches: Sketches) -> None:
        bounds = sketches.impacts(self.n_docs, self.n_terms) @ self.block.folded
        bounds += 1e-9 * bounds                           # sums beyond 2^53 are rounded
        factors = length_factor(sketches.n, self.n_docs, self.n_terms)
        least = np.array([h[0][0] if len(h) == self.k else 1 for h in self.best], float)
        for q in np.flatnonzero((bounds >= least[None, :]).any(axis=0)):
            heap, terms = self.best[q], self.block.terms[q]
            order = np.flatnonzero(bounds[:, q] >= least[q])
            for d in order[np.argsort(-bounds[order, q], kind="stable")]:
                if len(heap) == self.k and bounds[d, q] < heap[0][0]:
                    break
                counts, m = sketches.counts[d], int(factors[d])
                self.rescored += 1
                score = sum(w * impact(tf, m) for t, w in terms if (tf := counts.get(t)))
                if score <= 0:
                    continue
                item = (score, -int(ids[d]))
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)

    def rows(self):
        return [(item, -d, s) for item, heap in zip(self.block.items, self.best, strict=True) for s, d in heap]


def _search_block(docs: DataFrame, rows, n_docs: int, n_terms: int, k: int, cells: int) -> DataFrame:
    block = docs.sparkSession.sparkContext.broadcast(QueryBlock(rows, cells))

    def run(batches):
        import pyarrow as pa
        search = Search(block.value, n_docs, n_terms, k)
        for part in slices(batches, BATCH_DOCS):
            kept = [(i, c) for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    if i is not None and text and (c := term_counts(text))]
            if kept:
                search.add(np.array([i for i, _ in kept]), Sketches([c for _, c in kept], cells))
        out = search.rows()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = K, cells: int = CELLS, block_terms: int = BLOCK_TERMS, count_terms: int = COUNT_TERMS,
           doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each query's k best documents with a score above 0: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    python_ready(spark)
    asked = written(query_terms(queries, item_id, text_col), "terms")
    # blocks of whole queries, of about block_terms terms each
    size = asked.agg(F.count(F.lit(1)).alias("terms"), F.countDistinct("item_id").alias("items")).first()
    blocks = max(1, math.ceil(size["terms"] / block_terms), math.ceil(size["items"] / BLOCK_QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    texts, results = _texts(docs, doc_id, text_col), []
    together = max(1, count_terms // block_terms)          # blocks whose terms are counted in one pass
    for start in range(0, blocks, together):
        group = asked.filter(F.col("block").between(start, start + together - 1))
        terms = [bytes(r["term"]) for r in group.select("term").distinct().collect()]
        counts = written(corpus_counts(docs, terms, doc_id, text_col).withColumnRenamed("n_docs", "df"), f"counts-{start}")
        whole = counts.filter("term IS NULL").first()
        if not whole or not whole["df"]:
            continue
        n_docs, n_terms = whole["df"], whole["n_terms"]
        # terms that no document holds add nothing
        known = group.join(counts.select("term", "df"), "term")
        for b in range(start, min(start + together, blocks)):
            rows = known.filter(F.col("block") == b).select("item_id", "term", "n", "df").collect()
            weighted = [(r["item_id"], bytes(r["term"]), r["n"], weight(n_docs, r["df"])) for r in rows]
            if weighted:
                results.append(written(_search_block(texts, weighted, n_docs, n_terms, k, cells), f"found-{b}"))
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for r in results:
        out = out.unionByName(r)
    place = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return (out.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
