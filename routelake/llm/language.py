"""Language identification by hierarchical discrimination.

A text becomes the L2-normalised square roots of its hashed character 1- to 3-gram counts
(letters lower-cased, everything else one space), from the whole text. A first linear
classifier predicts the language family; within the family, one-versus-one linear support
vector machines tell its languages apart by votes, ties by the sum of margins.

Families come from the training rows: languages that are each other's nearest neighbour (by
cosine of their mean vectors) are put together; a language whose nearest neighbour prefers
another one stays alone. All machines are L2-regularised squared-hinge machines, trained by
dual coordinate descent on the driver.

Training rows: at most ``SAMPLE_ROWS`` labelled rows of every language, those with the
smallest hash of (id, text) among a cut by hash, of at most ``MAX_LANGUAGES`` languages, the most
frequent labels (ties: the smaller label); that sample is the documented bound of what reaches the
driver. Labels are counted first, so the cut lets about ``CUT`` times the sample of a language
pass, however many rows it has, and only those are ranked.
Prediction uses the text alone.

Score: probability of the family (softmax of its margins) times the smallest logistic margin
of the language against the others of its family; in 0 to 1. It only ranks the learned languages.

Evidence: whether a text is in a learned language at all, whatever their number. Every language has
the log-likelihood ratio of its grams against even chance; the upper bound of a text's mean ratio
(``BOUND`` standard errors by its distinct grams, so a short text is given the doubt) is divided by
the median of the language's own training rows, each scored without its fold. The best language counts.
A language with one distinct training text has no such median; a text then only has to beat chance.

Defined cases: null text or text without a letter is ``und`` with score 0; a label that is
null is never learned; with one learned language every other text gets it; with none, every
text is ``und``; repeated rows are sampled once and predicted each; an empty table gives an
empty result. ``identify`` ignores other columns, ``keep_identified`` returns them as they are.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import python_ready, slices

BUCKETS = 4096
SAMPLE_ROWS = 500
MAX_LANGUAGES = 256
CUT = 4
#: Training: passes over the sample, cost of a margin violation, scale of margins in scores.
PASSES, COST, SHARPNESS = 12, 4.0, 4.0
UNKNOWN = "und"
#: Below this evidence a text is in none of the learned languages, for ``keep_identified``.
LEAST_EVIDENCE = 0.65
#: Standard errors of a text's evidence, share of even chance in a language's gram frequencies,
#: folds of its training rows, and the least that counts as its median.
BOUND, CHANCE, FOLDS, LEAST_TYPICAL = 2.0, 0.1, 5, 0.05
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(text: str | None) -> np.ndarray | None:
    """The vector of a text, or None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    counts = np.zeros(BUCKETS)
    for n in (1, 2, 3):
        gram = np.zeros(len(codes) - n + 1, np.uint32)
        for k in range(n):
            gram = (gram ^ codes[k:len(codes) - n + 1 + k]) * _K[k] + np.uint32(n)
        counts += np.bincount((gram ^ (gram >> np.uint32(15))) * _K[1] >> np.uint32(20), minlength=BUCKETS)
    out = np.sqrt(counts)
    return (out / np.sqrt(counts.sum())).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, passes: int = PASSES, cost: float = COST) -> np.ndarray:
    """Weights of a linear machine for labels +1 and -1 (last column of x: bias); classes weigh alike."""
    weight = np.zeros(x.shape[1])
    alpha = np.zeros(len(y))
    each = cost * len(y) / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))
    square = (x * x).sum(axis=1) + 0.5 / each
    order = np.random.RandomState(7)
    for _ in range(passes):
        for i in order.permutation(len(y)):
            step = (y[i] * (weight @ x[i]) - 1 + 0.5 * alpha[i] / each[i]) / square[i]
            new = max(0.0, alpha[i] - step)
            if new != alpha[i]:
                weight += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return weight


class Hierarchy:
    """families: languages of every family; above: weights per family; pairs: weights of (a, b), positive for a."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        label = np.array(labels)
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        self.families = self._families(x, label)
        family = {lang: i for i, f in enumerate(self.families) for lang in f}
        of = np.array([family[v] for v in labels]) if labels else np.empty(0, int)
        many = len(self.families) > 1
        self.above = [svm(x, np.where(of == i, 1.0, -1.0)) for i in range(len(self.families))] if many else []
        self.pairs = {}
        for f in self.families:
            for i, a in enumerate(f):
                for b in f[i + 1:]:
                    rows = (label == a) | (label == b)
                    self.pairs[a, b] = svm(x[rows], np.where(label[rows] == a, 1.0, -1.0))
        own = [own_grams(x[label == v, :-1]) for v in self.languages]
        self.ratios = np.array([o[0] for o in own], np.float32).reshape(len(own), BUCKETS)
        self.typical, self.spread = np.array([o[1] for o in own]), np.array([o[2] for o in own])

    def _families(self, x: np.ndarray, label: np.ndarray) -> list[list[str]]:
        if len(self.languages) < 3:
            return [self.languages] if self.languages else []
        mean = np.array([x[label == v, :-1].mean(axis=0) for v in self.languages])
        mean = mean - mean.mean(axis=0)
        mean /= np.maximum(np.sqrt((mean ** 2).sum(axis=1, keepdims=True)), 1e-12)
        near = mean @ mean.T
        np.fill_diagonal(near, -np.inf)
        nearest = near.argmax(axis=1)
        out = []
        for i, j in enumerate(nearest):
            mutual = nearest[j] == i
            if not mutual or i < j:
                out.append([self.languages[i], self.languages[j]] if mutual else [self.languages[i]])
        return out

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        if self.above:
            margin = SHARPNESS * (x @ np.array(self.above).T)
            share = np.exp(margin - margin.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            family, score = share.argmax(axis=1), share.max(axis=1)
        else:
            family, score = np.zeros(len(x), int), np.ones(len(x))
        out = np.empty(len(x), object)
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            votes, total, least = np.zeros((len(rows), len(f))), np.zeros((len(rows), len(f))), np.ones((len(rows), len(f)))
            for a in range(len(f)):
                for b in range(a + 1, len(f)):
                    margin = x[rows] @ self.pairs[f[a], f[b]]
                    for k, m in ((a, margin), (b, -margin)):
                        votes[:, k] += m > 0
                        total[:, k] += m
                        least[:, k] = np.minimum(least[:, k], 1 / (1 + np.exp(-SHARPNESS * m)))
            best = np.lexsort((total, votes), axis=1)[:, -1] if len(f) > 1 else np.zeros(len(rows), int)
            out[rows] = np.array(f, object)[best]
            score[rows] *= least[np.arange(len(rows)), best]
        return list(out), score

    def evidence(self, x: np.ndarray) -> np.ndarray:
        mean = (x * x) @ self.ratios.T
        error = self.spread / np.sqrt((x > 0).sum(axis=1, keepdims=True))
        return ((mean + BOUND * error) / self.typical).max(axis=1)


def own_grams(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Log ratios of a language's grams to even chance; median over its texts and spread over their grams of those
    ratios, for every text learned from the other folds. Equal texts are in one fold."""
    def ratios(rows):
        return np.log((1 - CHANCE) * BUCKETS * rows.mean(axis=0) + CHANCE)

    share = x * x
    seen: dict[bytes, int] = {}
    fold = np.array([seen.setdefault(v.tobytes(), len(seen)) for v in x]) % FOLDS
    mean, square = np.zeros(len(x)), np.zeros(len(x))
    if len(seen) < 2:
        return ratios(share), LEAST_TYPICAL, 0.0
    for k in range(min(FOLDS, len(seen))):
        r = ratios(share[fold != k])
        mean[fold == k], square[fold == k] = share[fold == k] @ r, share[fold == k] @ (r * r)
    return ratios(share), max(LEAST_TYPICAL, float(np.median(mean))), float(np.sqrt(np.maximum(square - mean * mean, 0).mean()))


def held_out(id_col: Column) -> Column:
    """Rows that training leaves out: crc32 of the id as text, modulo 4, is 2; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, use: Column | None = None, sample_rows: int = SAMPLE_ROWS,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy:
    """Learns from rows where ``use`` holds and the label is not null."""
    python_ready(docs.sparkSession)
    use = F.lit(True) if use is None else use
    rows = docs.filter(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    labels = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES).collect()
    if not labels:
        return Hierarchy(np.empty((0, BUCKETS), np.float32), [])
    # hashes below a language's limit; at most MAX_LANGUAGES of them
    cells = 1 << 40
    limits = F.create_map(*[F.lit(x) for r in labels for x in (r["lang"], math.ceil(cells * min(1.0, CUT * sample_rows / r["count"])))])
    cut = rows.filter(F.pmod("key", F.lit(cells)) < F.element_at(limits, F.col("lang")))

    def smallest(batches):
        import pyarrow as pa
        kept: dict[str, set] = {}
        for part in batches:
            for lang, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                mine = kept.setdefault(lang, set())
                mine.add(key)
                if len(mine) >= 2 * sample_rows:
                    kept[lang] = set(sorted(mine)[:sample_rows])
        out = [(lang, key) for lang, mine in kept.items() for key in sorted(mine)[:sample_rows]]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], names=["lang", "key"])

    best = Window.partitionBy("lang").orderBy("key")
    keys = (cut.select("lang", "key").mapInArrow(smallest, "lang string, key long").distinct()
            .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= sample_rows).select("lang", "key"))
    # MAX_LANGUAGES * sample_rows keys at most
    sample = cut.join(F.broadcast(keys), ["lang", "key"]).groupBy("lang", "key").agg(F.first("text").alias("text"))

    def run(batches):
        import pyarrow as pa
        for part in slices(batches):
            found = [(lang, key, v) for lang, key, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)
                     if (v := features(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()),
                                              pa.array([f[2].tobytes() for f in found], pa.binary())], names=["lang", "key", "v"])

    got = sorted((r.lang, r.key, bytes(r.v)) for r in sample.mapInArrow(run, "lang string, key long, v binary").collect())
    x = np.array([np.frombuffer(v, np.float32) for _, _, v in got], np.float32).reshape(len(got), BUCKETS)
    return Hierarchy(x, [lang for lang, _, _ in got])


def identify(docs: DataFrame, model: Hierarchy, keep: list[Column], text_col: str = "text", evidence: bool = False) -> DataFrame:
    """The columns ``keep`` and lang_pred, score, on demand evidence, row by row."""
    spark: SparkSession = docs.sparkSession
    python_ready(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("_text_to_identify"))
    at = len(rows.columns) - 1
    schema = T.StructType([*rows.schema.fields[:at], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           *([T.StructField("evidence", T.DoubleType())] if evidence else [])])

    def run(batches):
        import pyarrow as pa
        model = sent.value
        for part in slices(batches):
            vectors = [features(t) for t in part.column(at).to_pylist()]
            some = [i for i, v in enumerate(vectors) if v is not None] if model.languages else []
            lang, score, proof = np.full(len(vectors), UNKNOWN, object), np.zeros(len(vectors)), np.zeros(len(vectors))
            if some:
                x = np.array([vectors[i] for i in some])
                found, score[some] = model.predict(x)
                lang[some] = found
                if evidence:
                    proof[some] = model.evidence(x)
            yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              *([pa.array(proof, pa.float64())] if evidence else [])], names=schema.names)

    return rows.mapInArrow(run, schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out; doc_id, held_out, lang_pred, score of every row."""
    out = held_out(F.col("doc_id"))
    model = train(docs, ~out)
    return identify(docs, model, [F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out")])


def keep_identified(docs: DataFrame, least: float = LEAST_EVIDENCE) -> DataFrame:
    """The rows, with all their columns, whose text is in one of the languages learned from them: not ``und``, and
    evidence of ``least`` or more."""
    model = train(docs, ~held_out(F.col("doc_id")))
    found = identify(docs, model, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")], evidence=True)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("evidence") >= least)).select("row.*")
