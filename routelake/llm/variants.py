"""Spelling variants: words at edit distance one, found in a frequency-vector trie.

A word's frequency vector holds, per letter group, how many of its letters fall into the group.
One inserted letter raises one count by one, one deleted letter lowers one, one replaced letter
does both or neither. So words at distance one differ by a surplus of at most one and a deficit
of at most one in all. The trie arranges words by the counts of one group after the other; a
depth-first search walks it with the words that ask, and each of them spends its surplus and
its deficit on the way. Words that meet in a leaf are verified letter by letter.

Steps:

1. ``count_words``: occurrences are counted per task and then per word;
2. letter groups: letters are dealt to ``GROUPS`` groups in the order of their frequency, always
   to the lightest group, so counts discriminate (a table of at most 256 letters);
3. shards: the subtrees below the trie's first levels. The number of these levels is the smallest
   at which no subtree holds more than ``SHARD_WORDS`` words; one that still does at the last level
   is cut into pieces by a hash;
4. every word is at home in one shard and visits those that it can reach with its budget, each
   pair of shards in one direction only. A task walks the trie of one shard with all its
   visitors at once (arrays of visitors, split at every node);
5. pairs leave a task as per-word sums: the number of near words and the most frequent one. So
   neither a word with many near words nor a group of words near each other makes rows by pairs;
6. roots: forms are followed by pointer doubling. A form is at least ``ratio`` times as frequent as
   its word, so chains are at most log(largest count) long and cannot be circular.

Letters are ``[A-Za-z\\u00C0-\\u00FF]``; words are maximal runs of them with A-Z lower-cased.

Defined cases: null and empty texts hold no word; a word of any length is compared whole; rows
with equal id and text are rows of their own; a null id counts as an empty one in the hash of
``drop_every``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import python_ready, slices, written

MIN_LENGTH = 7
LEAST = 2
RATIO = 10
GROUPS = 16
SHARD_WORDS = 20_000
#: Words that a task counts before it hands its sums on.
MEMO_WORDS = 400_000
#: Visitors of a shard that walk its trie together.
BLOCK_WORDS = 20_000
#: Below so many (visitor, word) combinations a node's words are compared with its visitors directly.
DIRECT = 16_384
#: Leaves whose pairs are gathered before they are verified.
MET_LEAVES = 256
#: Letters of a word that are verified as arrays; longer words are verified one by one.
WIDTH = 32

#: Byte (Latin-1) to the letter it counts as; all others separate words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))

_WORD = "word string, n long"
_SUMS = "word string, n_near long, form struct<n:long,word:string>"


def words_of(text: str) -> list[bytes]:
    """The words of a text, in Latin-1 (which holds all the letters)."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, least: int = LEAST, drop_every: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with at least ``min_length`` letters and ``least`` occurrences.

    ``drop_every``: where it divides the CRC-32 of ``<id>:<word>``, every occurrence of the word in
    that document loses the letter at the CRC modulo its length (planted misspellings)."""
    python_ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        def sums():
            out = pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in counts], "n": list(counts.values())},
                                             schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))
            counts.clear()
            return out

        counts: dict[bytes, int] = {}
        get = counts.get
        for part in slices(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                in_doc: dict[bytes, int] = {}
                for w in words_of(text) if text else ():
                    if len(w) >= min_length:
                        in_doc[w] = in_doc.get(w, 0) + 1
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in in_doc.items():
                    if drop_every:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % drop_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                            if len(w) < min_length:
                                continue
                    counts[w] = get(w, 0) + n
                if len(counts) >= MEMO_WORDS:
                    yield sums()
        yield sums()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _WORD).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[str]:
    """The letters of each group. At most 256 letters exist, so the counts that are collected are bounded."""
    letter = F.explode(F.split("word", "")).alias("letter")
    seen = words.select(letter).filter("letter <> ''").groupBy("letter").count().collect()
    out, load = [""] * groups, [0] * groups
    for letter, n in sorted(seen, key=lambda r: (-r[1], r[0])):
        g = load.index(min(load))
        out[g] += letter
        load[g] += n
    return [g for g in out if g]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter turns ``a`` into ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


class Words:
    """Words as arrays: frequency vectors, and letters aligned at the start and at the end."""

    def __init__(self, letters: list[bytes], group_of: np.ndarray, groups: int):
        self.letters = letters
        self.size = np.fromiter(map(len, letters), np.int64, len(letters))
        # letters of all words in a row; each adds one to the count of its word and group
        flat = group_of[np.frombuffer(b"".join(letters), np.uint8)]
        cell = np.repeat(np.arange(len(letters)), self.size) * groups + flat
        self.counts = np.bincount(cell, minlength=len(letters) * groups).reshape(len(letters), groups).astype(np.int32)
        short = [w if len(w) <= WIDTH else b"" for w in letters]
        self.front = np.array(short, f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH)
        self.back = np.array([w[::-1] for w in short], f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH)

    def taken(self, order: np.ndarray) -> Words:
        out = object.__new__(Words)
        out.letters = [self.letters[i] for i in order]
        out.size, out.counts, out.front, out.back = (x[order] for x in (self.size, self.counts, self.front, self.back))
        return out


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters up to the first difference, row by row (WIDTH if there is none)."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)


def verified(home: Words, h: np.ndarray, visitors: Words, v: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart: what they share ahead and behind covers all but one letter of the longer."""
    size, other = home.size[h], visitors.size[v]
    ok = np.zeros(len(h), bool)
    longer = np.maximum(size, other)
    short = np.flatnonzero((longer <= WIDTH) & (abs(size - other) <= 1))
    for at in range(0, len(short), 1 << 16):
        s = short[at:at + (1 << 16)]
        shorter = np.minimum(size[s], other[s])
        ahead = np.minimum(_equal_ahead(home.front[h[s]], visitors.front[v[s]]), shorter)
        s, ahead, shorter = s[m := ahead < longer[s]], ahead[m], shorter[m]     # equal words are not near
        behind = np.minimum(_equal_ahead(home.back[h[s]], visitors.back[v[s]]), shorter)
        ok[s] = ahead + behind >= longer[s] - 1
    for i in np.flatnonzero((longer > WIDTH) & (abs(size - other) <= 1)):
        ok[i] = one_edit(home.letters[h[i]], visitors.letters[v[i]])
    return ok


class Trie:
    """Words arranged by their counts, group after group: a node is a range of words and a level."""

    def __init__(self, words: Words):
        self.order = np.lexsort(words.counts.T[::-1])
        self.words = words.taken(self.order)

    def search(self, visitors: Words):
        """Arrays (word, visitor) of positions, verified; words as they stand in ``self.words``."""
        counts, asks, levels = self.words.counts, visitors.counts, self.words.counts.shape[1]
        met, near = ([], []), ([], [])                     # pairs that met in a leaf; those verified

        def verify():
            if met[0]:
                h, v = (np.concatenate(x) for x in met)
                ok = verified(self.words, h, visitors, v)
                near[0].append(h[ok])
                near[1].append(v[ok])
            for x in met:
                x.clear()

        def compare(level: int, lo: int, hi: int, who, surplus, deficit):
            d = asks[who, None, level:] - counts[None, lo:hi, level:]
            ok = ((np.maximum(d, 0).sum(axis=2) + surplus[:, None] <= 1)
                  & (np.maximum(-d, 0).sum(axis=2) + deficit[:, None] <= 1))
            v, h = np.nonzero(ok)
            met[0].append(h + lo)
            met[1].append(who[v])
            # DIRECT pairs at most in each: memory does not follow the number of pairs
            if len(met[0]) >= MET_LEAVES:
                verify()

        def walk(level: int, lo: int, hi: int, who, surplus, deficit):
            if level == levels or (hi - lo) * len(who) <= DIRECT:
                # a leaf (or few words): all of them, block by block
                for at in range(0, len(who), step := max(1, DIRECT // (hi - lo))):
                    part = slice(at, at + step)
                    compare(level, lo, hi, who[part], surplus[part], deficit[part])
                return
            here = counts[lo:hi, level]
            ends = [0, *(np.flatnonzero(np.diff(here)) + 1).tolist(), hi - lo]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                d = asks[who, level] - here[a]
                up, down = surplus + np.maximum(d, 0), deficit + np.maximum(-d, 0)
                alive = np.flatnonzero((up <= 1) & (down <= 1))
                if len(alive):
                    walk(level + 1, lo + a, lo + b, who[alive], up[alive], down[alive])

        if len(counts) and len(asks):
            nothing = np.zeros(len(asks), np.int32)
            walk(0, 0, len(counts), np.arange(len(asks)), nothing, nothing)
        verify()
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in near)


class _Near:
    """Per word of an array: number of near words, and the most frequent of them."""

    def __init__(self, size: int):
        self.near = np.zeros(size, np.int64)
        self.best: dict[int, tuple[int, bytes]] = {}

    def add(self, mine: np.ndarray, n: np.ndarray, letters: list[bytes]) -> None:
        """One near word (its count and letters) for every position in ``mine``."""
        np.add.at(self.near, mine, 1)
        for i, k, w in zip(mine.tolist(), n.tolist(), letters, strict=True):
            old = self.best.get(i)
            if old is None or (-k, w) < (-old[0], old[1]):
                self.best[i] = (k, w)

    def rows(self, letters: list[bytes]):
        return [(letters[i].decode("latin-1"), int(self.near[i]), {"n": k, "word": w.decode("latin-1")}) for i, (k, w) in self.best.items()]


def _search_shards(batches, group_of: bytes, groups: int):
    """Rows of one shard after the other, its words before its visitors: sums per word."""
    import pyarrow as pa
    table = np.frombuffer(group_of, np.uint8).astype(np.int64)
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.struct([("n", pa.int64()), ("word", pa.string())]))])

    def batch(rows):
        return pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(schema.names)}, schema=schema)

    class Shard:
        def __init__(self):
            self.home, self.counts, self.trie = [], [], None

        def ready(self):
            """The words are complete: their trie, and the pairs among them."""
            if self.trie is None:
                words = Words(self.home, table, groups)
                self.trie = Trie(words)
                self.n = np.array(self.counts, np.int64)[self.trie.order]
                self.sums = _Near(len(self.home))
                own = self.trie.words
                for at in range(0, len(self.home), BLOCK_WORDS):
                    block = own.taken(np.arange(at, min(at + BLOCK_WORDS, len(self.home))))
                    h, v = self.trie.search(block)
                    self.sums.add(h, self.n[v + at], [own.letters[i + at] for i in v])
            return self

        def visit(self, letters, counts):
            self.ready()
            visitors, n, own = Words(letters, table, groups), np.array(counts, np.int64), self.trie.words
            h, v = self.trie.search(visitors)
            self.sums.add(h, n[v], [letters[i] for i in v])
            theirs = _Near(len(letters))
            theirs.add(v, self.n[h], [own.letters[i] for i in h])
            return batch(theirs.rows(letters))

        def rest(self):
            return batch(self.ready().sums.rows(self.trie.words.letters))

    key, shard, visitors, n = None, None, [], []
    for part in slices(batches, 8192):
        for home, own, letters, count in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            if own != key:
                if shard:
                    if visitors:
                        yield shard.visit(visitors, n)
                    yield shard.rest()
                key, shard, visitors, n = own, Shard(), [], []
            if home:
                shard.home.append(letters)
                shard.counts.append(count)
                continue
            visitors.append(letters)
            n.append(count)
            if len(visitors) >= BLOCK_WORDS:
                yield shard.visit(visitors, n)
                visitors, n = [], []
    if shard:
        if visitors:
            yield shard.visit(visitors, n)
        yield shard.rest()


def _steps(levels: int) -> list[list[int]]:
    """Differences of two prefixes within the budget, each pair of prefixes in one direction (first change upwards)."""
    def unit(i, j=None):
        return [(k == i) - (k == j) for k in range(levels)]
    return [unit(i) for i in range(levels)] + [unit(i, j) for i in range(levels) for j in range(i + 1, levels)]


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, groups: int = GROUPS) -> DataFrame:
    """(word, n_near, form struct(n, word)) of every word that has a near word in ``words`` (word, n); ``form`` is the
    near word with the largest n (ties: the smallest in code-point order). Words hold letters only, each once."""
    python_ready(words.sparkSession)
    found = letter_groups(words, groups)
    g = max(1, len(found))
    group_of = np.zeros(256, np.uint8)
    for i, letters in enumerate(found):
        for c in letters:
            group_of[ord(c)] = i
    # per group: how many letters of the word translate() would remove
    level = [(F.length("word") - F.length(F.translate("word", x, ""))).alias(f"c{i}") for i, x in enumerate(found)] or [F.lit(0).alias("c0")]
    names = [f"c{i}" for i in range(g)]
    vectors = words.select("word", "n", *level)
    # the largest subtree below each number of levels: from the counts per vector, a row per level
    nodes = vectors.groupBy(*names).agg(F.count(F.lit(1)).alias("k"))
    sizes = nodes.rollup(*names).agg(F.sum("k").alias("k"), F.grouping_id().alias("cut")).groupBy("cut").agg(F.max("k").alias("k")).collect()
    largest = {g - bin(r["cut"]).count("1"): r["k"] or 0 for r in sizes}
    levels = next((p for p in range(g + 1) if largest.get(p, 0) <= shard_words), g)
    path = F.array(*names[:levels]) if levels else F.array().cast("array<int>")
    at = vectors.select("word", "n", path.alias("path"))
    pieces = at.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_words)).cast("int").alias("pieces"))
    at = at.join(pieces, "path").withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces").cast("long")).cast("int"))
    home = at.select(F.lit(True).alias("home"), "path", "piece", "word", "n")
    # pieces of one shard visit the later pieces; other shards are visited whole
    within = (at.filter("pieces > 1").withColumn("piece", F.explode(F.filter(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: p > F.col("piece"))))
              .select(F.lit(False).alias("home"), "path", "piece", "word", "n"))
    rows = home.unionByName(within)
    if levels:
        steps = F.array(*[F.array(*[F.lit(x) for x in s]) for s in _steps(levels)])
        out = (at.select("word", "n", F.explode(F.transform(steps, lambda s: F.zip_with("path", s, lambda a, b: a + b))).alias("path"))
               .join(pieces, "path").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))))
        rows = rows.unionByName(out.select(F.lit(False).alias("home"), "path", "piece", "word", "n"))
    own = F.concat_ws(",", F.col("path").cast("array<string>"), F.col("piece").cast("string")).alias("own")
    letters = F.encode("word", "ISO-8859-1").alias("letters")
    dealt = rows.select("home", own, letters, "n").repartition("own").sortWithinPartitions("own", F.col("home").desc())
    table = group_of.tobytes()
    sums = dealt.mapInArrow(lambda batches: _search_shards(batches, table, g), _SUMS)
    best = F.min(F.struct((-F.col("form.n")).alias("n"), F.col("form.word").alias("word")))
    return (sums.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.struct((-F.col("b.n")).alias("n"), F.col("b.word").alias("word")).alias("form")))


def variants(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Of every word: n, n_near, form and form_n (the near word of largest n, if that is at least ``ratio`` times the
    word's n; else null) and root (the last of its forms; the word itself without one)."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2: forms are followed upwards")
    words = written(words, "words")
    near = near_words(words, shard_words)
    form = F.col("form.n") >= ratio * F.col("n")
    table = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(form, F.col("form.word")).alias("form"), F.when(form, F.col("form.n")).alias("form_n")), "forms")
    # pointers of the words with a form; each round doubles the steps that a pointer jumps
    steps = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = table.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1.0, math.log(most, ratio)) + 1))):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = written(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return (table.join(steps, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
