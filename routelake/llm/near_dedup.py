"""Near-duplicate detection by a chosen-path set similarity join.

Documents are sets of word shingles. Each carries minwise tokens: for every coordinate, its
shingle with the smallest hash. A tree starts with all documents and branches a node by a few
chosen coordinates: documents that share the chosen token go to the same child, so a pair of
similarity s stays together with probability s per coordinate. Nodes whose sets are small in
sum are compared exhaustively on the full sets; larger ones branch again, by ``DEEP_BRANCH`` of a
pool of ``POOL`` coordinates. Independent trees repeat the join until a pair at the threshold is
missed with probability below ``1 - RECALL``: it is lost only if in every tree all first branches
separate it (``0.15 ** 8`` at 85 percent), or deeper ones do. ``missed`` sums this up over all numbers
of pool coordinates that a pair can agree in; through all ``MAX_DEPTH`` levels it is 3.8e-7 at 85 and
6.7e-7 at 80 percent.

Steps, all narrow but for the texts of documents that share a node with another:

1. fingerprints: set size, 128-bit set fingerprint and minwise tokens, written once;
2. documents with equal sets become one class (an aggregate, combined on the map side), so
   groups of copies, however large, enter the join as one row;
3. branching on (node, document) rows; nodes with the same members are compared once. A node
   that still is too large after ``MAX_DEPTH`` levels (thousands of near-copies of one text) is
   cut into blocks. Each block is first compared with itself and ``PIVOTS`` members of the node, which
   connects most of a family at a cost in proportion to its members. Only members outside of the
   node's largest component then meet all blocks, so no task holds more than two blocks and no pair
   that could still add a link is left out;
4. members of a node that agree with no other member in enough minwise tokens leave it: a pair at
   the threshold has fewer agreements with probability below ``1 - RECALL`` (``agreements``). Most
   nodes that only share a passage end here, before any set is built;
5. the exhaustive comparison in a node counts intersections on full sets. Within a node a link
   between documents that are already connected adds nothing to the components, so it yields a
   spanning forest of verified links, never all pairs;
6. connected components by alternating large-star and small-star steps, written after each.

Word rule: A-Z lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]+``; a document with fewer
than ``WORDS`` words has its whole sequence as one shingle. Shingles are 64-bit hashes.

Defined cases: null and empty texts have an empty set, are linked with nothing and kept;
repeated rows fall into one class; rows that share an id and differ in text are rows of their own in the search, and the
id joins their classes: all rows of one id that is its component's smallest are kept; rows with a null id are compared like others, but not linked by
that id: they follow the class of their text, and are kept only where no row of its component has
an id, and there only the rows of one class (by ``keep_representatives`` one row of it), with a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import python_ready, slices, written

WORDS = 5
PERCENT = 85
RECALL = 1 - 1e-6
#: Coordinates by which a node branches.
BRANCH = 2
DEEP_BRANCH = 4
#: Coordinates from which nodes below the first level choose.
POOL = 24
MAX_DEPTH = 6
#: Members of a node that all its blocks are compared with first.
PIVOTS = 8
#: Load (shingles of all sets, and MEMBER_LOAD for each set) that one task compares at once.
NODE_SHINGLES = 1 << 21
MEMBER_LOAD = 256
#: Cells of the filter that is sent to the texts before they are shuffled: its proven size bound. With as
#: many members of nodes it lets most texts pass, which costs their shuffle, never a result.
CELLS = 1 << 20
MEMO_WORDS = 400_000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words seen by this worker."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: bytes | None, memo: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text in UTF-8."""
    found = text.lower().split() if text else []      # bytes: exactly A-Z and these white-space bytes
    if not found:
        return np.empty(0, _U)
    h = np.fromiter(map(memo.__getitem__, found), _U, len(found))
    width = min(words, len(h))
    acc = np.full(len(h) - width + 1, width, _U)
    for k in range(width):
        acc = acc * _STEP + h[k:len(h) - width + 1 + k]
    return np.unique(mix(acc))


def seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _STEP)


def minwise(s: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The minwise token of a non-empty set for every coordinate."""
    best = None
    for at in range(0, len(s), 4096):
        x = (s[None, at:at + 4096] ^ seed[:, None]) * _M1
        x = ((x ^ (x >> _U(32))) * _M2).min(axis=1)
        best = x if best is None else np.minimum(best, x)
    return best


def trees_for(recall: float, percent: int, branch: int = BRANCH) -> int:
    return max(1, math.ceil(math.log(1 - recall) / (branch * math.log(1 - percent / 100)) - 1e-9))


def missed(percent: int, first: int, depth: int, pool: int = POOL, deep: int = DEEP_BRANCH) -> float:
    """Probability that a pair at the threshold meets in no node: ``first`` branches of the first level, each followed by
    ``depth`` levels in which a node takes ``deep`` coordinates of the pool by its hash."""
    s, out = percent / 100, 0.0
    for agree in range(pool + 1):
        share = math.comb(pool, agree) * s ** agree * (1 - s) ** (pool - agree)
        apart = math.comb(pool - agree, deep) / math.comb(pool, deep)
        out += share * (1 - s * (1 - apart) ** depth) ** first
    return out


def link_node(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (100 * intersection >= percent * union) among the documents of a node."""
    m = len(ids)
    size = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        if 100 * size.min() < percent * size.max():
            return []
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if 100 * both >= percent * (size.sum() - both) else []
    live = np.arange(m)
    while True:      # a document needs this many shingles that some other document of the node has
        owner = np.repeat(live, size[live])
        _, which, often = np.unique(np.concatenate([sets[i] for i in live]), return_inverse=True, return_counts=True)
        shared = np.bincount(owner[often[which] > 1], minlength=m)
        stay = live[100 * shared[live] >= percent * size[live]]
        if len(stay) == len(live):
            break
        live = stay
        if len(live) < 2:
            return []
    order = np.argsort(which, kind="stable")
    postings, first = owner[order], np.concatenate([[0], np.cumsum(often)])
    begin = np.concatenate([[0], np.cumsum(size[live])])
    label, out = np.arange(m), []
    for at, x in enumerate(live):
        later = live[at + 1:]
        if not len(later) or (label[later] == label[x]).all():
            continue
        own = which[begin[at]:begin[at + 1]]
        own = own[often[own] > 1]
        n = often[own]
        spread = np.repeat(first[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(postings[spread], minlength=m)[later]
        linked = later[100 * both >= percent * (size[x] + size[later] - both)]
        fresh = linked[label[linked] != label[x]]
        for y in fresh:
            if label[y] != label[x]:
                out.append((int(ids[x]), int(ids[y])))
                label[label == label[y]] = label[x]
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, recall: float = RECALL,
                    node_shingles: int = NODE_SHINGLES, max_depth: int = MAX_DEPTH,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return (_linked(docs, percent, words, recall, node_shingles, max_depth, id_col, text_col)
            .select("doc_id", "n_shingles", "component_id", "kept"))


#: A document's set: its size and its 128-bit fingerprint.
SAME = ["n_shingles", "set_a", "set_b"]


def _linked(docs: DataFrame, percent: int, words: int = WORDS, recall: float = RECALL, node_shingles: int = NODE_SHINGLES,
            max_depth: int = MAX_DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` with the columns SAME."""
    spark = docs.sparkSession
    python_ready(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    first = BRANCH * trees_for(recall, percent)
    prints = written(_fingerprints(rows, words, first + POOL), "fingerprints")
    classes = (prints.filter("n_shingles > 0").groupBy(*SAME)
               .agg(F.min("doc_id").alias("label"), F.first("tokens").alias("tokens")))
    nameless = not prints.filter("n_shingles > 0 and doc_id is null").isEmpty()
    number = _number(classes) if nameless else F.col("label")
    classes = classes.withColumn("rep", number)
    reps = written(classes.select("rep", "n_shingles", "tokens"), "classes")
    if nameless:
        rows = rows.filter("doc_id is not null").unionByName(_texts(rows, classes, words))

    start = reps.select("rep", "n_shingles", F.posexplode(F.slice("tokens", 1, first)).alias("at", "token"))
    level = start.select(F.xxhash64("at", "token").alias("node"), "rep", "n_shingles")
    small, early = [], []
    least = agreements(recall, percent, first + POOL)
    for depth in range(max_depth + 1):
        members = written(_distinct_nodes(level), "nodes")
        small.append(members.filter(F.col("weight") <= node_shingles).select("node", "rep"))
        large = members.filter(F.col("weight") > node_shingles)
        if large.isEmpty():
            break
        if depth == max_depth:
            close = _similar(_blocks(large, node_shingles), reps, least)
            early.append(written(_compare(_again(close), rows, words, percent), "links"))
            small.append(_between(large, components(early[0]), node_shingles))
            break
        level = _branch(large, reps, first)
    nodes = small[0]
    for more in small[1:]:
        nodes = nodes.unionByName(more)
    links = written(_compare(_again(_similar(nodes, reps, least)), rows, words, percent), "links")
    for more in early:
        links = links.unionByName(more)
    roots = components(links)

    final = (classes.select(*SAME, "rep", "label").join(roots, F.col("rep") == F.col("member"), "left")
             .withColumn("root", F.coalesce("root", "rep")))
    if nameless:      # numbers are no ids: a component is named by its smallest id, if it has one
        final = final.join(final.groupBy("root").agg(F.min("label").alias("component")), "root")
        final = final.select(*SAME, "component", (F.col("component").isNotNull() | (F.col("rep") == F.col("root"))).alias("leads"))
    else:
        final = final.select(*SAME, F.col("root").alias("component"), F.lit(True).alias("leads"))
    out = prints.select("doc_id", *SAME).join(final, SAME, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", *SAME, component.alias("component_id"),
                      (F.col("doc_id").eqNullSafe(component) & F.coalesce("leads", F.lit(True))).alias("kept"))


def _number(classes: DataFrame) -> Column:
    """A class's number: its smallest id; without one, a hash that is no other class's number."""
    salt = 0
    while True:
        free = F.xxhash64(F.lit(salt), *SAME)
        used = classes.select("label").filter("label is not null").distinct()
        used = used.unionByName(classes.filter("label is null").select(free.alias("label")))
        if used.groupBy("label").count().filter("count > 1").isEmpty():
            return F.coalesce(F.col("label"), free)
        salt += 1


def _texts(rows: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(doc_id, text): the number and one text of every class without an id."""
    first = _with_set(rows.filter("doc_id is null").select("text"), 0, words).groupBy(*SAME).agg(F.first("text").alias("text"))
    numbers = classes.filter("label is null").select(*SAME, F.col("rep").alias("doc_id"))
    return written(first.join(numbers, SAME).select("doc_id", "text"), "texts")


def _with_set(rows: DataFrame, at: int, words: int = WORDS) -> DataFrame:
    """The rows and SAME of the text in column ``at``."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in SAME)])

    def run(batches):
        import pyarrow as pa
        memo = WordHashes()
        for part in slices(batches):
            found = [set_print(shingle_set(t, memo, words)) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], names=schema.names)
    return rows.mapInArrow(run, schema)


def set_print(s: np.ndarray) -> tuple[int, int, int]:
    """Size and fingerprint of a set."""
    if not len(s):
        return 0, 0, 0
    a, b = np.array([np.bitwise_xor.reduce(s), mix(s + _STEP).sum(dtype=_U)], _U).view(np.int64).tolist()
    return len(s), a, b


def _fingerprints(rows: DataFrame, words: int, coordinates: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        memo, seed = WordHashes(), seeds(coordinates)
        for part in slices(batches):
            sizes, a, b, tokens = [], [], [], []
            for text in part.column(1).to_pylist():
                s = shingle_set(text, memo, words)
                for column, value in zip((sizes, a, b), set_print(s), strict=True):
                    column.append(value)
                tokens.append(minwise(s, seed).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()),
                 pa.array(b, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "tokens"])
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, tokens array<long>")


def _distinct_nodes(level: DataFrame) -> DataFrame:
    """(node, rep, n_shingles, weight) of nodes with two members at least; of nodes with equal members, one."""
    nodes = (level.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("n_shingles") + MEMBER_LOAD).alias("weight"),
        F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(2))).alias("y"))
        .filter("n > 1").groupBy("n", "weight", "x", "y").agg(F.min("node").alias("node")).select("node", "weight"))
    return level.join(nodes, "node").select("node", "rep", "n_shingles", "weight")


def _again(nodes: DataFrame) -> DataFrame:
    """Nodes from which members have left: of those with equal members, one."""
    return written(_distinct_nodes(nodes.withColumn("n_shingles", F.lit(0))).select("node", "rep"), "similar")


def _branch(large: DataFrame, reps: DataFrame, first: int) -> DataFrame:
    """Children of large nodes: by DEEP_BRANCH coordinates that the node's hash chooses from the pool."""
    drawn = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(POOL - 1)), lambda j: F.struct(F.xxhash64("node", j).alias("by"), (j + first).alias("at"))))
    rows = large.select("node", "rep", F.explode(F.transform(F.slice(drawn, 1, DEEP_BRANCH), lambda d: d.getField("at"))).alias("at"))
    return (rows.join(reps, "rep")
            .select(F.xxhash64("node", "at", F.element_at("tokens", F.col("at") + 1)).alias("node"), "rep", "n_shingles"))


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("rep"), n)


def _blocks(large: DataFrame, node_shingles: int) -> DataFrame:
    """(node, rep) of blocks of about half the limit, each with the node's pivots: the members with the smallest hashes."""
    n = F.ceil(F.col("weight") * 2 / F.lit(node_shingles)).cast("long")
    rows = large.select("node", "rep", n.alias("n"))
    own = rows.select(F.xxhash64("node", _block(F.col("n"))).alias("node"), "rep")
    place = Window.partitionBy("node").orderBy(F.xxhash64("node", "rep"), "rep")
    pivots = rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= PIVOTS)
    everywhere = pivots.select("node", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    return own.unionByName(everywhere.select(F.xxhash64("node", "block").alias("node"), "rep")).distinct()


def _between(large: DataFrame, roots: DataFrame, node_shingles: int) -> DataFrame:
    """(node, rep) of pairs of blocks in which every member outside of its node's largest component meets every other
    member. Members of one component need no further links."""
    named = large.join(roots, F.col("rep") == F.col("member"), "left").withColumn("root", F.coalesce("root", "rep"))
    load = F.col("n_shingles") + F.lit(MEMBER_LOAD)
    parts = named.groupBy("node", "root").agg(F.sum(load).alias("load"), F.max("weight").alias("weight"))
    most = parts.groupBy("node").agg(F.max(F.struct("load", "root")).alias("most"), F.max("weight").alias("weight"))
    blocks = most.filter("weight > most.load").select(
        "node", F.col("most.root").alias("main"), F.ceil(F.col("weight") * 2 / F.lit(node_shingles)).cast("long").alias("n"),
        F.ceil((F.col("weight") - F.col("most.load")) * 2 / F.lit(node_shingles)).cast("long").alias("n_out"))
    rows = named.select("node", "rep", "root").join(blocks, "node")

    def numbers(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    whole = rows.select("node", "rep", _block(F.col("n")).alias("a"), numbers(F.col("n_out")).alias("b"))
    outside = rows.filter(F.col("root") != F.col("main")).select("node", "rep", numbers(F.col("n")).alias("a"), _block(F.col("n_out")).alias("b"))
    return whole.unionByName(outside).select(F.xxhash64("node", "a", "b").alias("node"), "rep").distinct()


def agreements(recall: float, percent: int, tokens: int) -> int:
    """The most agreements, of ``tokens`` independent ones, that a pair at the threshold misses with probability below 1 - recall."""
    p, below, k = percent / 100, 0.0, 0
    while k < tokens:
        below += math.comb(tokens, k) * p ** k * (1 - p) ** (tokens - k)
        if below > 1 - recall:
            break
        k += 1
    return k


def with_partner(tokens: np.ndarray, least: int) -> np.ndarray:
    """Which rows of ``tokens`` agree with another row in ``least`` columns or more."""
    out = np.zeros(len(tokens), bool)
    for x in range(len(tokens) - 1):
        near = (tokens[x + 1:] == tokens[x]).sum(axis=1) >= least
        if near.any():
            out[x] = True
            out[x + 1:] |= near
    return out


def _similar(nodes: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """(node, rep) of the members that agree with another member of their node in ``least`` tokens."""
    def run(batches):
        import pyarrow as pa
        node, ids, rows = None, [], []

        def kept():
            if len(ids) < 2:
                return []
            return [(node, i) for i, k in zip(ids, with_partner(np.stack(rows), least), strict=True) if k]

        def batch(found):
            columns = list(zip(*found, strict=True)) if found else [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "rep"])

        for part in slices(batches, 4096):
            tokens = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            out = []
            for key, rep, row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), tokens, strict=True):
                if key != node:
                    out += kept()
                    node, ids, rows = key, [], []
                ids.append(rep)
                rows.append(row)
            yield batch(out)
        yield batch(kept())

    return (nodes.join(reps.select("rep", "tokens"), "rep").select("node", "rep", "tokens")
            .repartition("node").sortWithinPartitions("node", "rep").mapInArrow(run, "node long, rep long"))


def _compare(nodes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) of every node, on the full sets of its members."""
    def sets(batches):
        import pyarrow as pa
        memo = WordHashes()
        for part in slices(batches):
            found = [shingle_set(t, memo, words).tobytes() for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["rep", "nodes", "shingles"])

    def run(batches):
        import pyarrow as pa

        def links(ids, found):
            return link_node(np.array(ids), [np.frombuffer(s, _U) for s in found], percent) if len(ids) > 1 else []

        node, ids, found, out = None, [], [], []
        for part in slices(batches):
            for key, rep, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if key != node:
                    out += links(ids, found)
                    node, ids, found = key, [], []
                ids.append(rep)
                found.append(s)
            if out:
                yield _pairs(pa, out)
                out = []
        yield _pairs(pa, out + links(ids, found))

    # a document's nodes (a few per tree) travel with its text, so sets are shuffled once, to their nodes
    involved = nodes.groupBy("rep").agg(F.collect_list("node").alias("nodes"))
    # at most CELLS numbers: texts whose cell holds no member of a node stay where they are
    cells = involved.select(_cell("rep").alias("cell")).distinct()
    near = rows.withColumn("cell", _cell("doc_id")).join(F.broadcast(cells), "cell", "left_semi")
    full = (near.join(involved, F.col("doc_id") == F.col("rep")).select("rep", "nodes", "text")
            .mapInArrow(sets, "rep long, nodes array<long>, shingles binary"))
    return (full.select(F.explode("nodes").alias("node"), "rep", "shingles")
            .repartition("node").sortWithinPartitions("node", "rep").mapInArrow(run, "a long, b long").distinct())


def _cell(column: str):
    return F.pmod(F.xxhash64(column), F.lit(CELLS).cast("long")).cast("int")


def _pairs(pa, out):
    a = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a[:, 0], a[:, 1])), pa.array(np.maximum(a[:, 0], a[:, 1]))], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(member, root) for every end of a link but the roots themselves; root: the smallest id of its component."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.unionByName(edges.join(low, "u").select("u", F.col("m").alias("v")).filter("u <> v")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small, "small-star")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("member"), F.col("v").alias("root"))
        before = now


def with_cluster(docs: DataFrame, out: str = "cluster", words: int = WORDS, text_col: str = "text") -> DataFrame:
    """The other columns and, in place of the text, its minwise shingle: two documents have the same one with the
    probability that is their similarity (always, if their sets are equal). Null where there are no words. A bucket of
    similar documents for consumers that only want them apart, at the cost of one pass."""
    spark = docs.sparkSession
    python_ready(spark)
    kept = [c for c in docs.columns if c != text_col]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("binary").alias(text_col))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.LongType())])

    def run(batches):
        import pyarrow as pa
        memo, seed = WordHashes(), seeds(1)
        for part in slices(batches):
            sets = [shingle_set(t, memo, words) for t in part.column(len(kept)).to_pylist()]
            found = [int(minwise(s, seed).view(np.int64)[0]) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.int64())], names=schema.names)
    return rows.mapInArrow(run, schema)


def keep_representatives(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are kept, one of each group, with all their columns."""
    found = _linked(docs, percent, id_col=id_col, text_col=text_col).filter("kept")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("stays"),
                       F.col(text_col).cast("binary").alias("text"))
    out = rows.select("row", "stays").join(found.select(F.col("doc_id").alias("stays")), "stays", "left_semi").select("row")
    nameless = rows.filter("stays is null")
    if not nameless.isEmpty():
        nameless = _with_set(nameless.select("row", "text"), 1)
        lead = found.filter("doc_id is null and n_shingles > 0").select(*SAME).distinct()
        one = nameless.filter("n_shingles > 0").groupBy(*SAME).agg(F.first("row").alias("row")).join(lead, SAME, "left_semi")
        out = out.unionByName(nameless.filter("n_shingles = 0").select("row")).unionByName(one.select("row"))
    return out.select("row.*")
