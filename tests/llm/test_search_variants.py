import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import ODD, documents
from pyspark.sql import functions as F

from routelake.llm import lexical as L
from routelake.llm import multi_index as M
from routelake.llm import queries as Q
from routelake.llm import variants as V

# ---------------------------------------------------------------- ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_search(docs, items, k=10):
    """docs: (id, text) rows; items: (id, text) rows, one per id."""
    counted = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs if t]
    counted = [(i, c) for i, c in counted if c]
    if not counted:
        return []
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in TERM.findall(lower(text or "")) if t in c)
            if score > 0 and d is not None:
                rows.append((-score, d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k])]
    return out


def items_table(spark, items):
    return spark.createDataFrame([(*r, 3, "x") for r in items], "item_id long, text string, rank int, term string").repartition(2)


@pytest.mark.parametrize("cells, block_terms, count_terms", [(2048, 50_000, 500_000), (7, 9, 40), (7, 9, 1)])
def test_search_matches_brute_force(spark, cells, block_terms, count_terms):
    rng = random.Random(3)
    vocab = [f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(400)] + ["Straße", "ÑANDÚ", "A1", "İ", "日本"]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(1, 60))) for _ in range(300)] + ODD + ["same text w1"] * 40
    ids = [*range(len(texts) - 1), None]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 20)))) for i in range(25)] + [(90, "nowhere"), (91, None), (92, ""), (93, "same same text"), (94, "q" * 50_000)]
    got = L.search(documents(spark, texts, ids=ids), items_table(spark, [*items, (93, "same same text"), (None, "w1")]), cells=cells, block_terms=block_terms, count_terms=count_terms)
    assert sorted(map(tuple, got.collect())) == sorted(brute_search(list(zip(ids, texts)), items))


def test_search_empty_and_shared_ids(spark):
    none, one = documents(spark, []), documents(spark, ["alpha beta", "beta gamma", None, "..."])
    assert L.search(none, items_table(spark, [(1, "alpha")])).collect() == []
    assert L.search(one, items_table(spark, [])).collect() == []
    both = L.search(one, items_table(spark, [(1, "alpha"), (1, "gamma")])).collect()
    assert sorted(map(tuple, both)) == sorted(brute_search([(0, "alpha beta"), (1, "beta gamma")], [(1, "alpha gamma")]))


def test_bounds_hold_and_spare_documents():
    rng = random.Random(8)
    counts = [Counter(f"t{int(rng.paretovariate(0.7)) % 5000}".encode() for _ in range(200)) for _ in range(600)]
    n_terms = sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    rows = [(q, t, n, L.weight(600, df[t])) for q in range(10) for t, n in Counter(rng.choice(list(counts[q])) for _ in range(12)).items()]
    block = L.QueryBlock(rows, 512)
    sketches = L.Sketches(counts, 512)
    bounds = sketches.impacts(600, n_terms) @ block.folded
    m = L.length_factor(sketches.n, 600, n_terms)
    for q, terms in enumerate(block.terms):
        scores = [sum(w * L.impact(c[t], int(m[d])) for t, w in terms if t in c) for d, c in enumerate(counts)]
        assert (bounds[:, q] >= scores).all()
    search = L.Search(block, 600, n_terms)
    search.add(np.arange(600), sketches)
    assert search.rescored < 600 * 10 / 4


def test_long_text_is_split_whole():
    text = (b"ab,cd " * 5 + b"x" * 3000 + b" ") * 900
    whole = Counter(re.findall(rb"[a-z]+", text))
    assert len(text) > 2 * L.PIECE and L.term_counts(text) == whole


def test_op11_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(Q.OP11_SQL).fetchall()
    assert want and sorted(map(tuple, Q.op11_ranked_search(spark, sf_dir).collect())) == sorted(want)


# ---------------------------------------------------------------- spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(docs, drop_every=31, min_length=7, least=2):
    n = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= min_length and k >= least}


def brute_variants(n, ratio=10):
    """Near words by looking up every possible edit."""
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        some = {w[:i] + w[i + 1:] for i in range(len(w))}
        some |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        near[w] = sorted((-n[x], x) for x in some if x in n and x != w)
    form = {w: x[0][1] for w, x in near.items() if x and -x[0][0] >= ratio * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def by_word(rows):
    return sorted(map(tuple, rows), key=lambda r: r[0])


def test_op12_matches_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_variants(brute_words(docs))
    got = Q.op12_spelling_variants(spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert by_word(got.collect()) == by_word(want)
    assert any(r[1] for r in want) and any(r[4] for r in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert by_word(con.execute(Q.OP12_SQL).fetchall()) == by_word(want)


@pytest.mark.parametrize("shard_words", [20_000, 40, 3])
def test_variants_match_brute_force(spark, shard_words):
    rng = random.Random(shard_words)
    words = {"".join(rng.choices("abcé", k=rng.randrange(1, 9))): rng.choice([2, 3, 25, 30, 400, 6000]) for _ in range(900)}
    words |= {"ñ" * 40: 9, "ñ" * 41: 300, "ñ" * 40 + "x": 90, "y" * 32: 5, "y" * 33: 50, "y" * 31 + "z": 500}
    df = spark.createDataFrame([(*r,) for r in words.items()], "word string, n long").repartition(3)
    assert by_word(V.variants(df, shard_words=shard_words).collect()) == by_word(brute_variants(words))


def test_chain_of_forms_and_ties(spark):
    words = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20_000, "aaabbbbb": 200_000, "mmmmmmma": 30, "mmmmmmmb": 30, "mmmmmmm": 3}
    got = {r["word"]: r for r in V.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert {got[w]["root"] for w in words if w[0] == "a"} == {"aaabbbbb"}
    assert (got["mmmmmmm"]["form"], got["mmmmmmm"]["root"], got["mmmmmmm"]["n_near"], got["mmmmmmma"]["form"]) == ("mmmmmmma", "mmmmmmma", 2, None)


def test_count_words_of_odd_texts(spark):
    texts = [*ODD, "Größere GRößERE straßenbahn straßenbahn ÀÉÿabcd÷× ÀÉÿabcd÷×", "naïve日本naïveté naïveté", "b" * 70_000, "b" * 70_000]
    ids = [None, *range(1, len(texts))]
    df = documents(spark, texts, ids=ids)
    for drop in (None, 3):
        got = {r["word"]: r["n"] for r in V.count_words(df, drop_every=drop).collect()}
        assert got == brute_words(list(zip(ids, texts)), drop)
    assert V.variants(V.count_words(documents(spark, []))).collect() == []
    assert len(V.variants(V.count_words(df)).collect()) == len(brute_words(list(zip(ids, texts)), None))


# ---------------------------------------------------------------- multi-index hashing

def recall(got, vectors, ids, k):
    """Share of the true neighbours found, and whether every score and rank is right."""
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    where = {i: p for p, i in enumerate(ids.tolist())}
    for q in ids[ids % 20 == 0].tolist():
        rows = sorted(by.get(q, []))
        want = M.exact(vectors, ids, where[q], k)
        assert [r[0] for r in rows] == list(range(1, len(want) + 1))
        assert all(s == M.inner(vectors[[where[v]]], vectors[where[q]])[0] for _, v, s in rows)
        assert [(s, -v) for _, v, s in rows] == sorted(((s, -v) for _, v, s in rows), reverse=True)
        assert q not in {v for _, v, _ in rows}
        # ties of the last score count as found
        least = want[-1][1] if want else 0
        hit += sum(1 for _, _, s in rows if s >= least)
        total += len(want)
    return hit / max(1, total)


def test_op13_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    assert recall(Q.op13_nearest(spark, sf_dir).collect(), vectors, ids, 20) >= 0.9


@pytest.mark.parametrize("shard_values", [1 << 21, 600])
def test_nearest_on_clusters_copies_and_lengths(spark, shard_values):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 12))
    vectors = np.concatenate([centres[rng.integers(0, 20, 900)] + 0.2 * rng.normal(size=(900, 12)), np.repeat(centres[:1], 500, axis=0),
                              centres[1] + 1e-6 * rng.normal(size=(300, 12))]) * rng.uniform(0.5, 2, 1700)[:, None]
    vectors[900:1400] = centres[0]
    ids = rng.permutation(1700)
    rows = [(int(i), v.tolist(), 1, 2) for i, v in zip(ids, vectors)]
    df = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<double>, rank int, code int").repartition(4)
    got = M.nearest(df, F.col("vec_id") % 20 == 0, shard_values=shard_values).collect()
    assert recall(got, vectors, ids, 20) >= 0.9


def test_nearest_of_few_and_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [3.0, -4.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]),
            (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [9.0, 9.0]), (60, [1e150, 1.0]), (9, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    kept = {0: [1.0, 0.0], 20: [1.0, 0.0], 40: [3.0, -4.0], 1: [0.5, 0.5], 60: [1e150, 1.0], 9: [1e-200, 0.0]}
    got = {}
    for r in sorted(M.nearest(df, F.col("vec_id") % 20 == 0).collect()):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = {q: sorted(((i, float(np.dot(kept[q], v))) for i, v in kept.items() if i != q), key=lambda x: (-x[1], x[0])) for q in kept if q % 20 == 0}
    assert got == want
    assert M.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert M.nearest(df.filter("vec_id = 1"), F.col("vec_id") % 20 == 0).collect() == []


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 24, 3000).astype(np.uint64)
    parts = M.substrings(24, 3000)
    shards = [M.Shard(j, parts, np.arange(3000), codes, np.ones((3000, 1))) for j in range(len(parts))]
    for radius in (0, 1, 2, 3, 5, 9, 24):
        for code in codes[:20]:
            found = [i for s in shards for i, _ in s.search(np.ones(1), code, radius, 3000)]
            assert len(found) == len(set(found))
            assert sorted(found) == np.flatnonzero(np.bitwise_count(codes ^ code) <= radius).tolist()
