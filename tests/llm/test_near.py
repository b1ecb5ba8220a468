import itertools
import random
import re

import pytest
from helpers import ODD, documents

from routelake.llm import near_dedup as N


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(ids, texts, percent=85):
    sets = {i: shingles(t) for i, t in zip(ids, texts)}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(rng):
    def prose(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = list(ODD)
    common = prose(40)
    for _ in range(25):
        base = prose(rng.choice([5, 8, 60, 200]))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append((" " if rng.random() < 0.5 else "\n ").join(copy).upper())
    texts += [" ".join(prose(30) + common + prose(30)) for _ in range(60)]
    base = prose(150)
    for i in range(80):       # a dense family around the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += ["one two three", "one  two THREE", "one two"] + [" ".join(base)] * 30
    return texts


@pytest.mark.parametrize("node,depth", [(N.NODE_SHINGLES, N.MAX_DEPTH), (12_000, 1), (20_000, 3)])
def test_near_duplicates_match_brute_force(spark, node, depth):
    texts = corpus(random.Random(8))
    got = N.near_duplicates(documents(spark, texts), node_shingles=node, max_depth=depth).collect()
    assert {tuple(r) for r in got} == brute(range(len(texts)), texts)


def test_near_duplicates_odd_ids(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "q r s", "q r s", None], ids=[4, 4, None, None, None, None])
    got = sorted(map(str, N.near_duplicates(docs).collect()))
    assert got == sorted(["Row(doc_id=4, n_shingles=2, component_id=4, kept=True)"] * 2 + ["Row(doc_id=None, n_shingles=2, component_id=4, kept=False)"]
                         + ["Row(doc_id=None, n_shingles=1, component_id=None, kept=True)"] * 2 + ["Row(doc_id=None, n_shingles=0, component_id=None, kept=True)"])
    assert N.near_duplicates(documents(spark, [])).collect() == []


def test_agreements_bound_the_loss():
    import math
    for percent, tokens in ((85, 24), (80, 26), (85, 8)):
        k = N.agreements(N.RECALL, percent, tokens)
        p = percent / 100
        lost = sum(math.comb(tokens, j) * p ** j * (1 - p) ** (tokens - j) for j in range(k))
        assert lost <= 1 - N.RECALL


def test_link_node_is_a_spanning_forest():
    import numpy as np
    rng = np.random.RandomState(1)
    base = rng.randint(0, 10**9, 100)
    sets = [np.unique(np.concatenate([base[rng.rand(100) > 0.03], rng.randint(0, 10**9, 2)])).astype(np.uint64) for _ in range(40)]
    links = N.link_node(np.arange(40), sets, 85)
    graph = {(a, b) for a, b in itertools.combinations(range(40), 2)
             if 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))}
    assert {tuple(sorted(x)) for x in links} <= graph

    def parts(edges):
        root = list(range(40))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root
    assert parts(links) == parts(graph) and len(links) == 40 - len(set(parts(graph)))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.member: r.root for r in N.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 150: 100, 200: 100}


def test_rows_without_id_are_compared(spark):
    rng = random.Random(3)
    one, two, three = (" ".join(f"w{rng.randrange(4000)}" for _ in range(100)) for _ in range(3))
    texts = [one, one + " more", two + " more", two, two, two + " more words", three, "", None]
    docs = documents(spark, texts, ids=[None, 7, None, None, None, None, None, None, None])
    got = {(r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs).collect()}
    assert {g for g in got if g[1] == 7} == {(96, 7, False), (97, 7, True)}
    assert sum(g[2] for g in got if g[1] is None and g[0] > 0) == 2          # a class of two, and three
    kept = sorted(r.text or "" for r in N.keep_representatives(docs).collect())
    assert len(kept) == 5 and kept[:2] == ["", ""]
    assert sorted(k.split()[0] for k in kept[2:]) == sorted(t.split()[0] for t in (one, two, three))
    assert one + " more" in kept and three in kept


def test_deep_branches_keep_the_recall():
    for percent in (85, 80):
        first = N.BRANCH * N.trees_for(N.RECALL, percent)
        assert abs(N.missed(percent, first, 0) - (1 - percent / 100) ** first) < 1e-12
        assert N.missed(percent, first, N.MAX_DEPTH) < 1 - N.RECALL


def test_large_nodes_meet_pivots_first_and_only_the_rest_by_blocks(spark):
    """Rows grow with the members, not with their square, and every pair that could add a link meets."""
    size, load = 20, 20 + N.MEMBER_LOAD

    def large(n):
        return spark.createDataFrame([(1, i, size, n * load) for i in range(n)], "node long, rep long, n_shingles long, weight long")

    def meetings(df):
        nodes = {}
        for r in df.collect():
            nodes.setdefault(r.node, []).append(r.rep)
        return nodes
    limit = 40 * load                                                # blocks of about 20 members
    counts = []
    for n in (200, 800):
        first = meetings(N._blocks(large(n), limit))
        assert set(itertools.chain(*first.values())) == set(range(n))
        assert len(set.intersection(*map(set, first.values()))) == N.PIVOTS
        one = spark.createDataFrame([(i, 0) for i in range(1, n)], "member long, root long")
        assert N._between(large(n), one, limit).count() == 0         # one family: nothing is left
        roots = spark.createDataFrame([(i, 0) for i in range(1, n - 10)], "member long, root long")
        rest = meetings(N._between(large(n), roots, limit))
        met = {frozenset(p) for members in rest.values() for p in itertools.combinations(members, 2)}
        assert all(frozenset((a, b)) in met for a in range(n - 10, n) for b in range(n) if a != b)
        assert all(len(m) == len(set(m)) <= 60 for m in rest.values())
        counts.append(sum(map(len, first.values())) + sum(map(len, rest.values())))
    assert counts[1] < 5 * counts[0]


def test_two_texts_under_one_id(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    got = N.near_duplicates(documents(spark, [a, b, b, a], ids=[5, 5, 7, 9])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]
