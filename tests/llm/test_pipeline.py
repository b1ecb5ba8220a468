"""The pipeline on a small fixture against plain Python for the stages after language identification."""

import random
import re

from helpers import documents
from test_near import brute

import corpus_pipeline as P
from routelake.llm import near_dedup as N


def test_stages_on_small_documents(spark):
    rng = random.Random(9)
    english = "the of and that with from this have which their".split()
    german = "der und nicht sich auch werden eine über können wäre".split()
    texts, langs = [], []
    for k in range(60):
        words = english if k % 2 else german
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) + f" ende{k}")
        langs.append("en" if k % 2 else "de")
    texts += [texts[3], texts[3].replace(" ", "\n"), texts[7] + " more", "123 456", None, ""]
    langs += [None] * 6
    docs = documents(spark, texts, langs=langs)
    one = P.STAGES[0][1](spark, docs, None)
    assert one.schema.simpleString() == docs.schema.simpleString()
    kept = sorted(r.doc_id for r in one.collect())
    assert set(range(63)) >= set(kept) and len(kept) >= 60
    two = P.STAGES[1][1](spark, one, None)
    first = {}
    for i in kept:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert sorted(r.doc_id for r in two.collect()) == sorted(first.values())
    three = P.STAGES[2][1](spark, two, None)
    left = sorted(first.values())
    want = sorted(i for i, _, _, k in brute(left, [texts[i] for i in left], P.NEAR_PERCENT) if k)
    assert sorted(r.doc_id for r in three.collect()) == want and three.columns == docs.columns
    last = P.STAGES[3][1](spark, three, None).collect()
    assert {r.doc_id for r in last} == set(want)
    assert sum(r.n for r in last) == sum(len(texts[i].split()) for i in want)


def test_similar_documents_share_no_bin(spark):
    """Documents of half a common text, too different for the near-duplicate stage, from different sources."""
    rng = random.Random(12)
    common = [f"c{k}" for k in range(300)]
    texts = [" ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(80)]) for _ in range(40)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(380)) for _ in range(40)]
    docs = documents(spark, texts, sources=[f"s{k}" for k in range(80)])
    assert P.STAGES[2][1](spark, docs, None).count() == 80
    clusters = {r.doc_id: r.similar for r in N.with_cluster(docs.select("doc_id", "text"), "similar").collect()}
    alike = [i for i in range(40) if clusters[i] == max(clusters.values(), key=list(clusters.values()).count)]
    assert len(alike) >= 15                                              # similarity about two thirds
    bins = {}
    for r in P.STAGES[-1][1](spark, docs, None).collect():
        bins.setdefault((r.shard, r.bin), []).append(r.doc_id)
    for members in bins.values():
        named = [clusters[i] for i in members]
        assert len(named) == len(set(named))
    assert any(len(m) > 1 for m in bins.values())


def test_cluster_of_odd_texts(spark):
    got = [r.cluster for r in N.with_cluster(documents(spark, [None, "", " ", "A b", "a  B", "a b c"]).orderBy("doc_id")).collect()]
    assert got[:3] == [None] * 3 and got[3] == got[4] != got[5]


def test_null_ids_and_repeated_rows_through_all_stages(spark):
    rng = random.Random(4)
    words = "the of and that with from this have which their".split()
    texts = [" ".join(rng.choice(words) for _ in range(40)) + f" end{k}" for k in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(0, texts[0]), (0, texts[0]), (None, texts[1]), (None, texts[2]), (None, "quite another text without an id " * 4), (None, "quite another text without an id " * 4), (41, None)]
    docs = documents(spark, [t for _, t in rows], langs=["en"] * len(rows), ids=[i for i, _ in rows])
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, None)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert len({t for _, t in kept}) == len(kept)
    by_text = dict((t, i) for i, t in kept)
    assert by_text[texts[1]] == 1 and by_text[texts[2]] == 2 and by_text["quite another text without an id " * 4] is None
    last = P.STAGES[-1][1](spark, docs, None).collect()
    assert sum(r.n for r in last) == sum(len(t.split()) for _, t in kept)


def test_pipeline_runs_on_an_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, None)
    assert docs.collect() == []


def test_every_query_is_registered():
    import __spark_entry__ as E
    names = E.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and {"op2_topk", "op4_warc", "op7_exact_dedup"} <= set(E.oracle_sql())
