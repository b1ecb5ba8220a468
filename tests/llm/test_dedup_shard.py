import hashlib
import re
import zlib
from collections import Counter

import pytest
from helpers import ODD, documents

from routelake.llm import exact_dedup as E
from routelake.llm import sharding as S


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(ids, texts):
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(norm(t), []).append(i)
    return {(i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in zip(ids, texts)}


@pytest.mark.parametrize("hot", [E.HOT_BYTES, 100])
def test_exact_dedup_matches_brute_force(spark, hot):
    texts = ODD + ["hot text\n here"] * 300 + ["hot  text here"] * 200 + [f"only {i}" for i in range(50)]
    got = E.exact_dedup(documents(spark, texts), hot_bytes=hot).collect()
    assert {tuple(r) for r in got} == brute(range(len(texts)), texts)
    assert len(got) == len(texts)


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["t", "t", "t", "u", "u", "v", "v"], ids=[3, 3, None, None, None, 5, None])
    for hot in (E.HOT_BYTES, 1):
        got = E.exact_dedup(docs, hot_bytes=hot).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter(
            [(3, 3, 3, True), (3, 3, 3, False), (None, 3, 3, False), (None, None, 2, True), (None, None, 2, False), (5, 5, 2, True), (None, 5, 2, False)])
    kept = E.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, "t"), (None, "u"), (5, "v")])


def test_exact_dedup_empty(spark):
    assert E.exact_dedup(documents(spark, [])).collect() == []
    assert E.keep_first(documents(spark, [])).collect() == []


def brute_shards(ids, shards, cells_of):
    nodes = S.ring_nodes(shards, S.VIRTUAL_NODES)
    room = S.bounds(len(ids), shards, 0)
    arcs = Counter(next((k for k, (c, _) in enumerate(nodes) if c >= cells_of[i]), 0) for i in ids)
    return nodes, arcs, room


def test_shards(spark):
    texts = ODD + ["same"] * 500 + [f"t{i}" * (i % 7) for i in range(400)]
    rows = S.assign_shards(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert (by[i].size, by[i].text_crc32, by[i].law, by[i].grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_shards_follow_the_ring(spark):
    """Row by row: every row goes to the first node clockwise whose shard still has room, one step at a time."""
    from pyspark.sql import functions as F
    docs = documents(spark, [f"t{i}" for i in range(300)])
    cell = {r.doc_id: (r.cell, r.point) for r in docs.select("doc_id", F.xxhash64("doc_id").alias("point"), F.pmod(F.xxhash64("doc_id"), F.lit(S.CELLS).cast("long")).alias("cell")).collect()}
    for slack in (0.0, 0.25):
        got = {r.doc_id: r.shard for r in S.assign_shards(docs, shards=7, virtual_nodes=5, slack=slack).collect()}
        nodes = S.ring_nodes(7, 5)
        room = S.bounds(300, 7, slack)
        arc = {i: next((k for k, (c, _) in enumerate(nodes) if c >= cell[i][0]), 0) for i in cell}
        waiting, want = sorted(cell, key=lambda i: (arc[i], cell[i], i)), {}
        for step in range(len(nodes)):
            left = []
            for i in waiting:
                s = nodes[(arc[i] + step) % len(nodes)][1]
                if room[s]:
                    room[s] -= 1
                    want[i] = s
                else:
                    left.append(i)
            waiting = left
        assert got == want


def test_more_shards_move_few_rows(spark):
    docs = documents(spark, [f"t{i}" for i in range(2000)])
    a = {r.doc_id: r.shard for r in S.assign_shards(docs, slack=0.25).collect()}
    b = {r.doc_id: r.shard for r in S.assign_shards(docs, shards=41, slack=0.25).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.25 * len(a)


def test_shards_odd_ids(spark):
    rows = S.assign_shards(documents(spark, ["a", "a", "b", None], ids=[1, 1, None, None])).collect()
    assert len(rows) == 4 and Counter(r.doc_id for r in rows) == Counter([1, 1, None, None])
    assert S.assign_shards(documents(spark, [])).collect() == []
