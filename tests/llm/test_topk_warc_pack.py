import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, documents
from pyspark.sql import functions as F

from routelake.llm import packing as P
from routelake.llm import topk as K
from routelake.llm import warc as W
from routelake.session import scratch_path


def brute_topk(rows, k=5):
    ok = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 5 == 0:
            found = sorted({(-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q and len(b) == len(a)})[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("shard_rows", [8192, 37])
def test_topk_matches_brute_force(spark, shard_rows):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(400)]
    rows += [(500 + i, [0.5] * 6) for i in range(60)] + [(600, None), (605, []), (610, [1.0, None]), (615, [float("nan")] * 6), (620, [float("inf")] * 6)]
    rows += [(630, [1.0, 2.0]), (631, [3.0, 1.0]), (None, [1.0] * 6), (635, [1e12] * 6), (636, [-1e12] * 6)]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, shard string").repartition(4)
    got = K.top_k(df, F.col("vec_id") % 5 == 0, shard_rows=shard_rows).collect()
    assert sorted(map(tuple, got)) == sorted(brute_topk(rows))


def test_topk_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert K.top_k(empty, F.col("vec_id") % 5 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in K.top_k(two, F.col("vec_id") % 5 == 0).collect()] == [(0, 1, 1, 256 * 512)]


def test_queries_reach_only_cells_that_their_bound_allows(spark):
    rng = np.random.RandomState(1)
    points = np.concatenate([rng.randn(100, 8) * 0.05 + c for c in rng.randn(12, 8) * 3])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(3)
    rows = K.usable(df, "vec_id", "embedding")
    centres = K._cell_centres(rows, 100, 256)
    located = K._located(rows, centres, 256).collect()
    assert 12 <= len(centres[8]) <= 24 and len({r.cell for r in located}) >= 10
    radii = {8: {}}
    for r in located:
        radii[8][r.cell] = max(radii[8].get(r.cell, 0), r.far)
    want = {}
    for q, _, _, s in brute_topk([(i, v.tolist()) for i, v in enumerate(points)]):
        want[q] = float(s)                                 # the k-th score
    asked = spark.createDataFrame([(q, points[q].tolist(), 8, 0, s) for q, s in want.items()], "vec_id long, v array<double>, dim int, home long, least double")
    reached = K._reached(asked, centres, radii, 256).groupBy("vec_id").count().collect()
    assert sum(r["count"] for r in reached) < len(want) * len(centres[8]) / 2
    got = K.top_k(df, F.col("vec_id") % 5 == 0, shard_rows=100).collect()
    assert sorted(map(tuple, got)) == sorted(brute_topk([(i, v.tolist()) for i, v in enumerate(points)]))


def test_ball_bound_prunes():
    rng = np.random.RandomState(0)
    rows = np.floor(256 * np.concatenate([rng.randn(500, 8) * 0.1 + c * 5 for c in range(8)]))
    tree = K.BallTree(np.arange(len(rows)), rows)
    assert len(tree.children) > 50
    assert all((np.sqrt(((tree.rows[lo:hi] - c) ** 2).sum(axis=1)) <= r + 1e-6).all() for (lo, hi), c, r in zip(tree.ranges, tree.centres, tree.radii))


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, digest string, payload int").repartition(3)


def test_warc_round_trip(spark):
    rng = random.Random(5)
    long = "<p>" + " ".join(f"word{rng.randrange(999)}" for _ in range(60)) + "</p>"
    rows = [(i, f"http://e.org/{i}", f"<html>{long}{i}é</html>") for i in range(200)]
    rows += [(300 + i, "http://copy\r\nX: y", long * 2) for i in range(50)] + [(400, None, None), (401, "u", ""), (402, "u", "short"), (403, "u", "short")]
    rows += [(250, "u", long * 3), (250, "u", long * 3), (None, "u", long * 4), (None, "u", long * 4), (260, "u", long * 5), (None, "u", long * 5), (404, "u", long * 20_000)]
    path = scratch_path(spark, "test-warc")
    manifest = W.write_archives(pages(spark, rows), path, archive_bytes=100_000).collect()
    assert sum(r.records for r in manifest) == len(rows) and len(manifest) > 1
    got = W.read_archives(spark, path, payloads=True).collect()
    first = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = Counter()
    for i, u, h in rows:
        data = (h or "").encode()
        refers = first[h] if h in first and first[h] != i else None
        want[i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers,
             u and u.replace("\r", "%0D").replace("\n", "%0A"), None if refers is not None else data] += 1
    assert Counter((*r[:6], None if r.payload is None else bytes(r.payload)) for r in got) == want


def test_warc_archive_form(spark):
    import struct

    import zstandard
    path = scratch_path(spark, "test-warc-form")
    rows = [(i, "u", f"<html><body>{i} " + "same words here " * 30 + "</body></html>") for i in range(400)]
    manifest = W.write_archives(pages(spark, rows), path).collect()
    raw = open(manifest[0].path.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D
    dictionary = zstandard.ZstdCompressionDict(raw[8:8 + size])
    rest, n = raw[8 + size:], 0
    while rest:      # one frame per record, each readable alone
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
        rest, n = one.unused_data, n + 1
    assert n == manifest[0].records + 1
    assert W.archive_round_trip(pages(spark, [])).collect() == []


def test_manifest_hides_what_other_attempts_left(spark):
    path = scratch_path(spark, "test-warc-stale")
    W.write_archives(pages(spark, [(i, "u", f"lost {i} " * 50) for i in range(90)]), path, archive_bytes=10_000)   # an attempt that was not committed
    manifest = W.write_archives(pages(spark, [(i, "u", f"kept {i} " * 50) for i in range(60)]), path, archive_bytes=10_000)
    got = W.read_listed(manifest, payloads=True).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == sorted((i, f"kept {i} ".encode() * 50) for i in range(60))
    assert W.read_archives(spark, path).count() == 150


def test_a_task_that_fails_once_after_closing_an_archive(tmp_path):
    """Two attempts at a task in a session that allows a retry: records come back once."""
    import subprocess
    import sys
    # every Python process of that session, workers included, starts with this
    (tmp_path / "sitecustomize.py").write_text("""
import sys
from routelake.llm import warc as W
plain = W._Archive.close

def failing(self):
    from pyspark import TaskContext
    out = plain(self)
    if TaskContext.get().attemptNumber() == 0 and out and self.number.endswith("-0001"):
        raise OSError("lost after an archive was closed")
    return out
W._Archive.close = failing
""")
    code = f"""
from pyspark.sql import SparkSession
from routelake.llm import warc as W
spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
pages = spark.createDataFrame([(i, "u", f"page {{i}} " * 60) for i in range(120)], "page_id long, url string, html string").coalesce(1)
folder = {str(tmp_path)!r} + "/archives"
run = W.write_archives(pages, folder, archive_bytes=9_000)
print("ROWS", sorted(r.page_id for r in W.read_listed(run).collect()) == list(range(120)), W.read_archives(spark, folder).count() > 120)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": f"{tmp_path}:{root}:{os.environ.get('PYTHONPATH', '')}"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=env)
    assert "ROWS True True" in out.stdout, out.stderr[-2000:]


def test_schemes_and_small_archives(spark):
    asked = [W.store_uri(uri) for uri in ("s3a://bucket/x", "wasbs://c@a.example/x", "hdfs://n/x", "/local/x")]
    assert asked == ["s3://bucket/x", "abfss://c@a.example/x", "hdfs://n/x", "/local/x"]
    manifest = W.write_archives(pages(spark, [(1, "u", "one small page")]), scratch_path(spark, "test-warc-one"))
    raw = open(manifest.first().path.removeprefix("file://"), "rb").read()
    assert int.from_bytes(raw[:4], "little") == W.DICTIONARY_MAGIC and int.from_bytes(raw[4:8], "little") > 0
    assert [(r.page_id, bytes(r.payload)) for r in W.read_listed(manifest, payloads=True).collect()] == [(1, b"one small page")]


def naive_pack(items, capacity):
    bins = []
    for length, s, c in items:
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= length and not b[1] & s and not b[2] & c]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, 0, 0])
        bins[k][0] -= length
        bins[k][1] |= s
        bins[k][2] |= c
        yield k


def test_packing_is_best_fit():
    rng = random.Random(6)
    for _ in range(60):
        items = sorted(((rng.randint(1, 30), 1 << rng.randrange(5), rng.choice([0, 0, 1, 2])) for _ in range(rng.randint(0, 80))), reverse=True)
        assert P.pack(items, 30) == list(naive_pack(items, 30))


def test_packing_rows(spark):
    rng = random.Random(7)
    texts = ODD + ["w " * rng.randint(0, 5000) for _ in range(300)] + ["copy of a text"] * 40
    sources = [rng.choice(["hot", "hot", "a", "b", "c", None]) for _ in texts]
    docs = documents(spark, texts, sources=sources)
    got = P.best_fit(docs, P.word_count("text"), shard_rows=100, source=F.col("source"), cluster=F.xxhash64("text")).collect()
    words = {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(words)
    for i, n in words.items():
        assert sum(r.n for r in pieces[i]) == n and all(r.length == n for r in pieces[i])
        assert (pieces[i][0].bin is None) == (n == 0)
    bins = {}
    for r in got:
        if r.bin is not None:
            bins.setdefault((r.shard, r.bin), []).append(r)
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert rows[0].offset == 0 and all(a.offset + a.n == b.offset for a, b in zip(rows, rows[1:]))
        assert sum(r.n for r in rows) <= P.CAPACITY
        named = [sources[r.doc_id] for r in rows if sources[r.doc_id]]
        assert len(named) == len(set(named)) and len({texts[r.doc_id] for r in rows}) == len(rows)
    assert P.best_fit(documents(spark, []), P.word_count("text")).collect() == []


def test_op8_packing_equals_a_naive_search(spark, sf_dir):
    """The whole query: every shard packed again by a plain list of bins."""
    from routelake.llm import queries as Q
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = Q.op8_packing(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(docs)

    def bits(values):
        often = Counter(v for v in values if v is not None)
        names = sorted(v for v, n in often.items() if n > 1)
        return [1 << names.index(v) if v in names else 0 for v in values]
    for shard in {r.shard for r in got}:
        rest = [r for r in got if r.shard == shard and r.bin is not None and r.n % P.CAPACITY]
        rest.sort(key=lambda r: (-r.n, r.doc_id))
        same = ["".join((docs[r.doc_id].text or "").split(" ")) and " ".join((docs[r.doc_id].text or "").split()) for r in rest]
        bins = list(naive_pack(list(zip([r.n for r in rest], bits([docs[r.doc_id].source for r in rest]), bits(same))), P.CAPACITY))
        assert [r.bin for r in rest] == bins
    for r in got:
        words = len((docs[r.doc_id].text or "").encode().split())
        assert r.length == words and (r.n == P.CAPACITY or r.n == words % P.CAPACITY)


def test_packing_of_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["a b c"] * 3 + ["d e"] * 3 + [None], sources=["s"] * 3 + [None] * 3 + ["s"], ids=[1, 1, None, None, None, 2, 2])
    got = P.best_fit(docs, P.word_count("text"), source=F.col("source"), cluster=F.xxhash64("text")).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter({(1, 3): 2, (None, 3): 1, (None, 2): 2, (2, 2): 1, (2, 0): 1})
    placed = [r for r in got if r.bin is not None]
    assert len({r.bin for r in placed if r.length == 3}) == 3 and len({r.bin for r in placed if r.length == 2}) == 3
