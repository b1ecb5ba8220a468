import random

from helpers import ODD, documents

from routelake.llm import token_count as T
from routelake.llm import unigram as U


def greedy(word, starts, continuations):
    n, at, pieces = 0, 0, starts
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at, pieces = n + 1, end, continuations
    return n


def test_automaton_equals_greedy_search():
    rng = random.Random(1)
    for _ in range(300):
        def some():
            return {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 9))}
        starts, continuations = some(), some()
        m = T.LongestMatch(starts, continuations)
        for _ in range(60):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(0, 12)))
            assert m.count(word) == greedy(word, starts, continuations), (word, starts, continuations)


def test_counts_equal_a_word_piece_library(spark):
    from tokenizers import models
    starts, continuations = T.read_pieces(T.read_file(T.VOCABULARY))
    vocabulary = {p: i for i, p in enumerate(dict.fromkeys(["[UNK]", *starts, *("##" + p for p in continuations)]))}
    library = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**7)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in T.count_tokens(docs).collect()}
    for r in docs.collect():
        pieces = [[t.value for t in library.tokenize(w.decode())] for w in r.text.encode().split()]
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens) == (len(pieces), sum(map(len, pieces)))
        assert got[r.doc_id].n_unknown == sum(p == ["[UNK]"] for p in pieces)


def test_counts_of_odd_rows(spark):
    got = {r.doc_id: r for r in T.count_tokens(documents(spark, ODD)).collect()}
    assert [(got[i].n_words, got[i].n_tokens) for i in range(4)] == [(0, 0)] * 4
    assert got[13].n_words == 60_000 and got[13][1:] == got[14][1:]
    assert got[15].n_words == 1 and got[15].n_tokens >= 1
    assert T.count_tokens(documents(spark, [])).collect() == []


def test_double_array_holds_exactly_its_keys():
    rng = random.Random(2)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randint(1, 5))): i for i in range(3000)}
    trie = U.DoubleArray(keys)
    for k, v in keys.items():
        assert (len(k), v) in list(trie.prefixes(k, 0))
    for _ in range(3000):
        text = bytes(rng.randrange(256) for _ in range(6))
        assert list(trie.prefixes(text, 0)) == [(e, keys[text[:e]]) for e in range(1, 7) if text[:e] in keys]


def test_viterbi_is_the_best_segmentation():
    rng = random.Random(3)
    for _ in range(60):
        pieces = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(8)})
        names = [f"<0x{b:02X}>" for b in range(256)]
        u = U.Unigram(names + pieces, [None] * 256 + [-rng.random() * 9 for _ in pieces], list(range(256)))

        def best(chunk):
            top = [0] + [None] * len(chunk)
            for e in range(1, len(chunk) + 1):
                options = [top[s] + u.scores[256 + pieces.index(chunk[s:e])] for s in range(e) if chunk[s:e] in pieces]
                if chunk[e - 1] not in pieces:
                    options.append(top[e - 1] + u.unknown)
                top[e] = max(options)
            return top[-1]
        for _ in range(20):
            text = "".join(rng.choice("abc▁") for _ in range(rng.randint(1, 9)))
            ids = u.best(text.encode())
            score, k = 0, 0
            while k < len(ids):
                if ids[k] < 256:
                    first = ids[k]
                    k += 1 if first < 0x80 else 3
                    score += u.unknown
                else:
                    score += u.scores[ids[k]]
                    k += 1
            assert score == best(text)


def test_ids_equal_a_library_and_come_back(spark):
    from tokenizers import Tokenizer, models
    u = U.read_model(T.read_file(T.VOCABULARY))
    library = Tokenizer(models.Unigram([(p, s / U.SCALE if s is not None else -1e6) for p, s in zip(u.pieces, u.scores)], unk_id=0, byte_fallback=True))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in U.round_trip(docs).collect()}
    for r in docs.limit(80).collect():
        assert got[r.doc_id].ids == library.encode(U.MARKER + r.text.replace(" ", U.MARKER)).ids
    for r in docs.collect():
        assert got[r.doc_id].text == r.text


def test_round_trip_of_odd_rows(spark):
    docs = documents(spark, ODD)
    coded = U.encode(docs)
    back = {r.doc_id: r.text for r in U.decode(coded).collect()}
    assert back == dict(enumerate(ODD))
    ids = {r.doc_id: r.ids for r in coded.collect()}
    assert ids[0] is None and ids[1] == []
    assert U.round_trip(documents(spark, [])).collect() == []


def test_null_and_repeated_ids(spark):
    docs = documents(spark, ["one two", "one two", "x", None], ids=[None, None, 3, 3])
    counted = T.count_tokens(docs).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in counted) == [("3", 0), ("3", 1), ("None", 2), ("None", 2)]
    coded = U.round_trip(docs).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in coded) == [("3", ""), ("3", "x"), ("None", "one two"), ("None", "one two")]


def test_chunks_searched_together_have_the_ids_of_single_ones():
    rng = random.Random(11)
    u = U.read_model(T.read_file(T.VOCABULARY))
    letters = "abcdefghiäöß日🙂\x00 \t.,;'0123456789"
    chunks = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 11, 20, 40, 90, 300]))).encode() for _ in range(4 * U.TOGETHER)]
    chunks += [b" ", b"\n", U.OWN_MARKER, b"a" + U.OWN_MARKER + b"b", b"\x00", b"q" * 5000]
    import numpy as np
    assert [np.frombuffer(x, np.int32).tolist() for x in u.best_of_all(chunks)] == [u.best(c) for c in chunks]
