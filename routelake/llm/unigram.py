"""SentencePiece-style unigram encoding and decoding.

Encoding: spaces become whitespace markers, one marker is put before the text, and a Viterbi
search takes the segmentation with the highest sum of piece scores. The pieces lie in a
double-array trie over their UTF-8 bytes. A character that no piece covers becomes one piece
per byte (byte fallback), at ``UNKNOWN_PENALTY`` below the lowest score. Decoding joins the
pieces, gathers bytes, turns markers into spaces and removes the first one.

Scores are integers (log scores times ``SCALE``), so sums are exact, and equal segmentations
are resolved alike everywhere: the longest last piece wins. Files that hold merge ranks
instead of log probabilities get Zipf scores, -log(rank + 1), from the rank order.

A marker that stands in a text itself is encoded as bytes, so decode(encode(text)) is the text
for every text. Since no piece holds a marker after another character (checked when the file
is read), the search runs per chunk between such places, and a worker remembers chunks. The
chunks of a batch of texts that it does not know are searched together: the walk through the
trie and the update of the best scores take one position of all chunks at a time.

Defined cases: rows with a null or repeated id are encoded like others; null text has null ids and decodes to null; the empty text has no ids; an empty
table gives an empty result; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_count import VOCABULARY, read_file
from .util import python_ready, slices

MARKER = "▁"
SCALE = 1 << 20
#: In log scores, as in the published unigram model.
UNKNOWN_PENALTY = 10.0
#: Chunks, and their bytes, whose ids a worker remembers before it starts afresh.
MEMO_CHUNKS = 250_000
MEMO_CHUNK_BYTES = 64
#: Chunks of up to so many bytes are searched together, from this number on (else one by one).
WIDTHS = (12, 24, 48, 96)
TOGETHER = 400
#: Most chunks searched together (bounds the arrays).
MOST_TOGETHER = 20_000
#: Stands for a marker that is part of a text: no valid UTF-8 byte, so no piece has it.
OWN_MARKER = b"\xff"
_NEVER = -1 << 62
ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, text string"


class DoubleArray:
    """A trie in two arrays: the child of state s by byte b is t = base[s] + b + 1 if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 12
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        # places below 257 are for the root's children; below dense a free place is rare, nodes of several children start there
        free = dense = 257
        queue = [(0, tree)]
        for state, node in queue:
            if -1 in node:
                self.value[state] = node[-1]
            labels = sorted(b for b in node if b >= 0)
            if not labels:
                continue
            while self.check[free] >= 0:
                free += 1
                self._grow(free + 300)
            base = first = 0 if state == 0 else (free if len(labels) == 1 else max(free, dense)) - labels[0] - 1
            while True:
                self._grow(base + 300)
                if all(self.check[base + b + 1] < 0 for b in labels):
                    break
                base += 1
            if base - first > 16:
                dense = base + labels[0] + 1
            self.base[state] = base
            for b in labels:
                self.check[base + b + 1] = state
            queue += [(base + b + 1, node[b]) for b in labels]

    def _grow(self, size: int) -> None:
        if size >= len(self.base):
            more = size + len(self.base)
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more

    def prefixes(self, text: bytes, at: int):
        """(end, value) of every key that begins at ``at``, shortest first."""
        base, check, value = self.base, self.check, self.value
        state = 0
        for i in range(at, len(text)):
            after = base[state] + text[i] + 1
            if check[after] != state or not after:
                return
            state = after
            if value[state] >= 0:
                yield i + 1, value[state]


class Unigram:
    """pieces: text of every id; scores: log score of every id or None where it takes no part in the search;
    byte_ids: id of every byte piece."""

    def __init__(self, pieces: list[str], scores: list[float | None], byte_ids: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.scores = [None if s is None else round(s * SCALE) for s in scores]
        usable = {p.encode(): i for i, (p, s) in enumerate(zip(pieces, self.scores, strict=True)) if s is not None and p}
        self.split_at_marker = not any(re.search(f"[^{MARKER}]{MARKER}", p) for p, s in zip(pieces, self.scores, strict=True) if s is not None)
        self.trie = DoubleArray(usable)
        self.unknown = min((s for s in self.scores if s is not None), default=0) - round(UNKNOWN_PENALTY * SCALE)
        self.raw = [p.encode().replace(MARKER.encode(), b" ") for p in pieces]
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])
        self._arrays = [np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)]
        self._scores = np.array([_NEVER if x is None else x for x in self.scores], np.int64)
        self._byte_ids = np.array(byte_ids, np.int32)

    def best(self, chunk: bytes) -> list[int]:
        """Ids of the best segmentation of a chunk (Viterbi over character boundaries); its spaces are markers."""
        chunk = chunk.replace(b" ", MARKER.encode())
        n = len(chunk)
        top, back, by = [_NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        top[0] = 0
        scores, base, check, value = self.scores, self.trie.base, self.trie.check, self.trie.value
        at = 0
        while at < n:
            lead = chunk[at]
            after_one = at + (1 if lead < 0x80 or lead == 0xFF else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, single = top[at], False
            state, end = 0, at
            while end < n:                 # every piece that begins here, shortest first (as trie.prefixes)
                after = base[state] + chunk[end] + 1
                if check[after] != state:
                    break
                state = after
                end += 1
                piece = value[state]
                if piece >= 0:
                    score = here + scores[piece]
                    if score > top[end]:
                        top[end], back[end], by[end] = score, at, piece
                    if end == after_one:
                        single = True
            if not single:
                score = here + self.unknown
                if score > top[after_one]:
                    top[after_one], back[after_one], by[after_one] = score, at, -1
            at = after_one
        out: list[int] = []
        while n:
            at, piece = back[n], by[n]
            if piece >= 0:
                out.append(piece)
            else:
                raw = MARKER.encode() if chunk[at:n] == OWN_MARKER else chunk[at:n]
                out += [self.byte_ids[b] for b in reversed(raw)]
            n = at
        out.reverse()
        return out

    def best_of_all(self, chunks: list[bytes]) -> list[bytes]:
        """``best`` of every chunk, as 32-bit ids in bytes."""
        out: list = [None] * len(chunks)
        data = [c.replace(b" ", MARKER.encode()) for c in chunks]
        by_width: dict[int, list[int]] = {}
        for i, c in enumerate(data):
            width = 0 if OWN_MARKER in c else next((w for w in WIDTHS if len(c) <= w), 0)
            by_width.setdefault(width, []).append(i)
        for width, some in by_width.items():
            for at in range(0, len(some), MOST_TOGETHER):
                part = some[at:at + MOST_TOGETHER]
                if width and len(part) >= TOGETHER:
                    found = self._together([data[i] for i in part], width)
                else:
                    found = [np.array(self.best(chunks[i]), np.int32).tobytes() for i in part]
                for i, ids in zip(part, found, strict=True):
                    out[i] = ids
        return out

    def _together(self, chunks: list[bytes], width: int) -> list[bytes]:
        """The Viterbi search of ``best`` over the columns of a matrix; markers are in place, no chunk holds one of its own."""
        (base, check, value), scores, count = self._arrays, self._scores, len(chunks)
        text = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in chunks), np.uint8).reshape(count, width).T.copy()
        n = np.fromiter(map(len, chunks), np.int64, count)
        top = np.full((width + 1, count), _NEVER, np.int64)
        back, by = np.zeros((width + 1, count), np.int64), np.full((width + 1, count), -1, np.int32)
        top[0] = 0

        def offer(end, who, score, start, piece):
            better = score > top[end, who]
            end, who = (end if np.isscalar(end) else end[better]), who[better]
            top[end, who], back[end, who] = score[better], start
            by[end, who] = piece if np.isscalar(piece) else piece[better]

        for at in range(width):
            begun = np.flatnonzero((top[at] > _NEVER) & (n > at))
            if not len(begun):
                continue
            lead = text[at, begun]
            size = 1 + (lead >= 0xC0) + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
            here, single = top[at, begun], np.zeros(len(begun), bool)
            who, slot, state, end = begun, np.arange(len(begun)), np.zeros(len(begun), np.int64), at
            while len(who):
                after = base[state] + text[end, who].astype(np.int64) + 1
                ok = check[after] == state
                who, slot, state = who[ok], slot[ok], after[ok]
                end += 1
                piece = value[state]
                hit = piece >= 0
                if hit.any():
                    offer(end, who[hit], here[slot[hit]] + scores[piece[hit]], at, piece[hit])
                    single[slot[hit & (size[slot] == end - at)]] = True
                on = n[who] > end
                who, slot, state = who[on], slot[on], state[on]
            lone = ~single
            if lone.any():
                offer(at + size[lone], begun[lone], here[lone] + self.unknown, at, -1)
        # ids stand at the place where their piece (or byte) ends, so they are in order
        ids = np.full((count, width + 1), -1, np.int32)
        who, end = np.flatnonzero(n), n[n > 0]
        while len(who):
            piece, start = by[end, who], back[end, who]
            known = piece >= 0
            ids[who[known], end[known]] = piece[known]
            w, s, e = who[~known], start[~known], end[~known]
            for k in range(4):
                inside = s + k < e
                ids[w[inside], s[inside] + k + 1] = self._byte_ids[text[s[inside] + k, w[inside]]]
            who, end = who[start > 0], start[start > 0]
        taken = ids >= 0
        data, ends = ids[taken].tobytes(), (np.cumsum(taken.sum(axis=1)) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def chunks(self, text: str) -> list[bytes]:
        data = (b" " + text.encode()).replace(MARKER.encode(), OWN_MARKER)
        return re.findall(rb" +[^ \n]*|\n+[^ \n]*|[^ \n]+", data) if self.split_at_marker else [data]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.best(c)] if text else []

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def read_model(model: bytes) -> Unigram:
    """The pieces of a SentencePiece file; merge ranks become Zipf scores."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = m.get_piece_size()
    usable = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(size)]
    pieces = [m.id_to_piece(i) for i in range(size)]
    given = [m.get_score(i) for i in range(size)]
    ranks = all(given[i] == int(given[i]) for i in range(size) if usable[i])
    scores = [(-math.log(1 - given[i] + 1) if ranks else given[i]) if usable[i] else None for i in range(size)]
    byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(m.is_byte(i) for i in byte_ids):
        raise ValueError("byte fallback needs all 256 byte pieces")
    if any("\n" in p and len(p) > 1 for p, u in zip(pieces, usable, strict=True) if u):
        raise ValueError("pieces across line ends are not supported")
    return Unigram(pieces, scores, byte_ids)


class _Memo:
    """Ids of chunks seen by this worker, in two generations: when the younger one is full it
    becomes the older one, and a chunk that is met again moves to the younger one."""

    def __init__(self, unigram: Unigram):
        self.unigram = unigram
        self.younger: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids_of(self, texts: list) -> list:
        """Per text its ids as 32-bit numbers in bytes; None for None."""
        split = [self.unigram.chunks(t) if t else [] for t in texts]
        known = self.younger
        wanted = set().union(*split) - known.keys()
        older = self.older
        met = {c: older[c] for c in wanted if c in older}
        known.update(met)
        new = [c for c in wanted if c not in met]
        long = {}
        for c, ids in zip(new, self.unigram.best_of_all(new), strict=True):
            if len(c) <= MEMO_CHUNK_BYTES:
                known[c] = ids
            else:
                long[c] = ids
        get = known.__getitem__ if not long else lambda c: long[c] if c in long else known[c]
        out = [None if t is None else b"".join(map(get, s)) for t, s in zip(texts, split, strict=True)]
        if len(known) > MEMO_CHUNKS:
            self.older, self.younger = known, {}
        return out


def _lists(ids: list):
    """An Arrow list array of the ids in bytes; None is null."""
    import pyarrow as pa
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([0 if x is None else len(x) // 4 for x in ids], out=ends[1:])
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(x for x in ids if x))])
    nulls = pa.array([x is None for x in ids], pa.bool_()) if None in ids else None
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=nulls)


@lru_cache(maxsize=2)
def _model(content: bytes) -> _Memo:
    """The model and what this worker remembers, kept from task to task."""
    return _Memo(read_model(content))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids."""
    spark = docs.sparkSession
    python_ready(spark)
    content = spark.sparkContext.broadcast(read_file(vocabulary))

    def run(batches):
        import pyarrow as pa
        memo = _model(content.value)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(memo.ids_of(part.column(1).to_pylist()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text."""
    spark = encoded.sparkSession
    python_ready(spark)
    content = spark.sparkContext.broadcast(read_file(vocabulary))

    def run(batches):
        import pyarrow as pa
        unigram = _model(content.value).unigram
        for part in slices(batches):
            text = [None if ids is None else unigram.decode(ids) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, DECODED)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoding and decoding in one pass: doc_id, ids, and the text decoded from the ids."""
    spark = docs.sparkSession
    python_ready(spark)
    content = spark.sparkContext.broadcast(read_file(vocabulary))

    def run(batches):
        import pyarrow as pa
        memo = _model(content.value)
        for part in slices(batches):
            ids = memo.ids_of(part.column(1).to_pylist())
            text = [None if x is None else memo.unigram.decode(memoryview(x).cast("i")) for x in ids]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids), pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")
