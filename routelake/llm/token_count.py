"""Token counts by a linear longest-match automaton.

Greedy word-piece segmentation takes the longest piece at the start of a word, then the
longest continuation piece after it, and so on. The automaton is a trie of the vocabulary in
which every node has a failure link and the number of pieces that are popped when it is
followed, so a word's length in pieces is known after one pass over its characters, without
backtracking and without building the pieces.

Vocabulary: the pieces of a SentencePiece file. A piece with a leading marker starts a word
(marker removed), any other continues one; control, unknown and byte pieces take no part.
Words are the runs of ``[^\\x20\\x09-\\x0D]+``. A word that has no greedy segmentation is one
unknown token. Words of any length are segmented; nothing is cut off.

Defined cases: null and empty text have no words and no tokens; an empty table gives an empty
result; repeated rows and rows with a null id give their own results; other columns are ignored.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import python_ready, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The vocabulary file is sent to the executors; a larger one is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Words whose counts a worker remembers before it starts afresh.
MEMO_WORDS = 400_000
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


class LongestMatch:
    """``count(word)``: pieces of the greedy segmentation, or -1 if there is none."""

    def __init__(self, starts, continuations):
        self.go: list[dict[str, int]] = [{}, {}]      # node 0: word start, node 1: continuation
        final = [False, False]
        for root, pieces in ((0, starts), (1, continuations)):
            for piece in pieces:
                node = root
                for ch in piece:
                    after = self.go[node].get(ch)
                    if after is None:
                        after = self.go[node][ch] = len(self.go)
                        self.go.append({})
                        final.append(False)
                    node = after
                if node != root:
                    final[node] = True
        # breadth first: the link of a node follows from its parent's
        self.fail = [-1] * len(self.go)               # -1: no segmentation from here
        self.popped = [0] * len(self.go)
        queue = [0, 1]
        for node in queue:
            for ch, child in self.go[node].items():
                if final[child]:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    back, popped = self.fail[node], self.popped[node]
                    while back >= 0 and ch not in self.go[back]:
                        popped += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[child], self.popped[child] = self.go[back][ch], popped
                queue.append(child)

    def count(self, word: str) -> int:
        go, fail, popped = self.go, self.fail, self.popped
        node = n = 0
        for ch in word:
            after = go[node].get(ch)
            while after is None:
                if fail[node] < 0:
                    return -1
                n += popped[node]
                node = fail[node]
                after = go[node].get(ch)
            node = after
        while node != 1:
            if fail[node] < 0:
                return -1 if node else 0
            n += popped[node]
            node = fail[node]
        return n


def read_pieces(model: bytes) -> tuple[list[str], list[str]]:
    """Word-start and continuation pieces of a SentencePiece file's content."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_proto=model)
    starts, continuations = [], []
    for i in range(m.get_piece_size()):
        if m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i):
            continue
        piece = m.id_to_piece(i)
        if piece.startswith("▁"):
            starts.append(piece[1:])
        else:
            continuations.append(piece)
    return [p for p in starts if p], continuations


@lru_cache(maxsize=2)
def _automaton(model: bytes) -> LongestMatch:
    return LongestMatch(*read_pieces(model))


class _Memo(dict):
    """Counts of words seen by this worker; others are computed by the automaton."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(word.decode("utf-8"))
        return n


def read_file(path: str, most: int = MAX_VOCABULARY_BYTES) -> bytes:
    """A vocabulary file's content, refused beyond ``most`` bytes."""
    if os.path.getsize(path) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens, n_unknown (words without segmentation)."""
    spark = docs.sparkSession
    python_ready(spark)
    model = spark.sparkContext.broadcast(read_file(vocabulary))

    def run(batches):
        import pyarrow as pa
        memo = _Memo(_automaton(model.value))
        get = memo.__getitem__
        for part in slices(batches):
            words, tokens, unknown = [], [], []
            for text in part.column(1).to_pylist():
                counts = list(map(get, text.split())) if text else []   # bytes.split(): exactly these white-space bytes
                bad = counts.count(-1)
                words.append(len(counts))
                tokens.append(sum(counts) + 2 * bad)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64()), pa.array(unknown, pa.int64())],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
