"""Token counts by a linear longest-match automaton.

A word is cut greedily: from the left, always the longest piece of the vocabulary that matches. First pieces start with a
mark (here a blank before the word), later ones do not. The trie of the vocabulary has, at each node, a failure link and the
number of pieces popped on the way: popped[v] pieces cover all of v's string but the suffix that fail[v] stands for. So a word's
count is found by reading each character once and adding popped counts, without making a piece. A word that cannot be covered
counts as one unknown token.

Defined cases: null and empty texts have no words and no tokens; one row per input row, repeated ones too, and none for an
empty table; a very long text is a slice of its own, and a word may have any length; a word is cut in one way alone, so there are
no ties; columns other than key and text are not read.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as T
from tesserae.llm.automaton import ABREAST, Trie, batches, matrix

MARK = " "
#: What an executor is sent is bounded by the number of pieces.
MAX_PIECES = 1_000_000


def load(path: str) -> tuple[str, ...]:
    """The pieces of a .model file whose first pieces start with U+2581, with blanks for it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)))
    return tuple(model.id_to_piece(k).replace("▁", MARK) for k in plain)


class Counter:
    def __init__(self, pieces: tuple[str, ...]):
        if len(pieces) > MAX_PIECES:
            raise ValueError(f"more than {MAX_PIECES} pieces")
        t = self.trie = Trie(pieces)
        n = len(t.parent)
        self.fail, self.popped = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        for own in t.levels():
            ends = t.end[own] >= 0
            self.fail[own[ends]], self.popped[own[ends]] = 0, 1
            own = own[~ends]
            z, count, char = self.fail[t.parent[own]], self.popped[t.parent[own]], t.char[own]
            rows = np.flatnonzero(z >= 0)
            while len(rows):
                to = t.goto(z[rows], char[rows])
                done, go = rows[to >= 0], rows[to < 0]
                self.fail[own[done]], self.popped[own[done]] = to[to >= 0], count[done]
                count[go] += self.popped[z[go]]
                z[go] = self.fail[z[go]]
                rows = go[z[go] >= 0]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_plain"}

    @cached_property
    def _plain(self):
        return self.trie.edges(), self.fail.tolist(), self.popped.tolist()

    def one(self, word: str) -> int:
        """Pieces of one word with its mark; -1 if it cannot be covered."""
        (edges, fail, popped), node, count = self._plain, 0, 0
        for c in map(ord, word):
            while (node << 21 | c) not in edges:
                if fail[node] < 0:
                    return -1
                count += popped[node]
                node = fail[node]
            node = edges[node << 21 | c]
        while node:
            if fail[node] < 0:
                return -1
            count += popped[node]
            node = fail[node]
        return count

    def many(self, words: list[str]) -> np.ndarray:
        """Pieces of each word with its mark; -1 if it cannot be covered."""
        lengths = np.array([len(x) for x in words], np.int64)
        out = np.zeros(len(words), np.int64)
        for own in batches(lengths):
            some = [words[k] for k in own.tolist()]
            out[own] = self._walk(some, lengths[own]) if len(own) >= ABREAST else [self.one(w) for w in some]
        return out

    def _pop(self, node: np.ndarray, count: np.ndarray, dead: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Follows the failure links of rows; those that have one are left."""
        at = node[rows]
        lost = self.fail[at] < 0
        dead[rows[lost]] = True
        rows, at = rows[~lost], at[~lost]
        count[rows] += self.popped[at]
        node[rows] = self.fail[at]
        return rows

    def _walk(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        width, n = int(lengths[-1]), len(words)
        chars = matrix(words, width)
        node, count, dead = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        for i in range(width):
            rows = np.arange(int(np.searchsorted(lengths, i + 1)), n)
            rows = rows[~dead[rows]]
            while len(rows):
                to = self.trie.goto(node[rows], chars[i, rows])
                node[rows[to >= 0]] = to[to >= 0]
                rows = self._pop(node, count, dead, rows[to < 0])
        rows = np.flatnonzero((node > 0) & ~dead)
        while len(rows):
            rows = self._pop(node, count, dead, rows)
            rows = rows[node[rows] > 0]
        return np.where(dead, -1, count)


def token_counts(docs: DataFrame, pieces: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens (an unknown word is one), n_unknown (words that cannot be covered) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(Counter(pieces))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in T.slices(batches, "text", 2 << 20):
            flat, count = T.words(b.column("text"), lower=False)
            code, distinct = T.codes(flat)
            n = shared.value.many([MARK + w for w in distinct.to_pylist()])
            tokens, unknown = np.where(n < 0, 1, n)[code], (n < 0)[code].astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count), pa.array(T.sums(tokens, count)), pa.array(T.sums(unknown, count))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
