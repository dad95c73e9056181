"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads each character once; at each position the output links give every piece that ends there, longest first,
and each is relaxed from the best path that ends where the piece starts: the sum of piece scores is the larger the better, and
of equal sums the one found first stays. Of a BPE model, whose scores only rank merges, the largest sum of all would be another
segmentation than the merges' own. There a step from one piece to the next counts only if the merges would leave just these two
side by side (it is open; a closed step costs infinity). That is the order of merges as a score: at each position the sum over open
paths stays finite for one piece alone, and the path to the end is what the merges give. Units of all lengths go this way.

A character that is no piece is written as the pieces of its UTF-8 bytes (or as the unknown piece, if the model has no byte
pieces); it costs the smallest score less 10.

Blanks become U+2581 and one is put before a text, if the model says so; other characters stay as they are (models with a
character map are refused). No piece crosses from a character into a following blank or into or out of a line feed (checked
when a model is loaded), so texts are cut there into units, and each distinct unit of a slice is segmented once.

Decoding joins the pieces, turns U+2581 into blanks and drops the first. decode(encode(x)) is x with U+2581 read as a blank.

Defined cases: a null or empty text has no ids, and null or empty ids decode to an empty text; rows keep their number and
order, repeated ones too; an empty table gives an empty one; a very long text is a slice of its own, and a unit of it without
blanks may have any length; of paths with equal sums the one with the longer last piece stays; ids outside the vocabulary decode to
nothing, as control pieces do; other columns pass through as they are, and one named like the result is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as T
from tesserae.llm.automaton import ABREAST, IntMap, Trie, batches, matrix

UNKNOWN_COST = 10.0
#: Bytes of text that are encoded at once.
SLICE = 2 << 20
#: What an executor is sent is bounded by the number of pieces.
MAX_PIECES = 1_000_000


@dataclass(frozen=True)
class Pieces:
    """Pieces with blanks for U+2581, their scores, and what each is: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    prefix: bool = True
    bpe: bool = False

    def __post_init__(self):
        if len(self.pieces) > MAX_PIECES:
            raise ValueError(f"more than {MAX_PIECES} pieces")
        if any(k in (1, 4) and re.search(r"[^ ] |.\n|\n.", p, re.S) for p, k in zip(self.pieces, self.kinds, strict=True)):
            raise ValueError("a piece crosses a blank or a line feed")


def load(path: str) -> Pieces:
    """Reads a .model file on the driver."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
        raise ValueError("only models without a character map and without white-space removal are supported")
    p = model.pieces
    return Pieces(tuple(x.piece.replace("▁", " ") for x in p), tuple(x.score for x in p), tuple(x.type for x in p), norm.add_dummy_prefix, model.trainer_spec.model_type == 2)


class Merges:
    """The merges of a BPE model. Symbols: single characters first, then longer pieces, those that merge earlier first.

    strings, ids, reached (whether merging the symbol's characters gives the symbol) are for the build. left and right: the last two
    parts of each symbol; rank: when it is merged, equal for equal scores; made: the symbol of two parts.
    """

    def __init__(self, model: Pieces):
        own = {p: k for k, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind in (1, 4)}
        chars = sorted({c for p in own for c in p})
        self.strings = chars + sorted((p for p in own if len(p) > 1), key=lambda p: (-model.scores[own[p]], own[p]))
        self.ids = np.array([own.get(x, -1) for x in self.strings], np.int32)
        symbol = {x: k for k, x in enumerate(self.strings)}
        cost = [0.0] * len(chars) + [-model.scores[own[x]] for x in self.strings[len(chars) :]]
        self.left, self.right = (np.arange(len(self.strings), dtype=np.int32) for _ in range(2))
        self.rank = np.unique(cost, return_inverse=True)[1].astype(np.int32)
        self.reached = np.ones(len(self.strings), bool)
        for k in range(len(chars), len(self.strings)):
            parts, last = _merged(self.strings[k], symbol, cost)
            self.reached[k] = parts == 1
            if self.reached[k]:
                self.left[k], self.right[k] = symbol[last[0]], symbol[last[1]]
        k = np.arange(len(chars), len(self.strings))[self.reached[len(chars) :]]
        self.made = IntMap((self.left[k].astype(np.int64) << 21) | self.right[k], k.astype(np.int32))

    def open(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether the merges leave these two symbols side by side (-1: a character that is in no piece, which nothing merges with).

        Merges are undone from the latest on: the one with the larger rank, of equal ranks the right one. At each stage a pair
        across the cut that would have merged before the merge just undone shows that the cut would not have stayed: one of a
        smaller rank, or of the same rank and farther left.
        """
        out = np.ones(len(one), bool)
        rows = np.flatnonzero((one >= 0) & (two >= 0))
        a, b = one[rows], two[rows]
        limit = np.full(len(rows), 1 << 30, np.int32)
        while len(rows):
            across = self.made.get((a.astype(np.int64) << 21) | b)
            shut = (across >= 0) & (self.rank[across] < limit)
            out[rows[shut]] = False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            go = ~shut & ~(whole_a & whole_b)
            first = go & ((self.rank[a] > self.rank[b]) & ~whole_a | whole_b)
            second = go & ~first
            limit = np.where(first, self.rank[a], np.where(second, self.rank[b] + 1, limit))
            a, b = np.where(first, self.right[a], a), np.where(second, self.left[b], b)
            rows, a, b, limit = rows[go], a[go], b[go], limit[go]
        return out

    @cached_property
    def _plain(self):
        return self.made.as_dict(), self.left.tolist(), self.right.tolist(), self.rank.tolist()

    def open_one(self, a: int, b: int) -> bool:
        """open() of one pair."""
        made, left, right, rank = self._plain
        limit = 1 << 30
        while a >= 0 and b >= 0:
            across = made.get(a << 21 | b)
            if across is not None and rank[across] < limit:
                return False
            whole_a, whole_b = left[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            if whole_b or rank[a] > rank[b] and not whole_a:
                limit, a = rank[a], right[a]
            else:
                limit, b = rank[b] + 1, left[b]
        return True


def _merged(piece: str, symbol: dict[str, int], cost: list[float]) -> tuple[int, tuple[str, str]]:
    """How many parts merging leaves of a piece's characters, and the last two that merged: always the cheapest pair, of equal ones the leftmost."""
    parts: list[str | None] = list(piece)
    before, after, last, n = list(range(-1, len(piece) - 1)), [*range(1, len(piece)), -1], ("", ""), len(piece)
    pair = lambda a, b: (cost[k], a, parts[a] + parts[b], b) if (k := symbol.get(parts[a] + parts[b])) is not None else None
    heap = [x for a in range(len(piece) - 1) if (x := pair(a, a + 1))]
    heapify(heap)
    while heap:
        _, a, both, b = heappop(heap)
        if parts[a] is None or after[a] != b or parts[a] + parts[b] != both:
            continue
        last = parts[a], parts[b]
        parts[a], parts[b], after[a], n = both, None, after[b], n - 1
        if after[b] >= 0:
            before[after[b]] = a
        for c, d in ((before[a], a), (a, after[a])):
            if c >= 0 and d >= 0 and (x := pair(c, d)):
                heappush(heap, x)
    return n, last


class Segmenter:
    """A model as flat arrays. By trie node: id_at and score_at of the piece that ends there, and symbol_at in a BPE model."""

    def __init__(self, model: Pieces):
        self.prefix, self.size = model.prefix, len(model.pieces)
        self.merges = Merges(model) if model.bpe else None
        if self.merges:
            own = np.flatnonzero(self.merges.reached)
            self.trie = Trie([self.merges.strings[k] for k in own.tolist()])
            self.symbol_at = np.where(self.trie.end >= 0, own[self.trie.end], -1).astype(np.int32)
            self.id_at = np.where(self.symbol_at >= 0, self.merges.ids[self.symbol_at], -1).astype(np.int32)
            del self.merges.strings, self.merges.ids, self.merges.reached
        else:
            own = np.array([k for k, kind in enumerate(model.kinds) if kind in (1, 4)], np.int32)
            self.trie = Trie([model.pieces[k] for k in own.tolist()])
            self.id_at = np.where(self.trie.end >= 0, own[self.trie.end] if len(own) else -1, -1).astype(np.int32)
        score = np.array(model.scores, np.float64)
        usable = score[[k for k, kind in enumerate(model.kinds) if kind in (1, 4)]]
        self.unknown = float(usable.min(initial=0.0)) - UNKNOWN_COST
        # characters that are no pieces, but occur in pieces of a BPE model, cost as much as unknown ones
        self.score_at = np.where(self.id_at >= 0, score[self.id_at], self.unknown if self.merges else -np.inf)
        self.fail, self.out = self.trie.suffix_links()
        self.byte_ids = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == 6}
        self.unk_id = next((k for k, kind in enumerate(model.kinds) if kind == 2), 0)
        raw = [b"" if kind in (2, 3, 5) else bytes([int(p[3:5], 16)]) if kind == 6 else p.encode() for p, kind in zip(model.pieces, model.kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_length = np.array([*map(len, raw), 0], np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_plain"}

    def _spell(self, char: str) -> list[int]:
        return [self.byte_ids.get(b, self.unk_id) for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unk_id]

    @cached_property
    def _plain(self):
        t = self.trie
        return t.edges(), *(x.tolist() for x in (self.fail, self.out, t.end, t.depth, self.id_at, self.score_at, self.symbol_at if self.merges else self.id_at))

    def one(self, unit: str) -> list[int]:
        """The ids of one unit, read character by character."""
        edges, fail, outs, end, depth, id_at, score_at, symbol_at = self._plain
        n, node, opens = len(unit), 0, self.merges.open_one if self.merges else None
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for i, c in enumerate(map(ord, unit), 1):
            while node and (node << 21 | c) not in edges:
                node = fail[node]
            node = edges.get(node << 21 | c, 0)
            o, single, top, at = node if end[node] >= 0 else outs[node], False, -np.inf, 0
            while o:
                start = i - depth[o]
                single |= start == i - 1
                now = best[start] + score_at[o]
                if now > top and (opens is None or not start or not back[start] or opens(symbol_at[back[start]], symbol_at[o])):
                    top, at = now, o
                    if opens:  # one open path alone ends here
                        single = True
                        break
                o = outs[o]
            if not single and best[i - 1] + self.unknown > top:
                top, at = best[i - 1] + self.unknown, 0
            best[i], back[i] = top, at
        out, i = [], n
        while i:
            v = back[i]
            out.append([id_at[v]] if v and id_at[v] >= 0 else self._spell(unit[i - 1]))
            i -= depth[v] if v else 1
        return [k for ids in reversed(out) for k in ids]

    def many(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all units one after the other, and how many each has."""
        lengths = np.array([len(x) for x in units], np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for own in batches(lengths):
            if len(own) >= ABREAST:
                parts.append(self._walk([units[k] for k in own.tolist()], lengths[own], own))
                continue
            for k in own.tolist():
                ids = np.array(self.one(units[k]), np.int32)
                parts.append((np.full(len(ids), k), np.arange(len(ids)), ids))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
        unit, place, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids[np.lexsort((place, unit))], np.bincount(unit, minlength=len(units))

    def _walk(self, units: list[str], lengths: np.ndarray, own: np.ndarray):
        """(unit, place, id) of all pieces of units sorted by length."""
        width, n = int(lengths[-1]), len(units)
        chars = matrix(units, width)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)
        node = np.zeros(n, np.int32)
        for i in range(1, width + 1):
            a = int(np.searchsorted(lengths, i))  # units that reach position i
            c, s = chars[i - 1, a:], node[a:]
            to = self.trie.goto(s, c)
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                stuck = stuck[s[stuck] > 0]
                s[stuck] = self.fail[s[stuck]]
                to[stuck] = self.trie.goto(s[stuck], c[stuck])
                stuck = stuck[to[stuck] < 0]
            node[a:] = s = np.maximum(to, 0)
            self._relax(i, a, np.where(self.trie.end[s] >= 0, s, self.out[s]), best, back)
        rows, at, found = np.arange(n), lengths.copy(), []
        while len(rows):
            v = back[at[rows], rows]
            found.append((rows, at[rows], v))
            at[rows] -= np.maximum(self.trie.depth[v], 1)
            rows = rows[at[rows] > 0]
        row, place, v = (np.concatenate(x) for x in zip(*found, strict=True))
        known = (v > 0) & (self.id_at[v] >= 0)
        out = [(own[row[known]], place[known] * 4, self.id_at[v[known]])]
        for r, p in zip(row[~known].tolist(), place[~known].tolist(), strict=True):
            ids = self._spell(units[r][p - 1])
            out.append((np.full(len(ids), own[r]), p * 4 + np.arange(len(ids)), np.array(ids, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _relax(self, i: int, a: int, o: np.ndarray, best: np.ndarray, back: np.ndarray) -> None:
        """Position i of the units from a on: the pieces that end there, by the sum of scores over open steps."""
        top, bp, single = best[i, a:], back[i, a:], np.zeros(len(o), bool)
        row = np.flatnonzero(o)
        while len(row):
            v = o[row]
            start = i - self.trie.depth[v]
            single[row[start == i - 1]] = True
            now = best[start, a + row] + self.score_at[v]
            better = now > top[row]
            if self.merges:
                before = back[start, a + row]  # 0: the unit's start, or an unknown character, which nothing merges with
                better[better] = self.merges.open(np.where(before > 0, self.symbol_at[before], -1)[better], self.symbol_at[v[better]])
            top[row[better]], bp[row[better]] = now[better], v[better]
            o[row] = v = self.out[v]
            row = row[(v > 0) & ~better] if self.merges else row[v > 0]  # one open path alone ends here
        row = np.flatnonzero(~single & (top == -np.inf) if self.merges else ~single)
        now = best[i - 1, a + row] + self.unknown
        better = now > top[row]
        top[row[better]], bp[row[better]] = now[better], 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after the other, and how many each has."""
        texts = pc.replace_substring(T.plain(texts), "▁", " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        raw, at = T.data(texts)
        blank, feed = raw == 32, raw == 10
        start = feed | (blank & ~np.append(False, blank[:-1])) | np.append(False, feed[:-1]) if len(raw) else feed
        start = start.copy()
        start[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(start)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))
        code, distinct = T.codes(units)
        ids, n = self.many(distinct.to_pylist())
        first = np.cumsum(n) - n
        each = n[code] if len(code) else np.zeros(0, np.int64)
        begin = np.cumsum(each) - each
        place = np.arange(int(each.sum())) - np.repeat(begin, each)
        flat = ids[np.repeat(first[code], each) + place] if len(place) else np.zeros(0, np.int64)
        return flat.astype(np.int32), np.diff(np.append(begin, len(flat))[np.searchsorted(starts, at)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids."""
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        size = self.raw_length[ids]
        begin = np.cumsum(size) - size
        raw = self.raw[np.repeat(self.raw_start[ids] - begin, size) + np.arange(int(size.sum()))].tobytes() if size.sum() else b""
        ends = np.cumsum(T.sums(size, counts)).tolist()
        out, cut = [], int(self.prefix)
        for a, b in zip([0, *ends], ends, strict=False):
            x = raw[a:b].decode("utf-8", "replace")
            out.append(x[cut:] if x[:1] == " " else x)
        return out


def _plain(df: DataFrame, used: str, out: str, kind: str) -> tuple[DataFrame, list[str], str, list[str]]:
    """The columns but `out` under names of our own, as they may have any; these names, the schema with `out` of this kind, and the names to give back."""
    rest = [c for c in df.columns if c != out]
    named = [f"c{k}" for k in range(len(rest))]
    rows = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(rest, named, strict=True)), F.col(f"`{used}`").alias("used"))
    return rows, named, "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in named) + f"out {kind}", [*rest, out]


def encode(docs: DataFrame, model: Segmenter, text: str = "text", out: str = "ids") -> DataFrame:
    """The rows of docs, with the array of ids of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, named, schema, names = _plain(docs, text, out, "array<int>")

    def run(batches):
        for b in T.slices(batches, "used", SLICE):
            ids, n = shared.value.encode(b.column("used"))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in named), lists], [*named, "out"])

    return rows.mapInArrow(run, schema).toDF(*names)


def decode(rows: DataFrame, model: Segmenter, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows, with the text that the ids stand for."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows, named, schema, names = _plain(rows, ids, out, "string")

    def run(batches):
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("used")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(np.diff(np.cumsum(size) // (SLICE // 4))) + 1  # ids that stand for about SLICE bytes
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                b = batch.slice(x, y - x)
                flat = pc.fill_null(b.column("used").flatten(), -1).to_numpy(zero_copy_only=False)
                texts = shared.value.decode(flat.astype(np.int64), size[x:y])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in named), pa.array(texts, pa.string())], [*named, "out"])

    return rows.mapInArrow(run, schema).toDF(*names)


def digest(docs: DataFrame, model: Segmenter) -> DataFrame:
    """doc_id, n_tokens, ids_hash (xxhash64 of the ids), text_hash (of the text, null as empty), decoded_hash (of decode(encode(text))), same."""
    rows = docs.select("doc_id", F.col("text").alias("text"))
    both = decode(encode(rows, model).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "ids"), model)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "text_hash",
        F.xxhash64("decoded").alias("decoded_hash"), (F.xxhash64("decoded") == F.col("text_hash")).alias("same"),
    )
