"""Language-model scoring with a hidden Markov model over words.

Symbols are the words of the head of the training vocabulary (at most `head` words, those with the largest counts, each seen
twice at least), an end, and 64 classes by spelling for all other words. States emit symbols; a word of a class then has
probability (c - d) / N_k, and a word not seen (all of them together, as in the base score) d * V_k / N_k, with N_k and V_k the class's
training tokens and distinct words and d its absolute discount. So probabilities of known words and the unknown one add up to 1.

Training: words are counted per task, then by word; the counts of all training texts are a table in the shared folder, and
only the head comes to the driver. Texts are encoded once into symbols. The states start from counts of the whole corpus: every
training text goes to the nearest of a few centres, and symbols are counted by centre. The centres come from at most SEEDS texts,
those with the smallest hashes of key and text, of which only BUCKETS sums of symbols each are looked at. Baum-Welch: tasks run
forward and backward over their texts, expected counts are added up by symbol in a shuffle, and the new tables of states x symbols go
out as a broadcast, until the likelihood settles or for ROUNDS rounds. Nothing depends on how rows are dealt over partitions.

Long texts are cut into windows that are run side by side: each later window is first run from every state, which gives a matrix
from its entry to its end; the product of the matrices gives the exact forward and backward values at all borders. So
counts and likelihoods are those of whole texts.

Scoring: the scaled forward recursion over each whole text gives its exact likelihood; words outside the head get their part
from a join with the counts by word.

Defined cases: a null text counts as empty and has just its end; a null key counts as held out; rows are told apart by
themselves, so repeated keys and rows keep scores of their own, and repeated rows are learned from as often as they occur; an empty
table gives an empty one; a very long text is a slice of its own; words with equal counts are in the head together or not at all;
of equally near centres the first counts; without training rows all words are unknown and N is 0; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as T
from tesserae.llm.common import fold, keep

HEAD, CLASSES, STATES = 131_072, 64, 6
#: Rounds of Baum-Welch at most, and the relative gain of the log-likelihood below which they end.
ROUNDS, SETTLED = 6, 1e-3
SEEDS, BUCKETS = 256, 256
#: Tokens of a window, windows that are run side by side, and tokens of texts that are looked at together.
WINDOW, GROUP, TOKENS = 512, 512, 1 << 20
#: Tokens between two scalings where no scale is needed for itself; probabilities of so many tokens are no underflow.
SCALED = 8
#: Count classes per doubling, by which the head is cut off.
STEPS = 16


def spelling(word: Column) -> Column:
    """The class of a word outside the head."""
    return F.pmod(F.crc32(F.substring(word.cast("binary"), -3, 3)), F.lit(CLASSES)).cast("int")


def _spelling(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c of all words of the column text; the empty word stands for the end of a text."""

    def run(batches):
        for b in T.slices(batches):
            code, distinct = T.codes(T.words(b.column("text"))[0])
            n = np.bincount(code, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([distinct.cast(pa.string()), pa.array([""])]), pa.array(np.append(n, b.num_rows))], ["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Vocabulary:
    """words and counts of the head; of each class: tokens, distinct words, discount; n, v: all tokens and distinct words."""

    words: pa.Array
    counts: np.ndarray
    tokens: np.ndarray
    distinct: np.ndarray
    discount: np.ndarray
    least: float
    n: int
    v: int

    @property
    def symbols(self) -> int:
        return len(self.counts) + CLASSES

    def shares(self) -> np.ndarray:
        """Of each symbol in the training tokens; a class without any counts as half a token."""
        x = np.append(self.counts, np.maximum(self.tokens, 0.5)).astype(float)
        return x / x.sum()


def _level(c: Column) -> Column:
    return F.floor(F.log2(c) * STEPS)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    levels = counts.groupBy(_level(F.col("c")).alias("level")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).toPandas().sort_values("level", ascending=False)
    fits = levels[(levels["v"].cumsum() <= head - 1) & (levels["level"] >= STEPS)]
    least = float(fits["level"].min()) if len(fits) else math.inf
    in_head = (_level(F.col("c")) >= least) | (F.col("word") == "")
    top = counts.where(in_head).toArrow().sort_by("word")
    tail = counts.where(~in_head).groupBy(spelling(F.col("word")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).toPandas()
    tokens, distinct, discount = np.zeros(CLASSES), np.zeros(CLASSES), np.full(CLASSES, 0.5)
    tokens[tail["k"]], distinct[tail["k"]] = tail["n"], tail["v"]
    discount[tail["k"]] = np.clip(tail["n1"] / np.maximum(tail["n1"] + 2 * tail["n2"], 1), 0.1, 0.9)
    words = top.column("word").combine_chunks().cast(pa.string())
    return Vocabulary(words, top.column("c").to_numpy().astype(np.int64), tokens, distinct, discount, least, int(levels["n"].sum()), int(levels["v"].sum()))


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, held_out, h, row, n_head (tokens of the head), head_log10 (sum of log10(c + 1) over them), seq (symbols), tail (words outside the head)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        v, row = shared.value, TaskContext.get().partitionId() << 40
        logs = np.log10(v.counts + 1.0)
        end = pc.index_in(pa.scalar(""), value_set=v.words).as_py()
        end = len(v.counts) + _spelling(b"") if end is None else end
        for b in T.slices(batches):
            flat, count = T.words(b.column("text"))
            code, distinct = T.codes(flat)
            at = pc.fill_null(pc.index_in(distinct.cast(pa.string()), value_set=v.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            rest = np.flatnonzero(at < 0)
            known = at >= 0
            at[rest] = [len(v.counts) + _spelling(w) for w in distinct.take(pa.array(rest)).cast(pa.binary()).to_pylist()]
            symbol, in_head = at[code], known[code]
            value = np.where(in_head, np.append(logs, 0.0)[np.where(in_head, symbol, -1)], 0.0)
            tails = flat.filter(pa.array(~in_head))
            n_tail = T.sums((~in_head).astype(np.int64), count)
            seq = np.insert(symbol, np.cumsum(count), end)
            offsets = lambda n: pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            ended = end < len(v.counts)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("held_out"), b.column("h"), pa.array(row + np.arange(b.num_rows)), pa.array(count - n_tail + ended),
                pa.array(T.sums(value, count) + (logs[end] if ended else 0.0)),
                pa.ListArray.from_arrays(offsets(count + 1), pa.array(seq.astype(np.int32))), pa.ListArray.from_arrays(offsets(n_tail), tails.cast(pa.string())),
            ], ["doc_id", "held_out", "h", "row", "n_head", "head_log10", "seq", "tail"])
            row += b.num_rows

    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, h long, row long, n_head long, head_log10 double, seq array<int>, tail array<string>")


@dataclass(frozen=True)
class Hmm:
    """start: by state; move: state x state; emit: symbol x state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _ragged(lists: pa.Array):
    """(first row, values, lengths) of slices of the lists with about TOKENS values; a longer list stands alone."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // TOKENS)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(size)], strict=True):
        if b > a:
            yield a, lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False), size[a:b]


class _Windows:
    """The windows of sequences (obs holds one after the other, n their lengths), by length from the longest on.

    doc, nth, begin, length by window; entry: the state weights at the token before a later window; exit: the backward weights at its
    last token; log: the natural log-likelihood of each sequence.
    """

    def __init__(self, model: Hmm, obs: np.ndarray, n: np.ndarray, window: int = WINDOW):
        self.model, self.obs, self.docs = model, obs, len(n)
        cuts = (n + window - 1) // window
        doc = np.repeat(np.arange(len(n)), cuts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        length = np.minimum(n[doc] - nth * window, window)
        order = np.argsort(-length, kind="stable")
        self.doc, self.nth, self.length = doc[order], nth[order], length[order]
        self.begin = (np.cumsum(n) - n)[self.doc] + self.nth * window
        states = len(model.start)
        self.entry, self.exit = np.zeros((len(doc), states)), np.ones((len(doc), states))
        self.log = np.zeros(len(n))

    def groups(self, of: np.ndarray):
        """Groups of GROUP of these windows: (indices, how many of them reach each token, where each token's row starts, places in obs)."""
        for g in range(0, len(of), GROUP):
            own = of[g : g + GROUP]
            steps = int(self.length[own[0]])
            active = np.searchsorted(-self.length[own], -np.arange(steps))
            at = np.cumsum(active) - active
            place = np.arange(active.sum()) - np.repeat(at, active)
            yield own, active.tolist(), at.tolist(), place, self.begin[own][place] + np.repeat(np.arange(steps), active)

    def run(self, backward: bool) -> None:
        """Fills log and entry, and with `backward` exit. Arrays are by state first; values are scaled every SCALED tokens."""
        model, states = self.model, len(self.model.start)
        turned = np.ascontiguousarray(model.move.T)
        first, later = np.flatnonzero(self.nth == 0), np.flatnonzero(self.nth > 0)
        last = np.zeros((self.docs, states))
        for own, active, at, _, tokens in self.groups(first):
            emits = np.ascontiguousarray(model.emit[self.obs[tokens]].T)
            alpha, log, a = np.repeat(model.start[:, None], len(own), 1), np.zeros(len(own)), len(own)
            for t, now in enumerate(active):
                if now < a or t % SCALED == 0:
                    self._scale(alpha, log)
                    last[self.doc[own[now:a]]], self.log[self.doc[own[now:a]]] = alpha[:, now:].T, log[now:]
                    alpha, log, a = alpha[:, :now], log[:now], now
                alpha = (turned @ alpha if t else alpha) * emits[:, at[t] : at[t] + now]
            self._scale(alpha, log)
            last[self.doc[own[:a]]], self.log[self.doc[own[:a]]] = alpha.T, log
        if not len(later):
            return
        matrix, scales = np.empty((len(self.doc), states, states)), np.zeros(len(self.doc))
        for own, active, at, _, tokens in self.groups(later):
            emits = np.ascontiguousarray(model.emit[self.obs[tokens]].T)
            # by state reached, then by state at the entry
            m, log, a = np.repeat(np.eye(states)[:, :, None], len(own), 2), np.zeros(len(own)), len(own)
            for t, now in enumerate(active):
                if now < a or t % SCALED == 0:
                    self._scale(m, log)
                    matrix[own[now:a]], scales[own[now:a]] = m[:, :, now:].transpose(2, 1, 0), log[now:]
                    m, log, a = np.ascontiguousarray(m[:, :, :now]), log[:now], now
                m = (turned @ m.reshape(states, -1)).reshape(states, states, now)
                m *= emits[:, None, at[t] : at[t] + now]
            self._scale(m, log)
            matrix[own[:a]], scales[own[:a]] = m.transpose(2, 1, 0), log
        by_nth = later[np.argsort(self.nth[later], kind="stable")]
        steps = np.split(by_nth, np.flatnonzero(np.diff(self.nth[by_nth])) + 1)
        for own in steps:
            d = self.doc[own]
            self.entry[own] = last[d]
            now = np.einsum("ij,ijk->ik", last[d], matrix[own])
            scale = now.sum(1)
            last[d] = now / scale[:, None]
            self.log[d] += np.log(scale) + scales[own]
        if backward:
            behind = np.ones((self.docs, states))
            for own in reversed(steps):
                d = self.doc[own]
                self.exit[own] = behind[d]
                now = np.einsum("ijk,ik->ij", matrix[own], behind[d])
                behind[d] = now / now.sum(1, keepdims=True)
            self.exit[first] = behind[self.doc[first]]

    @staticmethod
    def _scale(x: np.ndarray, log: np.ndarray) -> None:
        """Makes the values of each window add up to 1, and adds the logarithm of what they were to its sum."""
        total = x.sum(tuple(range(x.ndim - 1)))
        x /= total
        log += np.log(total)


def log10_likelihood(model: Hmm, obs: np.ndarray, n: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of each sequence (obs holds one after the other, n their lengths), by the scaled forward recursion."""
    w = _Windows(model, obs, n, window)
    w.run(False)
    return w.log / math.log(10)


def expected(model: Hmm, obs: np.ndarray, n: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Expected starts, moves and emissions (symbol x state) of whole sequences, and their log-likelihood."""
    own, start, move, emit, log = _expected(model, obs, n, window)
    full = np.zeros(model.emit.shape)
    full[own] = emit
    return [start, move, full, log]


def _expected(model: Hmm, obs: np.ndarray, n: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """The same with emissions of the sequences' own symbols alone, which come first."""
    states, own_symbols, obs = len(model.start), *_own(obs, len(model.emit))
    model = Hmm(model.start, model.move, model.emit[own_symbols])
    start, moves, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, len(own_symbols)))
    turned = np.ascontiguousarray(model.move.T)
    w = _Windows(model, obs, n, window)
    w.run(True)
    for own, active, at, place, tokens in w.groups(np.arange(len(w.doc))):
        head, entry, symbol = w.nth[own] == 0, w.entry[own].T, obs[tokens]
        emits = np.ascontiguousarray(model.emit[symbol].T)
        alphas, scales = np.empty_like(emits), np.empty(len(symbol))
        alpha = np.where(head, model.start[:, None], turned @ entry)
        for t, a in enumerate(active):
            here = slice(at[t], at[t] + a)
            alpha = (turned @ alpha[:, :a] if t else alpha) * emits[:, here]
            scales[here] = scale = alpha.sum(0)
            alpha /= scale
            alphas[:, here] = alpha
        ended = alphas[:, np.array(at)[w.length[own] - 1] + np.arange(len(own))]
        beta = w.exit[own].T.copy()
        beta /= (ended * beta).sum(0)
        emits /= scales
        for t in range(len(active) - 1, -1, -1):
            a, here = active[t], slice(at[t], at[t] + active[t])
            back = emits[:, here] * beta[:, :a]
            if t:
                moves += alphas[:, at[t - 1] : at[t - 1] + a] @ back.T
            else:
                moves += entry[:, ~head] @ back[:, ~head].T
            alphas[:, here] *= beta[:, :a]  # from here on the weights of the states
            beta[:, :a] = model.move @ back
        start += alphas[:, : active[0]][:, head].sum(1)
        for s in range(states):
            emit[s] += np.bincount(symbol, alphas[s], len(own_symbols))
    return own_symbols, start, moves * model.move, emit.T, np.array([w.log.sum()])


def _own(obs: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct symbols in order, and each symbol's place among them."""
    there = np.zeros(symbols, bool)
    there[obs] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[obs]


def _bags(obs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Square roots of the shares of BUCKETS groups of symbols in each sequence."""
    bucket = (T.mix(obs.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(n)), n) * BUCKETS + bucket, minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS)
    return np.sqrt(counts / np.maximum(n, 1)[:, None])


def _centres(bags: np.ndarray, states: int) -> np.ndarray:
    """Each next one farthest from those before, then moved to the mean of what is near."""
    near = lambda x, y: np.round(x @ y.T, 9)
    chosen = [0]
    for _ in range(states - 1):
        chosen.append(int(near(bags, bags[chosen]).max(1).argmin()))
    centre = bags[chosen]
    for _ in range(8):
        own = near(bags, centre).argmax(1)
        centre = np.stack([bags[own == s].sum(0) if (own == s).any() else centre[s] for s in range(states)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return centre


def _summed(rows: DataFrame, each, symbols: int, states: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, values by state) of what `each` gives for slices (obs, n): symbols, their counts by state, and more rows with symbols below 0.

    Tasks are merged to a few for each core before, as each of them sends a row for every symbol that it has seen.
    """
    names = [f"s{s}" for s in range(states)]

    def run(batches):
        emit, rest = np.zeros((symbols, states)), None
        for b in batches:
            for _, obs, n in _ragged(b.column("seq")):
                own, now, *more = each(obs, n)
                emit[own] += now
                rest = more if rest is None else [x + y for x, y in zip(rest, more, strict=True)]
        if rest is not None:
            used = np.flatnonzero(emit.any(1))
            below = np.concatenate([np.atleast_2d(x) if x.shape[-1] == states else np.full((1, states), x[0] / states) for x in rest]) if rest else np.zeros((0, states))
            symbol, values = np.concatenate([used, -1 - np.arange(len(below))]), np.concatenate([emit[used], below])
            yield pa.RecordBatch.from_arrays([pa.array(symbol.astype(np.int32)), *(pa.array(values[:, s]) for s in range(states))], ["symbol", *names])

    some = rows.select("seq").coalesce(3 * rows.sparkSession.sparkContext.defaultParallelism)
    sums = some.mapInArrow(run, "symbol int, " + ", ".join(f"{x} double" for x in names))
    got = sums.groupBy("symbol").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    values = np.stack([got.column(x).to_numpy() for x in names], axis=1) if got.num_rows else np.zeros((0, states))
    return got.column("symbol").to_numpy(), values


def start_model(rows: DataFrame, vocab: Vocabulary, states: int = STATES, seeds: int = SEEDS, prior: float = 500.0) -> Hmm:
    """States that emit what the texts nearest to a centre hold; the prior adds so many tokens with the corpus's shares to each."""
    emit = prior * np.repeat(vocab.shares()[:, None], states, axis=1)

    def bag(batches):
        for b in batches:
            for a, obs, n in _ragged(b.column("seq")):
                x = _bags(obs, n)
                yield pa.RecordBatch.from_arrays([b.column("h").slice(a, len(n)), pa.array(list(x), pa.list_(pa.float64()))], ["h", "bag"])

    last = rows.select("h").distinct().orderBy("h").limit(seeds).agg(F.max("h")).first()[0]
    if last is not None:
        # rows with equal hashes are equal, so that there are at most `seeds` bags
        bags = rows.where(F.col("h") <= last).select("h", "seq").mapInArrow(bag, "h long, bag array<double>").groupBy("h").agg(F.first("bag").alias("bag")).toArrow().sort_by("h")
        shared = rows.sparkSession.sparkContext.broadcast(_centres(np.stack(bags.column("bag").to_numpy()), states))

        def each(obs, n):
            own = np.round(_bags(obs, n) @ shared.value.T, 9).argmax(1)
            of, code = _own(obs, len(emit))
            return of, np.bincount(code * states + np.repeat(own, n), minlength=len(of) * states).reshape(-1, states).astype(float)

        symbol, values = _summed(rows, each, len(emit), states)
        emit[symbol] += values
    return Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(0))


def baum_welch(rows: DataFrame, vocab: Vocabulary, model: Hmm, rounds: int = ROUNDS, settled: float = SETTLED, prior: float = 5.0) -> Hmm:
    """Counts of each round are summed over all rows; the prior adds so many tokens with the corpus's shares to each state."""
    states, before = len(model.start), None
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def each(obs, n, shared=shared):
            own, start, move, emit, log = _expected(shared.value, obs, n)
            return own, emit, move, start, log

        symbol, values = _summed(rows, each, vocab.symbols, states)
        emit = prior * np.repeat(vocab.shares()[:, None], states, axis=1)
        emit[symbol[symbol >= 0]] += values[symbol >= 0]
        more = np.zeros((states + 2, states))
        more[-1 - symbol[symbol < 0]] = values[symbol < 0]
        move, start, now = 1.0 + more[:states], 1.0 + more[states], more[states + 1].sum()
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        if before is not None and now - before <= settled * abs(before):
            break
        before = now
    return model


def _array(values: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def tail_scores(rows: DataFrame, counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """row, n_tail, n_tail_known, tail_log10 (sum of log10(c + 1)), tail_score (sum of log10 of the words' shares of their classes)."""
    outside = counts.where((_level(F.col("c")) < vocab.least) & (F.col("word") != ""))
    some = np.maximum(vocab.tokens, 1)
    unknown = np.where(vocab.tokens > 0, np.log10(np.maximum(vocab.discount * vocab.distinct, 1e-300) / some), 0.0)
    k = spelling(F.col("word")) + 1
    share = F.log10((F.col("c") - F.element_at(_array(vocab.discount), k)) / F.element_at(_array(some), k))
    words = rows.where(F.size("tail") > 0).select("row", F.explode("tail").alias("word")).join(outside, "word", "left")
    value = words.select("row", F.col("c").isNotNull().cast("long").alias("known"), F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)).alias("l"), F.coalesce(share, F.element_at(_array(unknown), k)).alias("p"))
    return value.groupBy("row").agg(F.count("*").alias("n_tail"), F.sum("known").alias("n_tail_known"), F.sum("l").alias("tail_log10"), F.sum("p").alias("tail_score"))


def forward(rows: DataFrame, model: Hmm) -> DataFrame:
    """doc_id, held_out, row, n_seq, n_head, head_log10, forward_log10 of the whole symbol sequence."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "row", "n_head", "head_log10"]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", n_seq long, forward_log10 double"

    def run(batches):
        for b in batches:
            for a, obs, n in _ragged(b.column("seq")):
                some = [b.column(c).slice(a, len(n)) for c in names]
                yield pa.RecordBatch.from_arrays([*some, pa.array(n), pa.array(log10_likelihood(shared.value, obs, n))], [*names, "n_seq", "forward_log10"])

    return rows.select(*names, "seq").mapInArrow(run, schema)


def score(docs: DataFrame, folds: int = 7, held: int = 2, head: int = HEAD, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(True)).alias("held_out"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h"), F.col("text").alias("text"))
    counts = keep(word_counts(rows.where(~F.col("held_out")).select("text")))
    vocab = vocabulary(counts, head)
    encoded = keep(encode(rows, vocab))
    train = encoded.where(~F.col("held_out"))
    model = baum_welch(train, vocab, start_model(train, vocab, states), rounds)
    out = forward(encoded, model).join(tail_scores(encoded, counts, vocab), "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = math.log10(vocab.n + vocab.v + 1)
    return out.select(
        "doc_id", "held_out", F.col("n_seq").alias("n_tokens"), (F.col("n_head") + zero("n_tail_known")).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("head_log10") + zero("tail_log10") - F.col("n_seq") * each).alias("base_score"), (F.col("forward_log10") + zero("tail_score")).alias("score"),
    )
