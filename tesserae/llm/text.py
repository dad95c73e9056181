"""Arrow and NumPy helpers over batches of texts, as used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches, column: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each have about max_bytes at most; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // max_bytes
        cut = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of the texts in order, and how many each text has. Null counts as empty; lower: A-Z only."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, start = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    start = before[start - start[0]]
    return flat.filter(pa.array(full)), np.diff(start)


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's index among the distinct values, and those."""
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def data(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts one after the other, and n + 1 offsets. The array must have no nulls."""
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    all_bytes = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return all_bytes[at[0] : at[-1]], at - at[0]


def plain(texts: pa.Array) -> pa.Array:
    """A string array with 32-bit offsets and without nulls."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return pc.fill_null(texts.cast(pa.string()), "")


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of the values, whose lengths are counts (0: 0)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mult)
    return x ^ (x >> np.uint64(31))


def byte_table(separators: bytes) -> np.ndarray:
    """For word_hashes: 0 for a separator, else a number; A-Z count as a-z."""
    out = np.arange(1, 257, dtype=np.uint64)
    out[65:91] = out[97:123]
    out[list(separators)] = 0
    return out


_ROOT = 0xD1342543DE82EF95
_UNROOT = pow(_ROOT, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(root: int, n: int) -> np.ndarray:
    """1, root, root^2, ... modulo 2^64."""
    if root not in _powers or len(_powers[root]) < n:
        x = np.full(max(n, 1 << 20), root, np.uint64)
        x[0] = 1
        _powers[root] = np.cumprod(x, dtype=np.uint64)
    return _powers[root][:n]


def word_hashes(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (run of bytes that are no separators) of the texts, and how many words each text has.

    Prefix sums of byte * root^place give every word's polynomial at once. Keep slices near 1 MB, which the cache holds.
    """
    raw, at = data(texts)
    value = table[raw]
    word = value > 0
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    start = np.flatnonzero(word & (~np.append(False, word[:-1]) | first[:-1])) if len(raw) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (~np.append(word[1:], False) | first[1:])) + 1 if len(raw) else start
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value * _power(_ROOT, len(raw)), out=total[1:])
    h = (total[end] - total[start]) * _power(_UNROOT, len(raw))[start]
    return mix(h + mix((end - start).astype(np.uint64))), np.diff(np.searchsorted(start, at))
