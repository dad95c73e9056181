"""A rope: a balanced tree of pieces of a text, in which every node knows how many units and code points stand below it.

Ropes never change; split() and join() build O(log n) new nodes and share all others. A unit may be a code point, a word or a line.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Code points of a leaf at most.
LEAF = 4096
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(text: str) -> np.ndarray:
    at = [m.start() for m in _WORD.finditer(text)]
    return np.array([0, *at[1:]] if text else [], np.int64)


def _lines(text: str) -> np.ndarray:
    return np.array([0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))] if text else [], np.int64)


#: Where units begin; None: at every code point. White space belongs to the word before it, at the start of a text to the first word.
UNITS: dict[str, Callable[[str], np.ndarray | None]] = {"chars": lambda text: None, "words": _words, "lines": _lines}


class Rope:
    """A leaf (text, and where its units begin) or a node (left, right), with units, chars and depth below it."""

    __slots__ = ("chars", "depth", "left", "right", "starts", "text", "units")

    def __init__(self, text: str = "", starts: np.ndarray | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.starts, self.left, self.right = text, starts, left, right
        if left is None:
            self.chars, self.depth = len(text), 0
            self.units = self.chars if starts is None else len(starts)
        else:
            self.chars, self.units, self.depth = left.chars + right.chars, left.units + right.units, 1 + max(left.depth, right.depth)

    def __str__(self) -> str:
        found, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.left is None:
                found.append(x.text)
            else:
                todo += (x.right, x.left)
        return "".join(found)


def rope(text: str, units: str = "chars", leaf: int = LEAF) -> Rope:
    """A balanced rope of leaves of `leaf` code points."""
    starts = UNITS[units](text)

    def build(a: int, b: int) -> Rope:
        if b - a <= leaf:
            return Rope(text[a:b], None if starts is None else starts[slice(*np.searchsorted(starts, (a, b)))] - a)
        middle = a + ((b - a + leaf - 1) // leaf // 2) * leaf
        return Rope(left=build(a, middle), right=build(middle, b))

    return build(0, len(text))


def _rotated(a: Rope, b: Rope) -> Rope:
    """A node of two, one of which may be two levels deeper than the other."""
    if a.depth > b.depth + 1:
        if a.left.depth >= a.right.depth:
            return Rope(left=a.left, right=Rope(left=a.right, right=b))
        return Rope(left=Rope(left=a.left, right=a.right.left), right=Rope(left=a.right.right, right=b))
    if b.depth > a.depth + 1:
        if b.right.depth >= b.left.depth:
            return Rope(left=Rope(left=a, right=b.left), right=b.right)
        return Rope(left=Rope(left=a, right=b.left.left), right=Rope(left=b.left.right, right=b.right))
    return Rope(left=a, right=b)


def join(*parts: Rope) -> Rope:
    """The parts one after the other, balanced."""
    out = parts[0]
    for part in parts[1:]:
        out = _join(out, part)
    return out


def _join(a: Rope, b: Rope) -> Rope:
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.depth > b.depth + 1:
        return _rotated(a.left, _join(a.right, b))
    if b.depth > a.depth + 1:
        return _rotated(_join(a, b.left), b.right)
    return Rope(left=a, right=b)


def split(x: Rope, rank: int, by_chars: bool = False) -> tuple[Rope, Rope]:
    """What stands before the unit (or code point) of a rank, and from it on; a rank behind the last one cuts at the end."""
    if x.left is None:
        if x.starts is None:
            return Rope(x.text[:rank]), Rope(x.text[rank:])
        if by_chars:
            cut, own = rank, int(np.searchsorted(x.starts, rank))
        else:
            cut, own = (int(x.starts[rank]) if rank < len(x.starts) else x.chars), rank
        return Rope(x.text[:cut], x.starts[:own]), Rope(x.text[cut:], x.starts[own:] - cut)
    size = x.left.chars if by_chars else x.left.units
    if rank < size:
        a, b = split(x.left, rank, by_chars)
        return a, _join(b, x.right)
    a, b = split(x.right, rank - size, by_chars)
    return _join(x.left, a), b
