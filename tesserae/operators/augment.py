"""Augmented samples: each gets one transform, chosen and set by a hash of seed, source and slot.

Transforms work on one image in a task. Those that bend space by random fields (elastic, grid and optical distortion, perspective)
are one bilinear lookup with different displacements.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

# Transforms that production uses, and groups.
PRODUCTION = ("color_jitter", "elastic", "gauss_noise", "gaussian_blur", "grid_distortion", "hflip", "hsv", "iso_noise", "motion_blur")
GROUPS = {
    "geometric": ("rotate_15", "hflip", "vflip", "perspective", "elastic", "grid_distortion"),
    "color": ("brightness_contrast", "color_jitter", "hsv", "rgb_shift", "clahe"),
    "blur_noise": ("gaussian_blur", "motion_blur", "gauss_noise", "iso_noise"),
    "advanced": ("coarse_dropout", "optical_distortion"),
}
KEYS = tuple(sorted(k for ks in GROUPS.values() for k in ks))
LIGHT, STRONG = ("rotate_15", "hflip", "brightness_contrast", "gaussian_blur"), ("rotate_15", "hflip", "vflip", "perspective", "elastic", "brightness_contrast", "color_jitter", "gaussian_blur", "gauss_noise", "coarse_dropout")


def chosen(keys: Iterable[str] | None = None, groups: Iterable[str] | None = None, intensity: str = "moderate") -> tuple[str, ...]:
    """Sorted distinct keys; an allow-list goes before groups; light and strong have fixed lists."""
    if intensity in ("light", "strong"):
        return LIGHT if intensity == "light" else STRONG
    if intensity != "moderate":
        raise ValueError(f"intensity must be light, moderate or strong, not {intensity!r}")
    clean = lambda xs: sorted({x.strip() for x in xs})
    if keys is not None:
        names, allowed = clean(keys), set(KEYS)
    else:
        names, allowed = clean(groups if groups is not None else GROUPS), set(GROUPS)
    wrong = [x for x in names if x not in allowed]
    if wrong or not names:
        raise ValueError(f"not among {sorted(allowed)}: {wrong}")
    return tuple(names) if keys is not None else tuple(sorted(k for g in names for k in GROUPS[g]))


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def _lookup(img: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Bilinear at (r, c); beyond the edge the edge repeats."""
    h, w = img.shape[:2]
    r, c = np.clip(r, 0, h - 1), np.clip(c, 0, w - 1)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    r1, c1, fr, fc = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1), (r - r0)[..., None], (c - c0)[..., None]
    x = img.astype(float)
    return _bytes((x[r0, c0] * (1 - fc) + x[r0, c1] * fc) * (1 - fr) + (x[r1, c0] * (1 - fc) + x[r1, c1] * fc) * fr)


def _smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-int(3 * sigma + 1), int(3 * sigma + 1) + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(len(k) // 2,) * 2 if a == axis else (0, 0) for a in range(x.ndim)]
        p = np.pad(x, pad, mode="edge")
        x = sum(w * np.take(p, range(i, i + x.shape[axis]), axis) for i, w in enumerate(k))
    return x


def _bent(kind: str):
    def run(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        h, w = img.shape[:2]
        r, c = np.mgrid[:h, :w].astype(float)
        if kind == "rotate_15":
            a = np.deg2rad(rng.uniform(-15, 15))
            y, x = r - h // 2, c - w // 2
            return _lookup(img, h // 2 + y * np.cos(a) + x * np.sin(a), w // 2 + x * np.cos(a) - y * np.sin(a))
        if kind == "elastic":
            return _lookup(img, *(g + 50 * _smooth(rng.uniform(-1, 1, (h, w)), 5.0) for g in (r, c)))
        if kind == "grid_distortion":
            bend = lambda n: np.interp(np.arange(n), np.linspace(0, n - 1, 6), np.append(0, np.cumsum(np.diff(np.linspace(0, n - 1, 6)) * (1 + rng.uniform(-0.2, 0.2, 5)))))
            return _lookup(img, *np.meshgrid(bend(h), bend(w), indexing="ij"))
        if kind == "optical_distortion":
            k, (dy, dx) = rng.uniform(-0.1, 0.1), rng.uniform(-0.05, 0.05, 2)
            y, x = (r - h / 2) / h, (c - w / 2) / w
            f = 1 + k * (x * x + y * y)
            return _lookup(img, h / 2 + y * f * h + dy * h, w / 2 + x * f * w + dx * w)
        corner = rng.uniform(0, rng.uniform(0.05, 0.1), (2, 2, 2)) * np.array([[[1, 1], [1, -1]], [[-1, 1], [-1, -1]]])
        u, v = r / max(h - 1, 1), c / max(w - 1, 1)
        move = lambda d: corner[0, 0, d] * (1 - u) * (1 - v) + corner[0, 1, d] * (1 - u) * v + corner[1, 0, d] * u * (1 - v) + corner[1, 1, d] * u * v
        return _lookup(img, r + move(0) * h, c + move(1) * w)

    return run


def _hue(img: np.ndarray, turn: float, sat: float, val: float) -> np.ndarray:
    """Hue turned by a share of the circle, saturation times, value plus."""
    x = img.astype(float)
    gray = x @ [0.299, 0.587, 0.114]
    a = 2 * np.pi * turn
    yiq = np.array([[0.299, 0.587, 0.114], [0.595716, -0.274453, -0.321263], [0.211456, -0.522591, 0.311135]])
    spin = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    x = x @ (np.linalg.inv(yiq) @ spin @ yiq).T
    return _bytes(gray[..., None] + (x - gray[..., None]) * sat + val)


def _equalised(img: np.ndarray, rng: np.random.Generator, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of the gray value by tiles, interpolated between their centres."""
    gray = _bytes(img.astype(float) @ [0.299, 0.587, 0.114])
    h, w = gray.shape
    rows, cols = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    table = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(gray[rows[i] : max(rows[i + 1], rows[i] + 1), cols[j] : max(cols[j + 1], cols[j] + 1)].ravel(), minlength=256).astype(float)
            top = max(clip * hist.sum() / 256, 1)
            hist = np.minimum(hist, top) + np.maximum(hist - top, 0).sum() / 256
            table[i, j] = np.cumsum(hist) / max(hist.sum(), 1) * 255
    y, x = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1), (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: table[a[:, None], b[None, :], gray]
    new = (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy
    return _bytes(img.astype(float) + (new - gray)[..., None])


def _dropout(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    out = img.copy()
    for _ in range(rng.integers(1, 9)):
        h, w = rng.integers(1, 17, 2)
        r, c = rng.integers(0, img.shape[0]), rng.integers(0, img.shape[1])
        out[r : r + h, c : c + w] = 0
    return out


def _motion(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    n, across = int(rng.choice([3, 5])), bool(rng.integers(2))
    return _bytes(sum(np.roll(np.pad(img.astype(float), ((2, 2), (2, 2), (0, 0)), mode="edge"), k - n // 2, 1 if across else 0) for k in range(n))[2:-2, 2:-2] / n)


TRANSFORMS: dict[str, Callable[[np.ndarray, np.random.Generator], np.ndarray]] = {
    **{k: _bent(k) for k in ("rotate_15", "perspective", "elastic", "grid_distortion", "optical_distortion")},
    "hflip": lambda x, rng: x[:, ::-1],
    "vflip": lambda x, rng: x[::-1],
    "brightness_contrast": lambda x, rng: _bytes(x * (1 + rng.uniform(-0.2, 0.2)) + 255 * rng.uniform(-0.2, 0.2)),
    "color_jitter": lambda x, rng: _hue(_bytes(x * (1 + rng.uniform(-0.15, 0.15))), rng.uniform(-0.05, 0.05), 1 + rng.uniform(-0.15, 0.15), 0),
    "hsv": lambda x, rng: _hue(x, rng.uniform(-10, 10) / 180, 1 + rng.uniform(-20, 20) / 255, rng.uniform(-15, 15)),
    "rgb_shift": lambda x, rng: _bytes(x + rng.uniform(-15, 15, 3)),
    "clahe": _equalised,
    "gaussian_blur": lambda x, rng: _bytes(_smooth(x.astype(float), float(rng.choice([0.8, 1.1])))),
    "motion_blur": _motion,
    "gauss_noise": lambda x, rng: _bytes(x + rng.normal(0, np.sqrt(rng.uniform(10, 30)), x.shape)),
    "iso_noise": lambda x, rng: _bytes(_hue(x, rng.normal(0, rng.uniform(0.01, 0.05)), 1, 0) + rng.normal(0, 255 * 0.1 * rng.uniform(0.1, 0.3), x.shape[:2])[..., None]),
    "coarse_dropout": _dropout,
}


def rng_of(seed: int, source: str, slot: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}-{source}-{slot}".encode()).digest()[:8], "big"))


def augmented(img: np.ndarray, keys: tuple[str, ...], rng: np.random.Generator) -> np.ndarray:
    """One of the transforms, each as likely as the others."""
    return np.ascontiguousarray(TRANSFORMS[keys[int(rng.integers(len(keys)))]](img, rng))


def apply(rows: DataFrame, keys: tuple[str, ...] = PRODUCTION, seed: int = 42) -> DataFrame:
    """Rows of (path, slot, height, width, rgb, ...): those with a slot get their pixels transformed, others stay."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                pdf = batch.slice(k, 64).to_pandas()
                new = [
                    augmented(np.frombuffer(x, np.uint8).reshape(int(h), int(w), 3), keys, rng_of(seed, path, int(slot))).tobytes() if pd.notna(slot) and x is not None else x
                    for path, slot, h, w, x in zip(pdf["path"], pdf["slot"], pdf["height"], pdf["width"], pdf["rgb"], strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()) if c == "rgb" else batch.column(names.index(c)).slice(k, 64) for c in names], names)

    return rows.mapInArrow(run, rows.schema)
