"""Feature blocks of one image: small NumPy functions that tasks call, and the table that says which run and where they stand."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np

from tesserae.operators.pixels import ANGLES, offset


@dataclass(frozen=True)
class Sample:
    """uint8 arrays of one size: rgb, gray, hsv (hue 0-179) and lab."""

    rgb: np.ndarray
    gray: np.ndarray
    hsv: np.ndarray
    lab: np.ndarray


@dataclass(frozen=True)
class Block:
    """A named extractor with its settings; `size` is the length of its vector."""

    name: str
    extract: Callable[..., np.ndarray]
    settings: dict = field(default_factory=dict)
    size: int = 0
    enabled: bool = True


def resized(img: np.ndarray, side: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = img.shape[:2]
    if (h, w) == (side, side):
        return img
    at = lambda n: np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
    r, c = at(h), at(w)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    r1, c1, fr, fc = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1), (r - r0)[:, None, None], (c - c0)[None, :, None]
    x = img.astype(float)
    top, low = x[r0][:, c0] * (1 - fc) + x[r0][:, c1] * fc, x[r1][:, c0] * (1 - fc) + x[r1][:, c1] * fc
    return np.clip(np.rint(top * (1 - fr) + low * fr), 0, 255).astype(np.uint8)


@lru_cache(maxsize=1)
def _lines() -> np.ndarray:
    """Of each byte its share of light."""
    x = np.arange(256) / 255
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)


def sample(img: np.ndarray, side: int = 256) -> Sample:
    """From any (height, width, 3 or 4) array: clipped to bytes, alpha dropped, resized, converted."""
    img = np.clip(img, 0, 255).astype(np.uint8)
    if img.ndim != 3 or img.shape[2] not in (3, 4):
        raise ValueError(f"an image has three or four channels, not shape {img.shape}")
    rgb = resized(img[:, :, :3], side)
    x = rgb.astype(float)
    gray = np.rint(x @ [0.299, 0.587, 0.114]).astype(np.uint8)
    r, g, b = np.moveaxis(x, 2, 0)
    v, low = x.max(2), x.min(2)
    d = np.where(v > low, v - low, 1)
    hue = np.where(v == r, (g - b) / d, np.where(v == g, 2 + (b - r) / d, 4 + (r - g) / d)) * 60 % 360
    hsv = np.stack([np.rint(np.where(v > low, hue, 0) / 2) % 180, np.rint(255 * (v - low) / np.maximum(v, 1)), v], 2).astype(np.uint8)
    xyz = _lines()[rgb] @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / [0.950456, 1.0, 1.088754]
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    lab = np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], 2)
    return Sample(rgb, gray, hsv, np.clip(np.rint(lab), 0, 255).astype(np.uint8))


def share(hist: np.ndarray) -> np.ndarray:
    total = hist.sum()
    return hist / total if total > 0 else np.zeros(len(hist))


def _hist(x: np.ndarray, bins: int, low: float, high: float) -> np.ndarray:
    if x.dtype == np.uint8 and (low, high) == (0, 256) and 256 % bins == 0:
        return share(np.bincount(x.ravel(), minlength=256).reshape(bins, -1).sum(1))
    return share(np.histogram(x, bins=bins, range=(low, high))[0])


def glcm(s: Sample, levels=8, distances=(1, 2), angles=ANGLES, properties=("contrast", "homogeneity", "energy")) -> np.ndarray:
    q = np.minimum(s.gray.astype(int) * levels // 256, levels - 1)
    h, w = q.shape
    i, j = np.indices((levels, levels))
    out = {p: [] for p in properties}
    for d in distances:
        for a in angles:
            dr, dc = offset(d, a)
            one, two = q[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)], q[max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)]
            p = np.bincount((one * levels + two).ravel(), minlength=levels * levels).reshape(levels, levels).astype(float)
            p = p + p.T
            p /= max(p.sum(), 1)
            mean = (p * i).sum()
            var = (p * (i - mean) ** 2).sum()
            value = {"contrast": (p * (i - j) ** 2).sum(), "dissimilarity": (p * abs(i - j)).sum(), "homogeneity": (p / (1 + (i - j) ** 2)).sum(), "energy": np.sqrt((p * p).sum()), "correlation": (p * (i - mean) * (j - mean)).sum() / var if var > 1e-15 else 1.0}
            for name in properties:
                out[name].append(value[name])
    return np.concatenate([out[p] for p in properties])


def patterns(gray: np.ndarray, radius: int, points: int = 8) -> np.ndarray:
    """Uniform local binary patterns: bilinear samples on a circle, 0 outside."""
    g = np.pad(gray.astype(float), radius + 1)
    h, w = gray.shape
    own, b, part = gray.astype(float), np.empty((points, h, w), bool), np.empty((h, w))
    for k in range(points):
        dr, dc = round(-radius * np.sin(2 * np.pi * k / points), 5), round(radius * np.cos(2 * np.pi * k / points), 5)
        r0, c0 = int(np.floor(dr)), int(np.floor(dc))
        fr, fc = dr - r0, dc - c0
        value = np.zeros((h, w))
        for a, c, wt in ((0, 0, (1 - fr) * (1 - fc)), (0, 1, (1 - fr) * fc), (1, 0, fr * (1 - fc)), (1, 1, fr * fc)):
            if wt:
                value += np.multiply(g[radius + 1 + r0 + a : radius + 1 + r0 + a + h, radius + 1 + c0 + c : radius + 1 + c0 + c + w], wt, out=part)
        value += 1e-9
        np.greater_equal(value, own, out=b[k])
    ones = lambda x: x.view(np.uint8).sum(0, dtype=np.uint8 if points < 256 else np.int64)
    return np.where(ones(b != np.roll(b, -1, 0)) <= 2, ones(b), points + 1)


def lbp(s: Sample, radii=(1, 2, 3), points=8, bins=59) -> np.ndarray:
    # codes are whole numbers from 0 on, each a bin of its own, the last edge with the last one
    found = (np.bincount(patterns(s.gray, r, points).ravel(), minlength=bins + 1) for r in radii)
    return np.concatenate([share(np.append(n[: bins - 1], n[bins - 1] + n[bins])) for n in found])


@lru_cache(maxsize=64)
def _fast(n: int) -> int:
    """The least number from n on without prime factors above 5: transforms of such lengths are fast."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


@lru_cache(maxsize=8)
def _gabor_bank(shape: tuple[int, int], orientations: int, sigmas: tuple, lambdas: tuple, gamma: float, psi: float, ksize: int) -> np.ndarray:
    """The kernels' transforms for images of a shape, sigma first, then lambda, then angle."""
    half = ksize // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    out = []
    for sigma in sigmas:
        for lam in lambdas:
            for theta in np.arange(orientations) * np.pi / orientations:
                u, v = x * np.cos(theta) + y * np.sin(theta), -x * np.sin(theta) + y * np.cos(theta)
                kernel = np.exp(-0.5 * (u * u + gamma**2 * v * v) / sigma**2) * np.cos(2 * np.pi * u / lam + psi)
                out.append(np.fft.rfft2(kernel[::-1, ::-1], shape))  # turned, so that the product is a correlation
    return np.array(out)


def gabor(s: Sample, orientations=4, sigmas=(2.0, 4.0), lambdas=(6.0, 10.0), gamma=0.5, psi=0.0, ksize=31) -> np.ndarray:
    """Mean and deviation of the responses; correlation by FFT over the mirrored image, in a square with zeros that is fast to transform."""
    g = np.pad(s.gray.astype(float), ksize // 2, mode="reflect")
    shape = tuple(_fast(n) for n in g.shape)
    bank = _gabor_bank(shape, orientations, tuple(sigmas), tuple(lambdas), gamma, psi, ksize)
    seen, out = np.fft.rfft2(g, shape), []
    for k in range(0, len(bank), 4):  # few filters at a time stay in the cache
        rows = np.fft.ifft(seen * bank[k : k + 4], axis=1)[:, ksize - 1 : g.shape[0]]
        full = np.fft.irfft(rows, shape[1], axis=2)[:, :, ksize - 1 : g.shape[1]]
        out.append(np.stack([full.mean((1, 2)), full.std((1, 2))], 1))
    return np.concatenate(out).ravel()


def color_moments(s: Sample, space="hsv", channels=(0, 1, 2), eps=None) -> np.ndarray:
    out = []
    for c in channels:
        x = getattr(s, space)[:, :, c].astype(float).ravel()
        m, sd = x.mean(), x.std()
        out += [m, sd, 0.0 if sd <= 1e-6 else (((x - m) / sd) ** 3).mean()]
    return np.array(out)


def color_hist(s: Sample, space="hsv", bins=16, channels=(0, 1, 2)) -> np.ndarray:
    return np.concatenate([_hist(getattr(s, space)[:, :, c], bins, 0, 256) for c in channels])


def sobel(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.pad(gray.astype(float), 1, mode="reflect")
    row, col = g[:-2] + 2 * g[1:-1] + g[2:], g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    return row[:, 2:] - row[:, :-2], col[2:] - col[:-2]


def gradient_hist(s: Sample, bins=32) -> np.ndarray:
    return _hist(np.hypot(*sobel(s.gray)), bins, 0, 255)


def specular(s: Sample, threshold=240.0, channel="v") -> np.ndarray:
    x = {"v": s.hsv[:, :, 2], "gray": s.gray}.get(channel, s.rgb[:, :, 0])
    return np.array([(x >= threshold).mean()])


def dct_bands(s: Sample, fractions=(0.15, 0.40)) -> np.ndarray:
    n, m = s.gray.shape
    table = lambda k: np.sqrt(np.where(np.arange(k) == 0, 1, 2) / k)[:, None] * np.cos(np.pi * (2 * np.arange(k) + 1) * np.arange(k)[:, None] / (2 * k))
    e = (table(n) @ (s.gray / 255.0) @ table(m).T) ** 2
    a, b = (int(min(n, m) * f) for f in fractions)
    out = np.array([e[:a, :a].sum(), e[a:b, a:b].sum(), e[b:, b:].sum()])
    return out / max(out.sum(), 1e-12)


def fft_bands(s: Sample, fractions=(0.15, 0.40)) -> np.ndarray:
    e = np.fft.fftshift(np.abs(np.fft.fft2(s.gray / 255.0)) ** 2)
    y, x = np.indices(e.shape)
    r = np.hypot(y - e.shape[0] // 2, x - e.shape[1] // 2)
    r = r / (r.max() or 1)
    out = np.array([e[r <= fractions[0]].sum(), e[(r > fractions[0]) & (r <= fractions[1])].sum(), e[r > fractions[1]].sum()])
    return out / max(out.sum(), 1e-12)


def joint_hist(s: Sample, bins=8) -> np.ndarray:
    """Hue, saturation and value together, of length 1."""
    h = np.histogramdd(s.hsv.reshape(-1, 3), bins=(bins,) * 3, range=((0, 180), (0, 256), (0, 256)))[0].ravel()
    return h / max(np.linalg.norm(h), 1e-12)


# Blocks, their settings and their order, which is the layout of a vector.
REGISTRY = (
    Block("glcm", glcm, {}, 24),
    Block("lbp_multi_radius", lbp, {}, 177),
    Block("gabor", gabor, {}, 32),
    Block("color_moments_hsv", color_moments, {"space": "hsv"}, 9),
    Block("color_moments_lab", color_moments, {"space": "lab"}, 9),
    Block("color_hist_hsv", color_hist, {"space": "hsv"}, 48),
    Block("color_hist_lab", color_hist, {"space": "lab"}, 48, enabled=False),
    Block("gradient_mag_hist", gradient_hist, {}, 32),
    Block("specular_ratio", specular, {}, 1),
    Block("dct_energy_bands", dct_bands, {}, 3),
    Block("fft_energy_bands", fft_bands, {}, 3, enabled=False),
)
DEFAULT = tuple(b for b in REGISTRY if b.enabled)
#: The earlier vector, but for its edge density.
CLASSIC = (
    Block("hsv_histogram", joint_hist, {}, 512),
    Block("lbp", lbp, {"radii": (1,)}, 59),
    Block("lbp_multiscale", lbp, {}, 177),
    Block("gabor", gabor, {"sigmas": (4.0,), "lambdas": (10.0,)}, 8),
    Block("glcm", glcm, {"properties": ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")}, 40),
)


def with_settings(blocks: tuple[Block, ...] = REGISTRY, **settings: dict) -> tuple[Block, ...]:
    """Blocks that stay enabled, with settings of some changed: with_settings(glcm={"enabled": False}, fft_energy_bands={"enabled": True})."""
    unknown = set(settings) - {b.name for b in blocks}
    if unknown:
        raise ValueError(f"no such blocks: {sorted(unknown)}")
    changed = (replace(b, enabled=settings.get(b.name, {}).get("enabled", b.enabled), settings=b.settings | {k: v for k, v in settings.get(b.name, {}).items() if k != "enabled"}) for b in blocks)
    return tuple(b for b in changed if b.enabled)


def vector(img: np.ndarray, blocks: tuple[Block, ...] = DEFAULT, side: int = 256) -> np.ndarray:
    s = sample(img, side)
    parts = [np.asarray(b.extract(s, **b.settings), dtype=np.float32) for b in blocks]
    if any(p.ndim != 1 for p in parts):
        raise ValueError("a block gives one row of numbers")
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def layout(blocks: tuple[Block, ...] = DEFAULT) -> list[tuple[str, int, int]]:
    """(block, start, size), with sizes measured on a blank image, so changed settings count."""
    s, out, start = sample(np.zeros((32, 32, 3), np.uint8), 32), [], 0
    for b in blocks:
        n = len(b.extract(s, **b.settings))
        out.append((b.name, start, n))
        start += n
    return out
