"""Pixel functions on arrays, for Arrow functions over image columns."""

from __future__ import annotations

import numpy as np

# fixed values: contrast and brightness of the default preparation
CONTRAST, BRIGHTNESS = 1.8, 20


def grayscale(rgb: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)


def contrasted(gray: np.ndarray, contrast: float = CONTRAST, brightness: float = BRIGHTNESS) -> np.ndarray:
    """Saturating line through the gray values."""
    return np.clip(np.rint(gray.astype(np.float64) * contrast + brightness), 0, 255).astype(np.uint8)


def cropped(gray: np.ndarray, l: int, t: int, w: int, h: int) -> np.ndarray:  # noqa: E741
    return gray[max(t, 0) : max(t + h, 0), max(l, 0) : max(l + w, 0)]


def padded(gray: np.ndarray, width: int, height: int, fill: int = 255) -> np.ndarray:
    """Centred on a ground of at least the given size."""
    h, w = gray.shape
    out = np.full((max(height, h), max(width, w)), fill, dtype=gray.dtype)
    t, l = (out.shape[0] - h) // 2, (out.shape[1] - w) // 2  # noqa: E741
    out[t : t + h, l : l + w] = gray
    return out


def resized(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Nearest pixel."""
    h, w = gray.shape
    return gray[(np.arange(height) * h // height)[:, None], (np.arange(width) * w // width)[None, :]]


def rotated(gray: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Turned about the centre, same size, nearest pixel."""
    h, w = gray.shape
    a, cy, cx = np.deg2rad(degrees), (h - 1) / 2, (w - 1) / 2
    y, x = np.mgrid[0:h, 0:w]
    sx = np.rint(np.cos(a) * (x - cx) + np.sin(a) * (y - cy) + cx).astype(int)
    sy = np.rint(-np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(gray, fill)
    out[inside] = gray[sy[inside], sx[inside]]
    return out


def threshold(gray: np.ndarray) -> int:
    """The level that parts dark from light with the greatest variance between them."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(counts), counts.sum()
    mass = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below - mass * total) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def glyph_vector(gray: np.ndarray, l: int, t: int, w: int, h: int, side: int = 28) -> np.ndarray:  # noqa: E741
    """A glyph's square crop, a tenth higher than the glyph, as ``side`` x ``side`` values from 0 to 1."""
    edge = int(1.1 * max(h, 1))
    width = max(w, edge)
    part = cropped(gray, l - (width - w) // 2, t - (edge - h) // 2, width, edge)
    return resized(padded(part, max(part.shape), max(part.shape)), side, side).astype(np.float32).ravel() / 255


def blurred(gray: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square of odd ``size``, edges repeated."""
    pad = size // 2
    x = np.pad(gray.astype(np.float64), pad, mode="edge")
    for axis in (0, 1):
        total = np.cumsum(np.insert(x, 0, 0, axis=axis), axis=axis)
        n = total.shape[axis]
        x = (np.take(total, range(size, n), axis=axis) - np.take(total, range(n - size), axis=axis)) / size
    return np.rint(x).astype(np.uint8)


def dilated(dark: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each dark point grown to a box around it."""
    out = dark
    for axis, size in ((1, width), (0, height)):
        before, grown = size // 2, np.zeros_like(out)
        for d in range(-before, size - before):
            moved = np.roll(out, d, axis)
            edge = [slice(None)] * 2
            edge[axis] = slice(0, d) if d > 0 else slice(out.shape[axis] + d, None) if d < 0 else slice(0, 0)
            moved[tuple(edge)] = False
            grown |= moved
        out = grown
    return out


def labelled(dark: np.ndarray) -> np.ndarray:
    """Numbers of connected dark areas (8 neighbours), from 1; by runs of rows and union of those that touch."""
    parent = [0]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = np.zeros(dark.shape, dtype=np.int64)
    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(dark):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))).reshape(-1, 2)
        runs = []
        for a, b in edges:
            name = len(parent)
            parent.append(name)
            for c, d, n in above:
                if c <= b and a <= d:
                    x, z = root(n), root(name)
                    parent[max(x, z)] = min(x, z)
            out[y, a:b] = name
            runs.append((a, b, name))
        above = runs
    names = np.array([root(i) for i in range(len(parent))])
    return np.unique(names, return_inverse=True)[1].reshape(-1)[out]


def contours(dark: np.ndarray) -> list[tuple[int, int, int, int, float, int]]:
    """Box, angle of the main axis in degrees and area of each connected dark area."""
    marks = labelled(dark)
    y, x = np.nonzero(marks)
    name = marks[y, x]
    order = np.argsort(name, kind="stable")
    y, x = y[order], x[order]
    edges = np.flatnonzero(np.diff(name[order], prepend=-1, append=-1))
    found = []
    for a, b in zip(edges, edges[1:]):
        px, py = x[a:b], y[a:b]
        dx, dy = px - px.mean(), py - py.mean()
        angle = 0.5 * np.degrees(np.arctan2(2 * (dx * dy).mean(), (dx * dx).mean() - (dy * dy).mean()))
        found.append((int(px.min()), int(py.min()), int(np.ptp(px)) + 1, int(np.ptp(py)) + 1, float(angle), int(b - a)))
    return found
