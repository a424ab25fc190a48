"""Kernels on whole chips (small images), for use in applyInPandas or Arrow functions: resampling, rotation, morphology, contours."""

from __future__ import annotations

import numpy as np


def sample(chip: np.ndarray, y: np.ndarray, x: np.ndarray, method: str = "nearest") -> np.ndarray:
    """Values at fractional places (cell centres are whole numbers); outside is NaN, and NaN spreads to what it takes part in."""
    h, w = chip.shape
    inside = (y >= -0.5) & (y <= h - 0.5) & (x >= -0.5) & (x <= w - 0.5)
    if method == "nearest":
        out = chip[np.clip(np.rint(y), 0, h - 1).astype(int), np.clip(np.rint(x), 0, w - 1).astype(int)].astype(float)
    else:
        reach = {"bilinear": 1, "cubic": 2}.get(method)
        if reach is None:
            raise ValueError(f"unknown resampling {method!r}")
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        out = np.zeros(np.broadcast(y, x).shape)
        for j in range(1 - reach, reach + 1):
            wy = _weight(y - (y0 + j), method)
            for i in range(1 - reach, reach + 1):
                v = chip[np.clip(y0 + j, 0, h - 1), np.clip(x0 + i, 0, w - 1)]
                weight = wy * _weight(x - (x0 + i), method)
                out = out + np.where(weight == 0, 0.0, weight * v)
    return np.where(inside, out, np.nan)


def _weight(d: np.ndarray, method: str) -> np.ndarray:
    """Triangle, or Catmull-Rom's cubic."""
    d = np.abs(d)
    if method == "bilinear":
        return np.maximum(0.0, 1 - d)
    return np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0.0))


def resize(chip: np.ndarray, height: int, width: int, method: str = "bilinear") -> np.ndarray:
    h, w = chip.shape
    y = (np.arange(height) + 0.5) * h / height - 0.5
    x = (np.arange(width) + 0.5) * w / width - 0.5
    return sample(chip, y[:, None], x[None, :], method)


def rotate(chip: np.ndarray, degrees: float, method: str = "nearest", pivot: tuple[float, float] | None = None) -> np.ndarray:
    """The chip turned anticlockwise (rows grow downwards) about a pivot (row, column), its middle if none."""
    h, w = chip.shape
    cy, cx = pivot or ((h - 1) / 2, (w - 1) / 2)
    t = np.radians(degrees)
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    dy, dx = yy - cy, xx - cx
    return sample(chip, cy + dx * np.sin(t) + dy * np.cos(t), cx + dx * np.cos(t) - dy * np.sin(t), method)


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    """Binary opening by a square; an even one grows back to where it came from."""

    def shrink(m: np.ndarray, grow: bool) -> np.ndarray:
        before, after = (size - 1) // 2, size // 2
        p = np.pad(m, (before, after) if not grow else (after, before), constant_values=not grow)
        view = np.lib.stride_tricks.sliding_window_view(p, (size, size))
        return view.any((2, 3)) if grow else view.all((2, 3))

    return shrink(shrink(mask.astype(bool), False), True)


def without_small(mask: np.ndarray, least: int) -> np.ndarray:
    """Objects (joined over edges) of at least so many cells."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:  # each cell takes the least label around it, and then that label's own
        p = np.pad(label, 1)
        near = np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        low = np.where(near == 0, h * w + 1, near).min(0)
        low = np.where(mask, low, 0)
        low = np.where(mask, label.ravel()[np.maximum(low, 1) - 1].reshape(h, w).clip(max=low), 0)
        if np.array_equal(low, label):
            break
        label = low
    n = np.bincount(label.ravel())
    return mask & (n[label] >= least)


def window_std(chip: np.ndarray, size: int = 3) -> np.ndarray:
    """Deviation in a moving window, edges mirrored, NaN cells replaced by the chip's mean."""
    x = np.where(np.isnan(chip), np.nanmean(chip) if not np.isnan(chip).all() else 0.0, chip)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(x, size // 2, mode="symmetric"), (size, size))
    return view.std((2, 3))


def contours(chip: np.ndarray, level: float) -> list[np.ndarray]:
    """Lines (row, column) where a chip crosses a level, between cell centres, by marching squares; cells beside NaN have none."""
    h, w = chip.shape
    edges: dict[tuple, list[tuple]] = {}
    place: dict[tuple, tuple[float, float]] = {}

    def cut(a: tuple[int, int], b: tuple[int, int]) -> tuple:
        va, vb = chip[a], chip[b]
        t = (level - va) / (vb - va)
        key = (a, b)
        place[key] = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
        return key

    for i in range(h - 1):
        for j in range(w - 1):
            corners = [(i, j), (i, j + 1), (i + 1, j + 1), (i + 1, j)]
            v = [chip[c] for c in corners]
            if np.isnan(v).any():
                continue
            up = [x > level for x in v]
            sides = [((i, j), (i, j + 1)), ((i, j + 1), (i + 1, j + 1)), ((i + 1, j), (i + 1, j + 1)), ((i, j), (i + 1, j))]
            hit = [k for k, (p, q) in enumerate(((0, 1), (1, 2), (3, 2), (0, 3))) if up[p] != up[q]]
            if len(hit) == 4:  # a saddle goes by the mean
                hit = [0, 1, 2, 3] if (np.mean(v) > level) == up[0] else [0, 3, 1, 2]
            for a, b in zip(hit[::2], hit[1::2]):
                ka, kb = cut(*sides[a]), cut(*sides[b])
                edges.setdefault(ka, []).append(kb)
                edges.setdefault(kb, []).append(ka)
    out, seen = [], set()
    for start in sorted(edges, key=lambda k: (len(edges[k]) != 1, k)):
        if start in seen:
            continue
        line, now = [start], start
        seen.add(start)
        while nxt := [k for k in edges[now] if k not in seen]:
            now = nxt[0]
            seen.add(now)
            line.append(now)
        if len(line) > 2 and start in edges[now]:
            line.append(start)
        out.append(np.array([place[k] for k in line]))
    return out
