"""Plane geometry kernels over numpy arrays, for the search and the spatial checks.

A shape is a list of parts; a part is a list of rings (closed arrays of points: shell, then holes) for areas, or one
open array for lines.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-9


class Shape:
    """Lines or areas with their boundary segments and box."""

    def __init__(self, parts: list[list[np.ndarray]], area: bool):
        self.parts, self.area = [[np.asarray(r, float)[:, :2] for r in p] for p in parts], area
        chains = [r for p in self.parts for r in p]
        self.a = np.concatenate([r[:-1] for r in chains])
        self.b = np.concatenate([r[1:] for r in chains])
        points = np.concatenate(chains)
        self.low, self.high = points.min(0), points.max(0)

    def covers(self, p) -> bool:
        """Whether an area holds a point (boundary included up to rounding)."""
        if not self.area or (p < self.low - EPS).any() or (p > self.high + EPS).any():
            return False
        (x1, y1), (x2, y2) = self.a.T, self.b.T
        up = (y1 > p[1]) != (y2 > p[1])
        with np.errstate(divide="ignore", invalid="ignore"):
            at = x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1)
        return bool((up & (p[0] < at)).sum() % 2)

    def distance(self, p) -> float:
        """Distance of a point; 0 inside an area."""
        return 0.0 if self.covers(p) else float(point_segments(p, self.a, self.b).min())

    def segment_distance(self, p, q) -> float:
        """Distance of a segment; 0 if it meets the shape."""
        if self.covers(p) or self.covers(q) or len(crossings(p, q, self.a, self.b)):
            return 0.0
        return float(min(point_segments(p, self.a, self.b).min(), point_segments(q, self.a, self.b).min(), points_segment(self.a, p, q).min(), points_segment(self.b, p, q).min()))

    def box_distance(self, p, q) -> float:
        """Lower bound of the segment's distance, from boxes."""
        gap = np.maximum(0, np.maximum(self.low - np.maximum(p, q), np.minimum(p, q) - self.high))
        return float(np.hypot(*gap))


def point_segments(p, a, b) -> np.ndarray:
    """Distance of one point from each segment."""
    d = b - a
    n = (d * d).sum(1)
    t = np.clip(((p - a) * d).sum(1) / np.where(n > 0, n, 1), 0, 1)
    return np.hypot(*(a + t[:, None] * d - p).T)


def points_segment(points, p, q) -> np.ndarray:
    """Distance of each point from one segment."""
    d = q - p
    n = float(d @ d)
    t = np.clip((points - p) @ d / n, 0, 1) if n > 0 else np.zeros(len(points))
    return np.hypot(*(p + t[:, None] * d - points).T)


def project(p, a, b) -> tuple[np.ndarray, float]:
    """Nearest point of a segment to p, and its share of the segment."""
    d = b - a
    n = float(d @ d)
    t = float(np.clip((p - a) @ d / n, 0, 1)) if n > 0 else 0.0
    return a + t * d, t


def crossings(p, q, a, b) -> np.ndarray:
    """Rows (share along p-q, number of the segment) where p-q meets segments a-b."""
    r, s = q - p, b - a
    cross = r[0] * s[:, 1] - r[1] * s[:, 0]
    w = a - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[:, 0] * s[:, 1] - w[:, 1] * s[:, 0]) / cross
        u = (w[:, 0] * r[1] - w[:, 1] * r[0]) / cross
    hit = np.flatnonzero((np.abs(cross) > EPS) & (t >= -EPS) & (t <= 1 + EPS) & (u >= -EPS) & (u <= 1 + EPS))
    return np.stack([np.clip(t[hit], 0, 1), hit], 1) if len(hit) else np.empty((0, 2))


def angle(u, v) -> float:
    """Turn between two directions in degrees, from 0 to 180."""
    return float(np.degrees(np.arctan2(abs(u[0] * v[1] - u[1] * v[0]), u @ v)))


def self_crossing(ring: np.ndarray) -> bool:
    """Whether a chain of segments meets itself other than at shared ends of neighbours."""
    n = len(ring) - 1
    closed = bool(np.allclose(ring[0], ring[-1]))
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        for t, k in crossings(ring[i], ring[i + 1], ring[j], ring[j + 1]):
            other = int(j[int(k)])
            if other == i + 1 and t > 1 - 1e-7:
                continue
            if closed and i == 0 and other == n - 1 and t < 1e-7:
                continue
            return True
    return False


def zone(shape: Shape, p, q, margin: float) -> list[tuple[float, float]]:
    """Stretches of p-q in metres that lie within margin of the shape, by sampling and bisection on the distance."""
    length = float(np.hypot(*(q - p)))
    if length == 0 or shape.box_distance(p, q) > margin:
        return []
    inside = lambda s: shape.distance(p + (q - p) * (s / length)) <= margin
    hits = sorted({0.0, length, *(float(t) * length for t, _ in crossings(p, q, shape.a, shape.b)), *(float(project(v, p, q)[1]) * length for v in shape.a), *np.linspace(0, length, max(2, int(length // 4) + 2))})
    state, out, start = inside(0.0), [], 0.0
    for lo, hi in zip(hits, hits[1:]):
        now = inside(hi)
        if now != state:
            a, b = lo, hi
            for _ in range(48):
                mid = (a + b) / 2
                a, b = (mid, b) if inside(mid) == state else (a, mid)
            if state:
                out.append((start, a))
            else:
                start = b
            state = now
    if state:
        out.append((start, length))
    return out
