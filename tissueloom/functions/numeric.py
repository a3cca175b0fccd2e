"""Small numeric kernels for driver steps and per-group functions (numpy only)."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

import numpy as np


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment (Kuhn-Munkres with potentials, cubic); rectangular costs leave some unassigned."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    return sorted((j, i) if flip else (i, j) for i, j in assignment_rows(lambda i: c[i], *c.shape))


def assignment_rows(row: Callable[[int], np.ndarray], n: int, m: int) -> list[tuple[int, int]]:
    """As ``assignment`` of n rows, each made when it is needed, to m >= n columns."""
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = ~used[1:]
            reduced = row(i0 - 1) - u[i0] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = 1 + int(np.argmin(np.where(free, least[1:], np.inf)))
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]


def best_assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of largest total, on scores scaled to 0..1."""
    s = np.asarray(score, float)
    span = s.max() - s.min() or 1.0
    return assignment(1 - (s - s.min()) / span)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 100) -> np.ndarray:
    """argmin |a x - b| with x >= 0, by the active set of Lawson and Hanson (ties: the first column)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    # below this a column's product with the residual is rounding; taken for a gain it would share out equal columns
    noise = 1e-12 * np.linalg.norm(a, axis=0) * np.linalg.norm(b)
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        if passive.all() or (w[~passive] <= noise[~passive]).all():
            break
        gain = np.where(passive | (w <= noise), -np.inf, w)
        passive[np.argmax(gain >= gain.max() - noise)] = True  # of equal columns the first
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (z[passive] > 0).all():
                break
            bad = passive & (z <= 0)
            x = x + np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300)) * (z - x)
            passive &= x > 1e-12
            if not passive.any():
                break
        x = np.where(passive, z, 0.0)
    return x


def minimize_scalar(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-6, rounds: int = 100) -> tuple[float, float]:
    """Brent's method on an interval: (x, f(x))."""
    gold = (3 - math.sqrt(5)) / 2
    x = w = v = lo + gold * (hi - lo)
    fx = fw = fv = f(x)
    d = e = 0.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        t = tol * abs(x) + 1e-12
        if abs(x - mid) <= 2 * t - (hi - lo) / 2:
            break
        p = q = r = 0.0
        if abs(e) > t:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
        if abs(e) > t and abs(p) < abs(q * e / 2) and q * (lo - x) < p < q * (hi - x):
            e, d = d, p / q
        else:
            e = (hi if x < mid else lo) - x
            d = gold * e
        u = x + (d if abs(d) >= t else math.copysign(t, d))
        fu = f(u)
        if fu <= fx:
            lo, hi = (x, hi) if u >= x else (lo, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            lo, hi = (u, hi) if u < x else (lo, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx


def minimize_box(f: Callable[[np.ndarray], float], x0: np.ndarray, lower: np.ndarray, upper: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Projected BFGS with numeric gradients and backtracking inside a box."""
    x = np.clip(np.asarray(x0, float), lower, upper)
    scale = np.maximum(upper - lower, 1e-12)

    def gradient(x, fx):
        g = np.zeros_like(x)
        for k in range(len(x)):
            h = 1e-4 * scale[k]
            up, down = x.copy(), x.copy()
            up[k], down[k] = min(x[k] + h, upper[k]), max(x[k] - h, lower[k])
            g[k] = (f(up) - f(down)) / max(up[k] - down[k], 1e-300)
        return g

    fx = f(x)
    g, inv = gradient(x, fx), np.diag(scale**2) * 1e-2
    for _ in range(rounds):
        fixed = ((x <= lower) & (g > 0)) | ((x >= upper) & (g < 0))
        step = -(inv @ np.where(fixed, 0, g))
        step[fixed] = 0
        if g @ step >= 0:
            step = np.where(fixed, 0, -g * scale**2 * 1e-2)
        t, done = 1.0, True
        while t > 1e-8:
            new = np.clip(x + t * step, lower, upper)
            fn = f(new)
            if fn < fx - 1e-10:
                done = False
                break
            t /= 2
        if done:
            break
        gn = gradient(new, fn)
        s, y = new - x, gn - g
        if s @ y > 1e-12:
            rho = 1 / (s @ y)
            eye = np.eye(len(x))
            inv = (eye - rho * np.outer(s, y)) @ inv @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        x, fx, g = new, fn, gn
    return x, fx


def coordinate_descent(f: Callable[[np.ndarray], float], x0: np.ndarray, lower: np.ndarray, upper: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, float]:
    """One variable at a time by Brent's method."""
    x, fx = np.array(x0, float), f(np.array(x0, float))
    for _ in range(rounds):
        before = fx
        for k in range(len(x)):
            v, fv = minimize_scalar(lambda t: f(np.where(np.arange(len(x)) == k, t, x)), lower[k], upper[k])  # noqa: B023
            if fv < fx:
                x[k], fx = v, fv
        if before - fx < 1e-9:
            break
    return x, fx


#: Side of a block of a factor, and bytes of a factor beyond which it lies in a file.
FACTOR_BLOCK, FACTOR_BYTES = 512, 400 << 20


class BlockFactor:
    """L of a symmetric positive definite matrix A = L L', factored in place in blocks of rows.

    ``rows(a, b, lo)`` makes rows a..b of A, columns lo..b. Block row i begins at block ``first[i]``, if all
    before it is zero. A large factor lies in a file, which close() deletes. Right sides are rows.
    """

    def __init__(self, rows: Callable[[int, int, int], np.ndarray], n: int, first: np.ndarray | None = None):
        self.cuts = [(a, min(a + FACTOR_BLOCK, n)) for a in range(0, n, FACTOR_BLOCK)]
        self.low = [self.cuts[0 if first is None else int(first[i])][0] for i in range(len(self.cuts))]
        starts = np.cumsum([0] + [(b - a) * (b - lo) for (a, b), lo in zip(self.cuts, self.low, strict=True)])
        self.file = tempfile.TemporaryFile() if 8 * starts[-1] > FACTOR_BYTES else None
        room = np.memmap(self.file, float, "w+", shape=(int(starts[-1]),)) if self.file else np.empty(int(starts[-1]))
        self.factor, self.inverse = [], []
        for (a, b), lo, s in zip(self.cuts, self.low, starts, strict=False):
            own = room[s : s + (b - a) * (b - lo)].reshape(b - a, b - lo)
            own[:] = rows(a, b, lo)
            for j in range(lo // FACTOR_BLOCK, len(self.factor)):
                self._reduce(own, j, lo)
            own[:, a - lo :] = np.linalg.cholesky(own[:, a - lo :] - own[:, : a - lo] @ own[:, : a - lo].T)
            self.factor.append(own), self.inverse.append(np.linalg.inv(own[:, a - lo :]))

    def _reduce(self, rows: np.ndarray, j: int, at: int) -> None:
        """Block j of rows L^-T, whose first column is ``at`` and whose blocks before j are done."""
        (a, b), lo = self.cuts[j], max(at, self.low[j])
        if a > lo:
            rows[:, a - at : b - at] -= rows[:, lo - at : a - at] @ self.factor[j][:, lo - self.low[j] : a - self.low[j]].T
        rows[:, a - at : b - at] = rows[:, a - at : b - at] @ self.inverse[j].T

    def reduced(self, rows: np.ndarray) -> np.ndarray:
        """rows L^-T, in place."""
        for j in range(len(self.cuts)):
            self._reduce(rows, j, 0)
        return rows

    def solved(self, rows: np.ndarray) -> np.ndarray:
        """rows A^-1, in place."""
        self.reduced(rows)
        for j in range(len(self.cuts) - 1, -1, -1):
            (a, b), lo = self.cuts[j], self.low[j]
            rows[:, a:b] = rows[:, a:b] @ self.inverse[j]
            rows[:, lo:a] -= rows[:, a:b] @ self.factor[j][:, : a - lo]
        return rows

    def log_det(self) -> float:
        return 2 * sum(float(np.log(np.diagonal(f, f.shape[1] - f.shape[0])).sum()) for f in self.factor)

    def close(self) -> None:
        self.factor, self.inverse = [], []
        if self.file:
            self.file.close()


def otsu(histogram: np.ndarray) -> int:
    """Threshold of largest between-class variance of a histogram of levels."""
    h = np.asarray(histogram, float)
    w = np.cumsum(h)
    m = np.cumsum(h * np.arange(len(h)))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m * w[-1]) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, np.nan))) if np.isfinite(between).any() else 0


def connected_regions(mask: np.ndarray) -> np.ndarray:
    """Labels (from 1) of 4-connected true regions, numbered by first pixel in reading order."""
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        big = np.where(mask, label, h * w + 1)
        new = big.copy()
        new[1:] = np.minimum(new[1:], big[:-1])
        new[:-1] = np.minimum(new[:-1], big[1:])
        new[:, 1:] = np.minimum(new[:, 1:], big[:, :-1])
        new[:, :-1] = np.minimum(new[:, :-1], big[:, 1:])
        new = np.where(mask, new, 0)
        # a label's own label: paths halve
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(mask, np.minimum(new, flat[new]), 0)
        if np.array_equal(new, label):
            names = np.unique(new[mask])
            return np.where(mask, np.searchsorted(names, new) + 1, 0)
        label = new


def similarity_transform(a: np.ndarray, b: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Least-squares scale, angle and translation that take points a to b (Procrustes in the plane)."""
    ma, mb = a.mean(0), b.mean(0)
    x, y = a - ma, b - mb
    dot, cross = (x * y).sum(), (x[:, 0] * y[:, 1] - x[:, 1] * y[:, 0]).sum()
    theta = math.atan2(cross, dot)
    scale = math.hypot(dot, cross) / max((x**2).sum(), 1e-300)
    r = np.array([[math.cos(theta), -math.sin(theta)], [math.sin(theta), math.cos(theta)]])
    return scale, theta, mb - scale * r @ ma


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Hull in counter-clockwise order (monotone chain)."""
    p = sorted(map(tuple, np.unique(points, axis=0).tolist()))
    if len(p) < 3:
        return np.array(p)

    def half(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def concave_hull(points: np.ndarray, ratio: float = 2.0) -> np.ndarray:
    """The convex hull dug in: an edge goes through the nearest point inside where it is long beside that point's distance.

    An edge is replaced by two as long as its length over the smaller distance of the inner point
    to its ends exceeds ``ratio`` and no point is left out (Park and Oh's rule). Counter-clockwise.
    """
    hull = convex_hull(points)
    if len(hull) < 3:
        return hull
    inner = {tuple(p) for p in np.unique(points, axis=0).tolist()} - set(map(tuple, hull.tolist()))
    ring = [tuple(p) for p in hull.tolist()]
    at = 0
    while at < len(ring) and inner:
        a, b = np.array(ring[at]), np.array(ring[(at + 1) % len(ring)])
        rest = np.array(sorted(inner))
        edge = b - a
        length = math.hypot(*edge)
        t = np.clip(((rest - a) @ edge) / max(length**2, 1e-300), 0, 1)
        off = np.linalg.norm(rest - (a + t[:, None] * edge), axis=1)
        best = int(np.lexsort((rest[:, 1], rest[:, 0], off))[0])
        p = rest[best]
        near = min(math.hypot(*(p - a)), math.hypot(*(p - b)))
        # it must be nearer to this edge than to its neighbours, so that edges do not cross
        others = [(ring[at - 1], ring[at]), (ring[(at + 1) % len(ring)], ring[(at + 2) % len(ring)])]
        apart = min(_to_segment(p, np.array(c), np.array(d)) for c, d in others)
        if near > 0 and length / near > ratio and off[best] <= apart + 1e-12:
            ring.insert(at + 1, tuple(p.tolist()))
            inner.discard(tuple(p.tolist()))
        else:
            at += 1
    return np.array(ring)


def _to_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    edge = b - a
    t = min(1.0, max(0.0, float((p - a) @ edge) / max(float(edge @ edge), 1e-300)))
    return math.hypot(*(p - a - t * edge))
