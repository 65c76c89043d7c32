"""How much of each edge of one shape lies within a distance of another shape's boundary.

Helpers for Arrow batches of pairs that a cell join has already brought together.  Edges are flat arrays
of x1, y1, x2, y2; all pairs of a batch are worked on at once, in slices of bounded size.
"""

from __future__ import annotations

import numpy as np

#: edge pairs looked at together
SLICE = 1 << 20


def _ragged(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions start, start + 1, ... of each item, and the item each belongs to."""
    item = np.repeat(np.arange(len(counts)), counts)
    return starts[item] + np.arange(len(item)) - (np.cumsum(counts) - counts)[item], item


def _intervals(a: np.ndarray, b: np.ndarray, ln: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Part (t0, t1) of each edge ``a`` within ``tol`` of its edge ``b``; NaN where there is none."""
    ax, ay = a[:, 0], a[:, 1]
    ux, uy = (a[:, 2] - ax) / ln, (a[:, 3] - ay) / ln
    lb = np.hypot(b[:, 2] - b[:, 0], b[:, 3] - b[:, 1])
    vx, vy = (b[:, 2] - b[:, 0]) / lb, (b[:, 3] - b[:, 1]) / lb
    rx, ry = ax - b[:, 0], ay - b[:, 1]

    def disc(px, py):
        at, off = (px - ax) * ux + (py - ay) * uy, (px - ax) * uy - (py - ay) * ux
        half = np.sqrt(np.where(np.abs(off) <= tol, tol * tol - off * off, np.nan))
        return at - half, at + half

    def slab(start, rate, lo, hi):
        flat = np.abs(rate) < 1e-12
        p, q = (lo - start) / rate, (hi - start) / rate
        inside = np.where((start >= lo) & (start <= hi), 1e18, np.nan)
        return np.where(flat, -inside, np.minimum(p, q)), np.where(flat, inside, np.maximum(p, q))

    p0, p1 = slab(rx * vx + ry * vy, ux * vx + uy * vy, 0.0, lb)
    q0, q1 = slab(rx * vy - ry * vx, ux * vy - uy * vx, -tol, tol)
    s0, s1 = np.maximum(p0, q0), np.minimum(p1, q1)
    met = s0 <= s1
    d0, d1 = disc(b[:, 0], b[:, 1])
    e0, e1 = disc(b[:, 2], b[:, 3])
    t0 = np.fmin(np.fmin(np.where(met, s0, np.nan), d0), e0)
    t1 = np.fmax(np.fmax(np.where(met, s1, np.nan), d1), e1)
    return np.maximum(t0, 0.0), np.minimum(t1, ln)


def _merged(item: np.ndarray, t0: np.ndarray, t1: np.ndarray, items: int) -> np.ndarray:
    """Length of the union of each item's intervals."""
    order = np.lexsort((t1, t0, item))
    item, t0, t1 = item[order], t0[order], t1[order]
    first = np.concatenate([[True], item[1:] != item[:-1]]) if len(item) else np.zeros(0, bool)
    rank = np.arange(len(item)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(item) else item
    out, end = np.zeros(items), np.full(items, -1.0)
    by_rank = np.argsort(rank, kind="stable")
    for k in np.split(by_rank, np.cumsum(np.bincount(rank))[:-1]) if len(item) else ():
        i = item[k]
        out[i] += np.maximum(t1[k] - np.maximum(t0[k], end[i]), 0.0)
        end[i] = np.maximum(end[i], t1[k])
    return out


def contact_lengths(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, tol: float) -> np.ndarray:
    """Per edge of ``a``: its length within ``tol`` of the boundary ``b`` of the same pair.

    ``a`` and ``b`` hold the edges of all pairs one after another, ``a_at`` and ``b_at`` where each pair begins, with the end.
    """
    pair = np.repeat(np.arange(len(a_at) - 1), np.diff(a_at))
    many = np.diff(b_at)[pair]
    ln = np.hypot(a[:, 2] - a[:, 0], a[:, 3] - a[:, 1])
    lo, hi = np.minimum(a[:, :2], a[:, 2:]) - tol, np.maximum(a[:, :2], a[:, 2:]) + tol
    b_lo, b_hi = np.minimum(b[:, :2], b[:, 2:]), np.maximum(b[:, :2], b[:, 2:])
    out = np.zeros(len(a))
    upto = np.cumsum(many)
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
        j, i = _ragged(b_at[:-1][pair[at:end]], many[at:end])
        near = np.all((b_lo[j] <= hi[at:end][i]) & (b_hi[j] >= lo[at:end][i]), axis=1)
        j, i = j[near], i[near]
        with np.errstate(divide="ignore", invalid="ignore"):
            t0, t1 = _intervals(a[at:end][i], b[j], ln[at:end][i], tol)
        hit = t1 > t0
        out[at:end] = _merged(i[hit], t0[hit], t1[hit], end - at)
        at = end
    return out
