"""Weighted exponential fits of batches of traces (NumPy, inside Arrow tasks).

For a fixed decay rate K the model A exp(K t) + C is linear, so A and C come from a 2 x 2
system and only K is searched: on a grid first, outwards from its ends where they are
best, then by golden section around the best rate and around the start value.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = (np.sqrt(5) - 1) / 2
#: Doublings of an end of the rate grid; exp overflows long before.
_DOUBLINGS = 40


def start_values(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R10 for rows of ``y``: offset 1.01 min - 0.01 max, then a line through ln(y - offset)."""
    low, high = y.min(axis=1), y.max(axis=1)
    offset = 1.01 * low - 0.01 * high
    flat = offset == low
    logs = np.log(np.where(flat[:, None], 1.0, y - offset[:, None]))
    tc = t - t.mean()
    slope = (logs * tc).sum(axis=1) / (tc**2).sum()
    level = logs.mean(axis=1) - slope * t.mean()
    return (
        np.where(flat, 0.0, np.exp(level)),
        np.where(flat, 1.0, slope),
        np.where(flat, low, offset),
    )


def _linear_part(k, t, y, w2, a_low, a_high):
    """Best bounded A, its C and the weighted residual sum, for one K per row."""
    e = np.exp(np.clip(k[:, None] * t[None, :], -700, 700))
    sw = w2.sum()
    me, my = (e * w2).sum(axis=1) / sw, (y * w2).sum(axis=1) / sw
    de, dy = e - me[:, None], y - my[:, None]
    var = (de * de * w2).sum(axis=1)
    a = np.divide((de * dy * w2).sum(axis=1), var, out=np.zeros_like(var), where=var > 0)
    a = np.clip(a, a_low, a_high)
    c = my - a * me
    rss = (w2 * (dy - a[:, None] * de) ** 2).sum(axis=1)
    return a, c, rss


def fit_decay(y: np.ndarray, weights: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Fitted curves and (A, K, C) for rows of ``y``; points of weight 0 are ignored.

    A stays between min(y_min - offset, A0) and max(y_max - offset, A0). A flat trace and
    one whose fit is not finite keep the start values.
    """
    n = y.shape[1]
    t_all = np.arange(n, dtype=float)
    keep = weights != 0
    t, yk, w2 = t_all[keep], y[:, keep], weights[keep] ** 2
    a0, k0, c0 = start_values(t, yk)
    a_low = np.minimum(yk.min(axis=1) - c0, a0)
    a_high = np.maximum(yk.max(axis=1) - c0, a0)

    def score(k):
        return _linear_part(k, t, yk, w2, a_low, a_high)[2]

    def narrowed(lo, hi):
        """Golden section between two rates per row."""
        for _ in range(steps):
            left, right = hi - _GOLDEN * (hi - lo), lo + _GOLDEN * (hi - lo)
            better_left = score(left) <= score(right)
            hi = np.where(better_left, right, hi)
            lo = np.where(better_left, lo, left)
        return (lo + hi) / 2

    span = max(float(t[-1] - t[0]), 1.0)
    rates = np.concatenate([-np.geomspace(240.0 / span, 1e-4 / span, 60), np.geomspace(1e-4 / span, 30.0 / span, 30)])
    grid = np.broadcast_to(rates, (len(y), len(rates)))
    grid = np.sort(np.concatenate([grid, k0[:, None]], axis=1), axis=1)
    scores = np.stack([score(grid[:, j]) for j in range(grid.shape[1])], axis=1)
    best = scores.argmin(axis=1)
    rows = np.arange(len(y))
    lo = grid[rows, np.maximum(best - 1, 0)]
    hi = grid[rows, np.minimum(best + 1, grid.shape[1] - 1)]
    # The rate is free: where an end of the grid is best, go on outwards while that helps.
    for end, beside, sign in ((0, 1, -1), (-1, -2, 1)):
        at_end = best == end % grid.shape[1]
        inner, edge, value, going = grid[:, beside], grid[:, end], scores[:, end], at_end
        for _ in range(_DOUBLINGS):
            further = edge + sign * np.maximum(np.abs(edge), 1.0 / span)
            found = score(further)
            going = going & (found < value)
            if not going.any():
                break
            inner, edge, value = np.where(going, edge, inner), np.where(going, further, edge), np.where(going, found, value)
        outer = edge + sign * np.maximum(np.abs(edge), 1.0 / span)
        lo = np.where(at_end, np.minimum(inner, outer), lo)
        hi = np.where(at_end, np.maximum(inner, outer), hi)
    k = narrowed(lo, hi)
    # The start value's own valley is searched too, and the better of both counts.
    place = (grid == k0[:, None]).argmax(axis=1)
    own = narrowed(grid[rows, np.maximum(place - 1, 0)], grid[rows, np.minimum(place + 1, grid.shape[1] - 1)])
    k = np.where(score(own) < score(k), own, k)
    a, c, rss = _linear_part(k, t, yk, w2, a_low, a_high)
    keep_start = (a0 == 0) | ~np.isfinite(rss)
    a, k, c = (np.where(keep_start, s, v) for s, v in ((a0, a), (k0, k), (c0, c)))
    fitted = a[:, None] * np.exp(np.clip(k[:, None] * t_all, -700, 700)) + c[:, None]
    return fitted, np.stack([a, k, c], axis=1)
