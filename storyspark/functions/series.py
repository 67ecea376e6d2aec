"""Ordered-series kernels: LOWESS, LTTB, peaks with spacing, three acts, four phases. Plain numpy over one series; see operators.custom for the grouped form."""

from __future__ import annotations

import numpy as np


def lowess(x, y, weights=None, bandwidth: float = 0.05, min_points: int = 5, iterations: int = 3) -> np.ndarray:
    """Locally weighted linear regression with tricube weights and bisquare robustness.

    The bandwidth around a point doubles until it holds ``min_points`` points or spans the series. Fewer than ``min_points``
    points come back as they are. A bandwidth that is not positive is an error.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n < min_points:
        return y.copy()
    if bandwidth <= 0:
        raise ValueError("bandwidth must be positive")
    w = np.ones(n) if weights is None else np.asarray(weights, float)
    order = np.argsort(x, kind="stable")
    xs, ys, ws = x[order], y[order], w[order]
    span, h = float(xs[-1] - xs[0]), np.full(n, float(bandwidth))
    while True:
        lo, hi = np.searchsorted(xs, xs - h, "left"), np.searchsorted(xs, xs + h, "right")
        narrow = (hi - lo < min_points) & (h < span)
        if not narrow.any():
            break
        h[narrow] *= 2
    width = int((hi - lo).max())
    step = max(1, (1 << 20) // width)  # rows of the neighbour table at once
    robust, fit = np.ones(n), ys.copy()
    for turn in range(iterations + 1):
        for i in range(0, n, step):
            j = slice(i, i + step)
            near = lo[j, None] + np.arange(width)
            inside = near < hi[j, None]
            near = np.minimum(near, n - 1)
            d = np.abs(xs[near] - xs[j, None]) / np.maximum(h[j, None], 1e-12)
            k = np.where(inside, np.clip(1 - d**3, 0, None) ** 3 * ws[near] * robust[near], 0.0)
            total = k.sum(1)
            safe = np.where(total > 1e-12, total, 1.0)
            mx, my = (k * xs[near]).sum(1) / safe, (k * ys[near]).sum(1) / safe
            dx = xs[near] - mx[:, None]
            var = (k * dx**2).sum(1)
            slope = np.where(var > 1e-12, (k * dx * ys[near]).sum(1) / np.where(var > 1e-12, var, 1.0), 0.0)
            fit[j] = np.where(total > 1e-12, my + slope * (xs[j] - mx), ys[j])
        if turn == iterations:
            break
        r = np.abs(ys - fit)
        scale = 6 * np.median(r)
        if scale <= 1e-12:
            break
        robust = np.clip(1 - (r / scale) ** 2, 0, None) ** 2
    out = np.empty(n)
    out[order] = fit
    return out


def smooth_nullable(x, y, **options) -> list:
    """LOWESS over the values that are not null; nulls stay null."""
    known = [i for i, v in enumerate(y) if v is not None and not np.isnan(v)]
    out: list = [None] * len(y)
    for i, v in zip(known, lowess([x[i] for i in known], [y[i] for i in known], **options)):
        out[i] = float(v)
    return out


def lttb(y, budget: int) -> list[int]:
    """Places kept by largest-triangle-three-buckets; the next bucket's x is this bucket's number from 1, null values count as 0.

    A series within the budget stays whole; a budget under 3 keeps the two ends.
    """
    v = np.nan_to_num(np.asarray([0.0 if a is None else a for a in y], float))
    n = len(v)
    if n <= budget:
        return list(range(n))
    if budget < 3:
        return sorted({0, n - 1})
    edges = np.minimum(1 + np.floor(np.arange(budget - 1) * ((n - 2) / (budget - 2))).astype(int), n - 1)
    ahead = [v[a:b].mean() if b > a else 0.0 for a, b in zip(edges[1:-1], edges[2:])] + [v[-1]]
    keep = [0]
    for b, (lo, hi, ny) in enumerate(zip(edges[:-1], edges[1:], ahead)):
        if lo < hi:
            a, i = keep[-1], np.arange(lo, hi)
            area = np.abs((a - (b + 1)) * (v[i] - v[a]) - (a - i) * (ny - v[a]))
            keep.append(int(i[area.argmax()]))
    return [*keep, n - 1]


def sample_curve(y, budget: int, must_keep=()) -> list[int]:
    """The places that must stay (the first maximum is one) and LTTB places of the others; the budget left for LTTB is at least 3."""
    if len(y) <= budget:
        return list(range(len(y)))
    must = {int(i) for i in must_keep} | {int(np.argmax([0.0 if a is None else a for a in y]))}
    rest = [i for i in range(len(y)) if i not in must]
    return sorted(must | {rest[i] for i in lttb([y[i] for i in rest], max(budget - len(must), 3))})


def spaced_peaks(x, v, spacing: float = 0.05) -> list[int]:
    """Strict local maxima, taken from the left, each at least ``spacing`` after the one before."""
    out: list[int] = []
    for i in range(1, len(v) - 1):
        if v[i] > v[i - 1] and v[i] > v[i + 1] and (not out or x[i] - x[out[-1]] >= spacing):
            out.append(i)
    return out


def three_acts(x, tension, conflict=None, flags=None, least: float = 0.05) -> dict | None:
    """Shares of set-up, confrontation and resolution of a series with rising positions, and the climax's place.

    The climax lies in the window of the last 45 % with most conflicts, then most plot flags, then most tension, then the last one; the
    window is 8 % of the span, at least the width of 8 points and at most that of 24. The set-up ends at the point between half
    way to that window and two windows of 6 % (6 to 18 points) before it where tension and the density of conflicts and flags rise
    most from the window before to the one after; without such a point, at the valley before the climax. Each act has
    ``least`` of the whole at least. Under three points the acts are equal; positions that don't rise, or none, give null.
    """
    x, t = np.asarray(x, float), np.asarray(tension, float)
    n = len(x)
    if not n or (np.diff(x) <= 0).any():
        return None
    if n < 3:
        return dict.fromkeys(("setup", "confrontation", "resolution"), round(1 / 3, 4)) | {"climax": float(t.argmax())}
    total = lambda v: np.concatenate([[0.0], np.cumsum(np.zeros(n) if v is None else np.asarray(v, float))])
    c, f, s = total(conflict), total(flags), total(t)
    span, width = x[-1] - x[0], lambda k: x[min(k, n) - 1] - x[0]
    w = min(max(0.08 * span, width(8)), width(24))
    last = x[-1] - w + 1e-9
    at = np.flatnonzero((x >= min(x[-1] - 0.45 * span, x[-1] - w)) & (x <= last))
    at = at if len(at) else np.flatnonzero(x <= last)
    at = at if len(at) else np.array([n - 1])
    end = np.searchsorted(x, x[at] + w)
    best = np.lexsort((at, (s[end] - s[at]) / np.maximum(end - at, 1), f[end] - f[at], c[end] - c[at]))[-1]
    start, stop = int(at[best]), max(int(end[best]), int(at[best]) + 1)
    peak = stop - 1 - int(t[start:stop][::-1].argmax())
    first = int(t[:peak].argmin()) if peak else 0
    w = max(0.06 * span, width(6))
    w = min(w, width(18)) if width(18) > width(6) else w
    w = min(w, x[start] - x[0]) if start else w
    at = np.flatnonzero((x >= max(x[0] + w, (x[0] + x[start]) / 2)) & (x <= x[start] - 2 * w))
    if w > 0 and len(at):
        lo, hi = np.searchsorted(x, x[at] - w, "right"), np.searchsorted(x, x[at] + w)
        at, lo, hi = (v[(lo < at) & (at < hi)] for v in (at, lo, hi))
        rise = lambda v: (v[hi] - v[at]) / (hi - at) - (v[at] - v[lo]) / (at - lo)
        tense, dense = rise(s), rise(c + f)
        up = np.where((tense > 0) & (dense > 0), tense + dense, -np.inf)
        if len(at) and up.max() > 0:
            first = int(at[up.argmax()])
    ends = np.array([x[first], x[-1] if peak == n - 1 else x[peak]])
    acts = np.maximum(np.diff([x[0], *ends, x[-1]]) / span, least)
    acts = acts / acts.sum()
    return {"setup": round(float(acts[0]), 4), "confrontation": round(float(acts[1]), 4), "resolution": round(float(acts[2]), 4), "climax": round(float((x[peak] - x[0]) / span), 4)}


def four_phases(tension) -> list[tuple[str, int, int]]:
    """(phase, first, last) places: one phase under 5 points, fixed 15/50/80 % under 20, else around the highest late peak."""
    n = len(tension)
    names = ("opening", "rising", "climax", "closing")
    if not n:
        return []
    if n < 5:
        return [("opening", 0, n - 1)]
    if n < 20:
        cuts = [int(n * 0.15), int(n * 0.5), int(n * 0.8)]
    else:
        start = n // 2
        peak = start + int(np.argmax(np.asarray(tension[start:], float)))
        radius = max(1, n // 20)
        cuts = [int(n * 0.15), max(int(n * 0.15) + 1, peak - radius), min(n - 1, peak + radius + 1)]
    cuts = [max(1, cuts[0]), *cuts[1:]]
    edges = [0, *cuts, n]
    return [(name, a, b - 1) for name, a, b in zip(names, edges, edges[1:]) if b > a]


def monotone(x) -> list[float]:
    """Positions forced to rise strictly, by 1e-6 steps, capped at 1."""
    out: list[float] = []
    for v in x:
        out.append(min(1.0, v if not out or v > out[-1] else out[-1] + 1e-6))
    return out


def mtld(tokens, threshold: float = 0.72) -> float | None:
    """Forward measure of textual lexical diversity: 0 without tokens, null where all tokens differ; what is left over counts as part of a factor."""
    if not len(tokens):
        return 0.0
    factors, seen, n = 0.0, set(), 0
    for t in tokens:
        seen.add(t)
        n += 1
        if len(seen) / n <= threshold:
            factors, seen, n = factors + 1, set(), 0
    if n:
        factors += (1 - len(seen) / n) / (1 - threshold)
    return len(tokens) / factors if factors else None
