"""Vectorised random variates over Arrow batches, one independent stream per row key."""

from __future__ import annotations

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def stream(key, tag: int) -> np.ndarray:
    """Independent sub-keys for one step of an algorithm."""
    with np.errstate(over="ignore"):
        return _mix(np.asarray(key).astype(np.int64).view(np.uint64) + np.uint64(tag + 1) * _GOLD)


def uniform(key: np.ndarray, draw) -> np.ndarray:
    with np.errstate(over="ignore"):
        bits = _mix(key + (np.asarray(draw, dtype=np.uint64) + np.uint64(1)) * _GOLD)
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def normal(key: np.ndarray, draw: int = 0) -> np.ndarray:
    return np.sqrt(-2.0 * np.log(uniform(key, 2 * draw))) * np.cos(2.0 * np.pi * uniform(key, 2 * draw + 1))


def gamma(key: np.ndarray, shape) -> np.ndarray:
    """Unit-scale Gamma draws (Marsaglia-Tsang, boosted below shape 1)."""
    shape = np.broadcast_to(np.asarray(shape, dtype=np.float64), key.shape)
    d = np.where(shape < 1.0, shape + 1.0, shape) - 1.0 / 3.0
    c = 1.0 / np.sqrt(9.0 * d)
    out = np.empty(key.shape)
    todo, t = np.arange(key.size), 1
    flat_key, flat_d, flat_c, flat_out = key.ravel(), d.ravel(), c.ravel(), out.ravel()
    while todo.size:
        k, dd, cc = flat_key[todo], flat_d[todo], flat_c[todo]
        x = normal(k, 2 * t)
        v = (1.0 + cc * x) ** 3
        ok = v > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            ok &= np.log(uniform(k, 4 * t + 2)) < 0.5 * x * x + dd - dd * v + dd * np.log(v)
        flat_out[todo[ok]] = (dd * v)[ok]
        todo, t = todo[~ok], t + 1
    out = flat_out.reshape(key.shape)
    return np.maximum(np.where(shape < 1.0, out * uniform(key, 0) ** (1.0 / np.maximum(shape, 1e-12)), out), 1e-300)


def binomial(key: np.ndarray, n, p) -> np.ndarray:
    """Exact binomial draws: halve n by its median order statistic, then flip coins."""
    n = np.array(np.broadcast_to(n, key.shape), dtype=np.int64)
    p = np.clip(np.array(np.broadcast_to(p, key.shape), dtype=np.float64), 0.0, 1.0)
    hits, level = np.zeros(key.shape, dtype=np.int64), 0
    while True:
        big = np.flatnonzero(n > 16)
        if not big.size:
            break
        a = 1 + n[big] // 2
        sub = stream(key[big].view(np.int64), 1000 + level)
        g1 = gamma(stream(sub.view(np.int64), 1), a)
        g2 = gamma(stream(sub.view(np.int64), 2), n[big] + 1 - a)
        x = g1 / (g1 + g2)
        below = x <= p[big]
        hits[big] += np.where(below, a, 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            p[big] = np.clip(np.where(below, (p[big] - x) / (1.0 - x), p[big] / x), 0.0, 1.0)
        n[big] = np.where(below, n[big] - a, a - 1)
        level += 1
    for t in range(int(n.max(initial=0))):
        on = np.flatnonzero(n > t)
        hits[on] += uniform(key[on], t) < p[on]
    return hits


def multinomial(key: np.ndarray, n, weights: np.ndarray) -> np.ndarray:
    """Rows of counts in proportion to rows of (unnormalised) weights."""
    left = np.array(np.broadcast_to(n, key.shape), dtype=np.int64)
    rest = np.cumsum(weights[:, ::-1], axis=1)[:, ::-1]
    out = np.zeros(weights.shape, dtype=np.int64)
    for k in range(weights.shape[1] - 1):
        on = np.flatnonzero(left > 0)
        if not on.size:
            break
        with np.errstate(invalid="ignore", divide="ignore"):
            p = np.where(rest[on, k] > 0, weights[on, k] / rest[on, k], 0.0)
        out[on, k] = binomial(stream(key[on].view(np.int64), 10_000 + k), left[on], p)
        left[on] -= out[on, k]
    out[:, -1] += left
    return out


_DIRECT = 64  # table-count trials done one by one


def _log_gap(pos, s, r):
    """Log probability of no success in trials pos ... s."""
    return lgamma(s + 1.0) - lgamma(pos) - lgamma(r + s + 1.0) + lgamma(r + pos)


def tables(key: np.ndarray, n, r) -> np.ndarray:
    """Chinese-restaurant table counts: sum over t < n of Bernoulli(r / (r + t)).

    After the first few trials successes are rare, so the draw jumps from one
    to the next by inverting the gap distribution; cost grows with log n.
    """
    n = np.array(np.broadcast_to(n, key.shape), dtype=np.int64).ravel()
    r = np.array(np.broadcast_to(r, key.shape), dtype=np.float64).ravel()
    flat, out = key.ravel(), np.zeros(key.size, dtype=np.int64)
    for t in range(min(int(n.max(initial=0)), _DIRECT)):
        on = np.flatnonzero(n > t)
        out[on] += uniform(flat[on], t) < r[on] / (r[on] + t)
    on, pos, draw = np.flatnonzero(n > _DIRECT), np.full(key.size, _DIRECT, dtype=np.int64), _DIRECT
    while on.size:
        goal, p, rr = np.log(uniform(flat[on], draw)), pos[on].astype(np.float64), r[on]
        lo, hi = pos[on].copy(), n[on] - 1
        hit = _log_gap(p, hi.astype(np.float64), rr) <= goal
        on, goal, p, rr, lo, hi = on[hit], goal[hit], p[hit], rr[hit], lo[hit], hi[hit]
        while on.size and (lo < hi).any():
            mid = (lo + hi) // 2
            reached = _log_gap(p, mid.astype(np.float64), rr) <= goal
            lo, hi = np.where(reached, lo, mid + 1), np.where(reached, mid, hi)
            lo = np.minimum(lo, hi)
        out[on] += 1
        pos[on] = hi + 1
        on, draw = on[pos[on] < n[on]], draw + 1
    return out.reshape(key.shape)


def polyagamma_mean(h, z):
    z = np.maximum(np.abs(z), 1e-6)
    return h / (2.0 * z) * np.tanh(z / 2.0)


def polyagamma_var(h, z):
    z = np.maximum(np.abs(z), 1e-2)
    # sech^2(z/2) (sinh z - z), written without overflow
    e = np.exp(-z)
    return h / (4.0 * z**3) * 2.0 * (1.0 - e * e - 2.0 * z * e) / (1.0 + e) ** 2


def polyagamma(key: np.ndarray, h, z, terms: int = 48) -> np.ndarray:
    """PG(h, z): normal for h >= 50, else a Gamma series whose tail is its mean."""
    h = np.array(np.broadcast_to(h, key.shape), dtype=np.float64)
    z = np.array(np.broadcast_to(z, key.shape), dtype=np.float64)
    mean = polyagamma_mean(h, z)
    out = np.maximum(mean + np.sqrt(polyagamma_var(h, z)) * normal(stream(key.view(np.int64), 1)), mean * 1e-3)
    few = np.flatnonzero((h < 50.0).ravel())
    if few.size:
        hk, zk, kk = h.ravel()[few], z.ravel()[few], key.ravel()[few]
        total, expected = np.zeros(few.size), np.zeros(few.size)
        for t in range(1, terms + 1):
            scale = 1.0 / (2.0 * np.pi**2 * ((t - 0.5) ** 2 + zk * zk / (4.0 * np.pi**2)))
            total += scale * gamma(stream(kk.view(np.int64), 100 + t), hk)
            expected += scale * hk
        flat = out.ravel()
        flat[few] = total + np.maximum(mean.ravel()[few] - expected, 0.0)
        out = flat.reshape(out.shape)
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma for positive arguments: recurrence to x >= 8, then Stirling's series."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8.0
        shift = np.where(low, shift - np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1.0, y)
    w = 1.0 / (y * y)
    series = (1.0 / 12.0 + w * (-1.0 / 360.0 + w * (1.0 / 1260.0 + w * (-1.0 / 1680.0 + w / 1188.0)))) / y
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2.0 * np.pi) + series


def negbin_logpmf(r, p, k):
    """Log probability of k under a negative binomial with dispersion r and success p."""
    p = np.minimum(p, 0.999999)
    return lgamma(r + k) - lgamma(r) - lgamma(k + 1.0) + np.where(k > 0, k * np.log(np.maximum(p, 1e-300)), 0.0) + r * np.log1p(-p)
