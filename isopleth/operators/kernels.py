"""NumPy functions behind the grouped kernels; nothing here knows Spark."""

from __future__ import annotations

import numpy as np

from ..functions.design import fornberg, window


def filter_passes(y: np.ndarray, b: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    """``n`` passes about the mean in alternating directions, from rest."""
    if not np.isfinite(y).all() or len(y) < max(len(a), len(b)):
        return np.full(len(y), np.nan)
    mean, x = y.mean(), y - y.mean()
    size = max(len(a), len(b))
    b, a = np.pad(b, (0, size - len(b))) / a[0], np.pad(a, (0, size - len(a))) / a[0]
    for k in range(n):
        z = x[:: -1 if k % 2 else 1]
        out, state = np.empty(len(z)), np.zeros(size)
        for i, v in enumerate(z):
            w = v - a[1:] @ state[: size - 1]
            out[i] = b[0] * w + b[1:] @ state[: size - 1]
            state[1:] = state[:-1].copy()
            state[0] = w
        x = out[:: -1 if k % 2 else 1]
    return x + mean


def segments(y: np.ndarray, nperseg: int | None) -> np.ndarray:
    """Half-overlapping segments of even length along the first axis."""
    n = len(y) if not nperseg else min(nperseg, len(y))
    n -= n % 2
    step = n // 2 if n < len(y) - len(y) % 2 else n
    whole = len(y) // n * n
    return np.stack([y[i : i + n] for i in range(0, whole - n + 1, step)])


def _detrended(y: np.ndarray, kind: str | None, axis: int = 0) -> np.ndarray:
    if not kind:
        return y
    y = y - y.mean(axis, keepdims=True)
    if kind == "linear":
        t = np.arange(y.shape[axis]) - (y.shape[axis] - 1) / 2
        t = t.reshape([-1 if i == axis % y.ndim else 1 for i in range(y.ndim)])
        y = y - t * (y * t).sum(axis, keepdims=True) / (t * t).sum()
    return y


def _coefficients(y: np.ndarray, nperseg, wintype, detrend) -> np.ndarray:
    parts = segments(y, nperseg)
    w = window(parts.shape[1], wintype)
    return np.fft.rfft(_detrended(parts, detrend, 1) * w, axis=1)[:, 1:] / w.sum()


def power(dx: float, y: np.ndarray, nperseg=None, wintype="boxcar", detrend="constant"):
    """Frequencies without zero, and power whose sum is the variance."""
    f = _coefficients(y, nperseg, wintype, detrend)
    p = np.abs(f) ** 2
    p[:, :-1] *= 2
    return np.arange(1, f.shape[1] + 1) / (2 * f.shape[1] * dx), p.mean(0)


def copower(dx: float, y1: np.ndarray, y2: np.ndarray, nperseg=None, wintype="boxcar", detrend="constant"):
    """f, C, Q, P1, P2, coherence, phase in degrees from 0 to 360."""
    f1, f2 = (_coefficients(y, nperseg, wintype, detrend) for y in (y1, y2))
    cross = np.conj(f1) * f2
    two = np.full(f1.shape[1], 2.0)
    two[-1] = 1
    c, q = (cross.real * two).mean(0), (cross.imag * two).mean(0)
    p1, p2 = ((np.abs(x) ** 2 * two).mean(0) for x in (f1, f2))
    with np.errstate(divide="ignore", invalid="ignore"):
        coh = c**2 / (p1 * p2)
    phase = np.degrees(np.arctan2(q, c)) % 360
    return np.arange(1, f1.shape[1] + 1) / (2 * f1.shape[1] * dx), c, q, p1, p2, coh, phase


def dft(t: np.ndarray, y: np.ndarray, centre: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients 1 to n // 2 of the n values that are there, at their places ``t``."""
    there = np.isfinite(y)
    t, y = t[there], y[there]
    n = len(y)
    if not n:
        return np.zeros(0), np.zeros(0), 0
    y = y - y.mean() if centre else y
    by = np.argsort(t)
    if (t[by] == np.arange(n)).all():
        c = np.fft.rfft(y[by])[1 : n // 2 + 1] / n
        return c.real, c.imag, n
    out = np.array([(y * np.exp(-2j * np.pi * k * t / n)).sum() / n for k in range(1, n // 2 + 1)])
    return out.real, out.imag, n


def _transform2d(y: np.ndarray, nperseg, wintype, detrend) -> np.ndarray:
    """(segment, f from -N to N without 0, k from 1): y is (time, cyclic)."""
    parts = segments(y, nperseg)
    parts = _detrended(parts, detrend, 1)
    parts = parts - parts.mean(2, keepdims=True)
    w = window(parts.shape[1], wintype)
    nt, nx = parts.shape[1:]
    full = np.fft.fft(np.fft.rfft(parts * w[None, :, None], axis=2), axis=1) / (w.sum() * nx)
    half = nt // 2
    order = np.concatenate([np.arange(half, nt), np.arange(1, half + 1)])
    return full[:, order, 1:]


def spectra2d(dx_lon: float, dx_time: float, y1: np.ndarray, y2: np.ndarray | None = None, nperseg=None, wintype="boxcar", detrend="constant"):
    """(k, f, [P] or [C, Q, P1, P2, coherence, phase]) with arrays of (f, k)."""
    a = _transform2d(y1, nperseg, wintype, detrend)
    nf, nk = a.shape[1:]
    two = np.full(nk, 2.0)
    if y1.shape[1] % 2 == 0:
        two[-1] = 1
    half = nf // 2
    f = np.concatenate([np.arange(-half, 0), np.arange(1, half + 1)]) / (2 * half * dx_time)
    k = np.arange(1, nk + 1) / (y1.shape[1] * dx_lon)
    p1 = (np.abs(a) ** 2 * two).mean(0)
    if y2 is None:
        return k, f, [p1]
    b = _transform2d(y2, nperseg, wintype, detrend)
    cross = a * np.conj(b)
    c, q, p2 = (cross.real * two).mean(0), (cross.imag * two).mean(0), (np.abs(b) ** 2 * two).mean(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        coh = (c**2 + q**2) / (p1 * p2)
    return k, f, [c, q, p1, p2, coh, np.degrees(np.arctan2(q, c)) % 360]


def derive(x: np.ndarray, y: np.ndarray, order: int, accuracy: int, keepedges: bool) -> np.ndarray:
    """Derivative on uneven points; NaN at edges unless kept with the nearest points."""
    half, n = accuracy // 2 + (order - 1) // 2, len(x)
    out = np.full(n, np.nan)
    for i in range(n):
        if half <= i < n - half:
            lo, hi = i - half, i + half + 1
        elif keepedges:
            near = min(i, n - 1 - i)
            count = min(n, max(order + 1, 2 * near + 1))
            lo = 0 if i < half else n - count
            hi = lo + count
        else:
            continue
        if hi - lo > order:
            out[i] = fornberg(x[lo:hi], x[i], order) @ y[lo:hi]
    return out


def fit_timescale(dt: float, corr: np.ndarray) -> tuple[float, float]:
    """tau and its standard error of exp(-k dt / tau) by Gauss-Newton on the rate."""
    t = np.arange(len(corr)) * dt
    if len(corr) == 2:
        return (-dt / np.log(corr[1]), 0.0) if 0 < corr[1] < 1 else (np.nan, np.nan)
    first = corr[1] if 0 < corr[1] < 1 else 0.5
    rate = -np.log(first) / dt
    for _ in range(200):
        model = np.exp(-rate * t)
        slope = -t * model
        step = (slope @ (corr - model)) / max(slope @ slope, 1e-300)
        while rate + step <= 0:
            step /= 2
        rate += step
        if abs(step) < 1e-14 * rate:
            break
    model = np.exp(-rate * t)
    left = ((corr - model) ** 2).sum() / max(1, len(t) - 1)
    slope = -t * model
    return 1 / rate, float(np.sqrt(left / max(slope @ slope, 1e-300)) / rate**2)


def link_tracks(rows: list[list[float]], most: int | None = None, seed: list[float] | None = None, separation: float | None = None) -> list[list[tuple[int, float]]]:
    """For each row its (track, value) pairs by greedy nearest assignment.

    Of the free pairs of a live track and a value the closest is joined first;
    tracks without a value end, values without a track take the first free slot.
    """
    slots = 2 * most if most else None
    last: dict[int, float] = dict(enumerate(seed or []))
    nexts, out = len(last), []
    for row in rows:
        pairs = sorted((abs(v - x), i, t) for t, x in last.items() for i, v in enumerate(row) if separation is None or abs(v - x) <= separation)
        track_of, used = {}, set()
        for _, i, t in pairs:
            if i not in track_of and t not in used:
                track_of[i] = t
                used.add(t)
        for i in range(len(row)):
            if i not in track_of:
                if slots is None:
                    track_of[i], nexts = nexts, nexts + 1
                else:
                    free = next((s for s in range(slots) if s not in used and s not in last), None)
                    free = next((s for s in range(slots) if s not in used), None) if free is None else free
                    if free is None:
                        continue
                    track_of[i] = free
                used.add(track_of[i])
        last = {t: row[i] for i, t in track_of.items()}
        out.append(sorted((t, row[i]) for i, t in track_of.items()))
    return out
