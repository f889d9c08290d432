"""Design of windows and filters: small driver-side arrays that become literals."""

from __future__ import annotations

import numpy as np

_NEEDS = {"kaiser", "gaussian", "welch"}


def window(n: int, kind: str | tuple = "boxcar") -> np.ndarray:
    """Periodic window of ``n`` weights; some kinds take a parameter: ``(kind, value)``."""
    name, *parameters = (kind,) if isinstance(kind, str) else kind
    if name in _NEEDS and name != "welch" and not parameters:
        raise ValueError(f"window {name} needs a parameter: ({name!r}, value)")
    x = np.arange(n)
    if n == 1 or name == "boxcar":
        return np.ones(n)
    turn = 2 * np.pi * x / n
    centred = x - n / 2
    if name in ("hann", "hanning"):
        return 0.5 - 0.5 * np.cos(turn)
    if name == "hamming":
        return 0.54 - 0.46 * np.cos(turn)
    if name == "blackman":
        return 0.42 - 0.5 * np.cos(turn) + 0.08 * np.cos(2 * turn)
    if name in ("bartlett", "triangle"):
        return 1 - np.abs(2 * x / n - 1)
    if name == "welch":
        return 1 - (2 * x / n - 1) ** 2
    if name == "kaiser":
        return np.i0(parameters[0] * np.sqrt(np.clip(1 - (2 * x / n - 1) ** 2, 0, None))) / np.i0(parameters[0])
    if name == "gaussian":
        return np.exp(-0.5 * (centred / parameters[0]) ** 2)
    raise ValueError(f"unknown window {name!r}")


def lanczos(dx: float, width: int, cutoff: float) -> tuple[np.ndarray, float]:
    """Low-pass (b, a) of the Lanczos filter; ``cutoff`` in the units of ``dx``."""
    n = (width - 1) // 2 + 1
    alpha, t = dx / cutoff, np.arange(1, n)
    right = np.sin(2 * np.pi * alpha * t) / (np.pi * t) * np.sinc(t / n)
    return np.concatenate([right[::-1], [2 * alpha], right]), 1.0


def butterworth(dx: float, order: int, cutoff: float, btype: str = "low") -> tuple[np.ndarray, np.ndarray]:
    """Digital (b, a) of order ``order`` - 1: analog poles and the bilinear transform."""
    n, wn = order - 1, 2 * dx / cutoff
    if not 0 < wn < 1:
        raise ValueError("the cutoff must be longer than two steps")
    warped = 4 * np.tan(np.pi * wn / 2)
    k = np.arange(n)
    poles = np.exp(1j * np.pi * (2 * k + n + 1) / (2 * n)) if n else np.zeros(0, complex)
    poles = warped * poles if btype == "low" else warped / poles
    z = (4 + poles) / (4 - poles)
    a = np.real(np.poly(z))
    zeros = -np.ones(n) if btype == "low" else np.ones(n)
    b = np.real(np.poly(zeros))
    at = 1.0 if btype == "low" else -1.0
    return b * (np.polyval(a, at) / np.polyval(b, at)), a


_STENCILS = {
    (1, 0): ({0: -1, 1: 1}, 1), (1, 2): ({-1: -1, 1: 1}, 2), (1, 4): ({-2: 1, -1: -8, 1: 8, 2: -1}, 12),
    (1, 6): ({-3: -1, -2: 9, -1: -45, 1: 45, 2: -9, 3: 1}, 60), (2, 2): ({-1: 1, 0: -2, 1: 1}, 1),
    (2, 4): ({-2: -1, -1: 16, 0: -30, 1: 16, 2: -1}, 12), (2, 6): ({-3: 2, -2: -27, -1: 270, 0: -490, 1: 270, 2: -27, 3: 2}, 180),
    (3, 2): ({-2: -1, -1: 2, 1: -2, 2: 1}, 2), (3, 4): ({-3: 1, -2: -8, -1: 13, 1: -13, 2: 8, 3: -1}, 8),
    (3, 6): ({-4: -7, -3: 72, -2: -338, -1: 488, 1: -488, 2: 338, 3: -72, 4: 7}, 240),
}


def stencil(order: int, accuracy: int) -> dict[int, float]:
    """Weights by offset of a centred difference on even steps of one."""
    weights, scale = _STENCILS[order, accuracy]
    return {k: w / scale for k, w in weights.items()}


def fornberg(x: np.ndarray, x0: float, order: int) -> np.ndarray:
    """Weights at nodes ``x`` for the derivative of ``order`` at ``x0`` (Fornberg 1988)."""
    n = len(x)
    c = np.zeros((n, order + 1))
    c[0, 0], c1 = 1.0, 1.0
    for i in range(1, n):
        c2 = 1.0
        for j in range(i):
            c3 = x[i] - x[j]
            c2 *= c3
            for k in range(min(i, order), -1, -1):
                if j == i - 1:
                    c[i, k] = c1 / c2 * ((k * c[i - 1, k - 1] if k else 0) - (x[i - 1] - x0) * c[i - 1, k])
            for k in range(min(i, order), -1, -1):
                c[j, k] = ((x[i] - x0) * c[j, k] - (k * c[j, k - 1] if k else 0)) / c3
        c1 = c2
    return c[:, order]
