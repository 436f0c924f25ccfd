"""Special functions and small solvers on numpy arrays, for fits that run inside a group of rows.

Groups are one site's or one month's values, so everything here is bounded by a
record's length; nothing depends on packages beyond numpy.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .scalar import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D

#: Lanczos coefficients (g = 7, nine terms) and Bernoulli terms of the digamma and trigamma series.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
DIGAMMA_SERIES = (-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132)
TRIGAMMA_SERIES = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)

_erfc = np.frompyfunc(math.erfc, 1, 1)


def ndtr(x) -> np.ndarray:
    """Distribution function of the standard normal."""
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def log_ndtr(x) -> np.ndarray:
    x = np.asarray(x, float)
    far = x < -20
    z = np.where(far, x, -20.0) ** -2
    tail = -np.where(far, x, 0.0) ** 2 / 2 - np.log(np.where(far, -x, 1.0)) - 0.5 * math.log(2 * math.pi) + np.log1p(-z + 3 * z**2 - 15 * z**3 + 105 * z**4)
    return np.where(far, tail, np.log(np.maximum(ndtr(np.where(far, 0.0, x)), 1e-300)))


def ndtri(p) -> np.ndarray:
    """Quantile of the standard normal: a rational approximation, then two steps of Halley's method."""
    p = np.asarray(p, float)
    q = np.where((p > 0) & (p < 1), p, 0.5)
    low = np.minimum(q, 1 - q)
    t = np.sqrt(-2 * np.log(low))
    tail = np.polyval(ACKLAM_C, t) / (np.polyval(ACKLAM_D, t) * t + 1)
    r = q - 0.5
    middle = np.polyval(ACKLAM_A, r * r) * r / (np.polyval(ACKLAM_B, r * r) * r * r + 1)
    x = np.where(low < 0.02425, np.where(q < 0.5, tail, -tail), middle)
    for _ in range(2):
        # Measured in the nearer tail, so that no digits cancel.
        error = np.where(x < 0, ndtr(x) - q, (1 - q) - ndtr(-x)) * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
        x = x - error / (1 + x * error / 2)
    return np.where(p <= 0, np.where(p == 0, -np.inf, np.nan), np.where(p >= 1, np.where(p == 1, np.inf, np.nan), x))


def gammaln(x) -> np.ndarray:
    x = np.asarray(x, float) - 1
    total = LANCZOS[0] + sum(c / (x + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(total)


def digamma(x) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    for _ in range(8):  # up to where the series is exact
        out, x = out - 1 / x, x + 1
    z = x**-2
    return out + np.log(x) - 0.5 / x + sum(c * z ** (k + 1) for k, c in enumerate(DIGAMMA_SERIES))


def trigamma(x) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        out, x = out + x**-2, x + 1
    z = x**-2
    return out + 1 / x + z / 2 + sum(c * z ** (k + 1) for k, c in enumerate(TRIGAMMA_SERIES)) / x


def gammainc(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma function: the series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 0.0)
    front = np.exp(np.where(x > 0, a * np.log(np.where(x > 0, x, 1.0)) - x - gammaln(a), -np.inf))
    low = x < a + 1
    term = total = 1 / a
    for n in range(1, 2000):
        term = term * np.where(low, x, 0.0) / (a + n)
        total = total + term
        if np.all(np.abs(term) <= 1e-16 * np.abs(total)):
            break
    y = np.where(low, a + 2, x)
    b, tiny = y + 1 - a, 1e-300
    c, d = np.full_like(b, 1 / tiny), 1 / b
    h = d
    for n in range(1, 2000):
        an = -n * (n - a)
        b = b + 2
        d = 1 / np.where(np.abs(an * d + b) < tiny, tiny, an * d + b)
        c = np.where(np.abs(b + an / c) < tiny, tiny, b + an / c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.where(low, front * total, 1 - np.exp(np.where(low, -np.inf, a * np.log(y) - y - gammaln(a))) * h)


def gammaincc(a, x) -> np.ndarray:
    return 1 - gammainc(a, x)


def gammaincinv(a, p) -> np.ndarray:
    """x with gammainc(a, x) = p: Newton steps in ln x from the cube-root approximation, kept between bisected bounds."""
    a, p = np.broadcast_arrays(np.asarray(a, float), np.asarray(p, float))
    inside = (p > 0) & (p < 1)
    q = np.where(inside, p, 0.5)
    lo, hi = np.full(q.shape, -745.0), np.log(a + 40 * np.sqrt(a) + 800)
    cube = 1 - 1 / (9 * a) + ndtri(q) / (3 * np.sqrt(a))
    y = np.where(cube > 0.1, np.log(a) + 3 * np.log(np.maximum(cube, 0.1)), (np.log(q) + gammaln(a + 1)) / a)
    y = np.clip(y, lo + 1e-9, hi - 1e-9)
    for _ in range(80):
        off = gammainc(a, np.exp(y)) - q
        lo, hi = np.where(off > 0, lo, y), np.where(off > 0, y, hi)
        slope = np.exp(np.maximum(a * y - np.exp(y) - gammaln(a), -700))
        step = y - off / slope
        new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        done = np.abs(new - y) < 1e-14 * np.maximum(1, np.abs(y))
        y = new
        if done.all():
            break
    return np.where(inside, np.exp(y), np.where(p <= 0, 0.0, np.inf))


def gammainccinv(a, p) -> np.ndarray:
    return gammaincinv(a, 1 - np.asarray(p, float))


def logsumexp(x, axis=None, keepdims=False) -> np.ndarray:
    x = np.asarray(x, float)
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return out if keepdims else np.squeeze(out, axis=axis)


def softmax(x, axis=-1) -> np.ndarray:
    return np.exp(x - logsumexp(x, axis=axis, keepdims=True))


def expit(x) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def logit(p) -> np.ndarray:
    return np.log(p) - np.log1p(-np.asarray(p, float))


def xlogy(x, y) -> np.ndarray:
    x = np.asarray(x, float)
    return np.where(x == 0, 0.0, x * np.log(np.where(x == 0, 1.0, y)))


def safe_cholesky(matrix: np.ndarray) -> np.ndarray:
    """A lower root of the nearest positive matrix: eigenvalues below 1e-10 of the largest are lifted to it."""
    symmetric = (matrix + matrix.T) / 2
    try:
        return np.linalg.cholesky(symmetric)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(symmetric)
        lifted = np.maximum(values, max(values.max(), 1e-12) * 1e-10)
        return np.linalg.qr((vectors * np.sqrt(lifted)).T)[1].T


def bfgs(f: Callable, x0: np.ndarray, *, steps: int = 200, tol: float = 1e-8) -> tuple[np.ndarray, float, bool]:
    """Quasi-Newton minimum of f, which returns (value, gradient); backtracking line search.  (x, value, converged)."""
    x = np.array(x0, float)
    value, gradient = f(x)
    inverse = np.eye(len(x))
    for _ in range(steps):
        if np.abs(gradient).max() < tol:
            return x, value, True
        direction = -inverse @ gradient
        slope = gradient @ direction
        if slope >= 0:
            inverse, direction = np.eye(len(x)), -gradient
            slope = gradient @ direction
        size = 1.0
        for _ in range(50):
            new, slopes = f(x + size * direction)
            if np.isfinite(new) and new <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return x, value, False
        move, change = size * direction, slopes - gradient
        x, value, gradient = x + move, new, slopes
        if (curve := move @ change) > 1e-12:
            r = np.eye(len(x)) - np.outer(move, change) / curve
            inverse = r @ inverse @ r.T + np.outer(move, move) / curve
    return x, value, bool(np.abs(gradient).max() < tol)


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, *, tol: float = 1e-10) -> np.ndarray:
    """The x >= 0 that brings a x next to b, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    free, x = np.zeros(n, bool), np.zeros(n)
    for _ in range(10 * n + 10):
        pull = a.T @ (b - a @ x)
        pull[free] = -np.inf
        k = int(np.argmax(pull))
        if pull[k] <= tol * max(1.0, float(np.abs(a.T @ b).max())):
            break
        free[k] = True
        while free.any():
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if z[free].min() > 0:
                x = z
                break
            low = free & (z <= 0)
            x = x + np.min(x[low] / np.maximum(x[low] - z[low], 1e-300)) * (z - x)
            free &= x > 1e-14
            x[~free] = 0
    return x


def weighted_gamma_mle(x: np.ndarray, w: np.ndarray) -> tuple[float, float, int]:
    """(shape, scale, status) of positive x with weights w.  Status 0: solved; 1: nearly constant, shape 1e6; 2: no
    positive amount; 3: exponential where the equation could not be solved."""
    use = np.isfinite(x) & (x > 0) & (w > 0)
    if not use.any():
        return 1.0, 1.0, 2
    x, w = x[use], w[use] / w[use].sum()
    mean = float(w @ x)
    gap = max(math.log(mean) - float(w @ np.log(x)), 0.0)
    if gap <= 5e-7:
        return 1e6, mean / 1e6, 1
    # ln k - digamma(k) falls in k, so its root is solved in ln k, from the leading terms of its series.
    k = (1 + math.sqrt(1 + 4 * gap / 3)) / (4 * gap)
    for _ in range(60):
        step = (math.log(k) - float(digamma(k)) - gap) / (1 - k * float(trigamma(k)))
        k *= math.exp(-max(-2.0, min(2.0, step)))
        if abs(step) < 1e-13:
            break
    if not math.isfinite(k) or abs(math.log(k) - float(digamma(k)) - gap) > 1e-7 * (1 + gap):
        return 1.0, mean, 3
    return k, mean / k, 0
