"""Special functions against published values, identities and numerical integration."""

import math

import numpy as np
import pytest

from isohyet.functions import special as sp


def test_normal_distribution():
    assert sp.ndtr([0.0, 1.959963984540054, -8.0]) == pytest.approx([0.5, 0.975, 6.220960574271786e-16], rel=1e-12)
    p = np.array([1e-12, 1e-5, 0.02, 1 / 3, 0.5, 0.9, 1 - 1e-9])
    assert sp.ndtr(sp.ndtri(p)) == pytest.approx(p, rel=1e-9)
    assert sp.ndtri([0.0, 1.0]).tolist() == [-np.inf, np.inf] and np.isnan(sp.ndtri(1.5))
    assert sp.log_ndtr([-40.0, 0.0]) == pytest.approx([-804.608442013754, math.log(0.5)], rel=1e-9)


def test_gamma_functions():
    x = np.array([0.1, 0.5, 1.0, 3.7, 50.0])
    assert sp.gammaln(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-11)
    h = 1e-5
    assert sp.digamma(x) == pytest.approx([(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x], rel=1e-5)
    assert sp.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12) and sp.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-11)


def test_incomplete_gamma_and_its_inverse():
    assert sp.gammainc(1.0, 2.0) == pytest.approx(1 - math.exp(-2)) and sp.gammainc(0.5, 0.5) == pytest.approx(math.erf(math.sqrt(0.5)))
    a, p = np.meshgrid([0.05, 0.3, 1.0, 2.5, 40.0, 1e4], [1e-8, 0.01, 0.4, 0.9, 1 - 1e-7])
    assert sp.gammainc(a, sp.gammaincinv(a, p)) == pytest.approx(p, rel=1e-7)
    assert sp.gammaincc(2.0, sp.gammainccinv(2.0, 0.3)) == pytest.approx(0.3)
    assert sp.gammaincinv(2.0, [0.0, 1.0]).tolist() == [0.0, np.inf]


def test_sums_of_exponentials():
    assert sp.logsumexp([1000.0, 1000.0]) == pytest.approx(1000 + math.log(2)) and sp.logsumexp([-np.inf, -np.inf]) == -np.inf
    assert sp.softmax(np.array([1.0, 2.0])).sum() == pytest.approx(1) and sp.expit(sp.logit(0.3)) == pytest.approx(0.3)
    assert sp.xlogy([0.0, 2.0], [0.0, 3.0]) == pytest.approx([0.0, 2 * math.log(3)])


def test_gamma_fit_is_the_likelihoods_maximum():
    rng = np.random.default_rng(1)
    x, w = rng.gamma(1.7, 4.0, 400), rng.random(400)
    shape, scale, status = sp.weighted_gamma_mle(x, w)
    ll = lambda k, t: float(w @ ((k - 1) * np.log(x) - x / t - k * math.log(t) - math.lgamma(k)))
    best = ll(shape, scale)
    assert status == 0 and all(best >= ll(shape * a, scale * b) for a in (0.99, 1, 1.01) for b in (0.99, 1, 1.01))
    assert sp.weighted_gamma_mle(np.full(5, 3.0), np.ones(5)) == (1e6, pytest.approx(3e-6), 1) and sp.weighted_gamma_mle(np.zeros(3), np.ones(3))[2] == 2


def test_solvers():
    x, value, ok = sp.bfgs(lambda v: (float((1 - v[0]) ** 2 + 100 * (v[1] - v[0] ** 2) ** 2), np.array([-2 * (1 - v[0]) - 400 * v[0] * (v[1] - v[0] ** 2), 200 * (v[1] - v[0] ** 2)])), np.array([-1.2, 1.0]))
    assert ok and x == pytest.approx([1, 1], abs=1e-5)
    a = np.array([[1.0, 1.0, 1.0], [1.0, 0.0, 0.0]])
    assert a @ sp.nonnegative_least_squares(a, np.array([1.0, 0.3])) == pytest.approx([1.0, 0.3])
    m = np.array([[1.0, 0.9, 0.9], [0.9, 1.0, 0.9], [0.9, 0.9, 1.0]])
    assert sp.safe_cholesky(m) @ sp.safe_cholesky(m).T == pytest.approx(m)
    low = np.ones((3, 3))
    assert sp.safe_cholesky(low) @ sp.safe_cholesky(low).T == pytest.approx(low, abs=1e-5)
