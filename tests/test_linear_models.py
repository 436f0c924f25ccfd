"""Linear models against data made from known coefficients, and fields against direct conditioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions.special import gammaincinv, ndtr
from isohyet.operators import linear_models as lm
from isohyet.operators import rainfall as rf
from isohyet.operators import season as s

RNG = np.random.default_rng(11)
X = np.column_stack([np.ones(4000), RNG.normal(size=(4000, 2))])


def test_probit():
    b = np.array([-0.3, 0.8, 0.0])
    y = (RNG.random(4000) < ndtr(X @ b)).astype(float)
    got, cov = lm.fit_probit(X, y)
    p, density = lm.gaps(X @ got)
    assert np.abs(X.T @ ((y - p) * density / (p * (1 - p)))).max() < 0.01  # the score is nought at the maximum, but for the ridge
    assert np.all(np.abs(got - b) < 4 * np.sqrt(np.diag(cov)))
    assert np.isfinite(lm.fit_probit(X, np.ones(4000))[0]).all()


@pytest.mark.parametrize("shape", [0.7, 3.0])
def test_gamma(shape):
    b = np.array([1.0, 0.4, -0.2])
    u = RNG.random(4000)
    y = gammaincinv(shape, u) / shape * np.exp(X @ b)
    got, cov, k, spread = lm.fit_gamma_log(X, y)
    assert np.all(np.abs(got - b) < 4 * np.sqrt(np.diag(cov))) and abs(np.log(k / shape)) < 4 * np.sqrt(spread)
    seen = y > 1.5
    cut, _, k1, _ = lm.fit_gamma_truncated(X[seen], y[seen], 1.5)
    assert np.allclose(cut, b, atol=0.15) and abs(np.log(k1 / shape)) < 0.4
    with pytest.raises(ValueError):
        lm.fit_gamma_truncated(X, y, 0.0)


def test_linear():
    wet = (RNG.random(4000) < 0.3).astype(int)
    y = X @ [2.0, 1.0, -1.0] + RNG.normal(size=4000) * np.where(wet, 2.0, 0.5)
    b, _, sd = lm.fit_linear(X, y, wet)
    assert np.allclose(b, np.linalg.lstsq(X, y, rcond=None)[0], atol=1e-6) and np.allclose(sd, [0.5, 2.0], rtol=0.1)
    assert np.allclose(lm.fit_linear(X, y, wet * 0)[2][1], np.std(y - X @ b), rtol=1e-3)


def test_fits_and_seasons(spark):
    rows, rng = [], np.random.default_rng(3)
    dates = [r.t for r in s.season_calendar(spark, (2001, 2001), (7, 8)).orderBy("day").collect()]
    for y in range(2001, 2041):
        z, lag = rng.normal(), 0
        for d, t in enumerate(dates):
            lag = int(rng.random() < ndtr(-0.5 + 0.6 * lag + 0.4 * z))
            rows.append((1, y, d, t, 7, float(lag * (1 + rng.gamma(2.0) * np.exp(0.3 * z))), 20.0 - 4 * lag + rng.normal(), z))
    frame = spark.createDataFrame(rows, "site_id bigint, season_year int, day int, t date, month int, PRCP double, TMIN double, z double")
    fits = lm.fit_models(frame.drop("z"), frame.select("site_id", "season_year", "z").distinct(), ("TMIN",), harmonics=0)
    got = {r.model: r for r in fits.collect()}
    assert np.allclose(got["occurrence"].coefficients, [-0.5, 0.6, 0.4, 0.0], atol=0.2)
    assert np.allclose(got["amount"].coefficients, [np.log(2), 0, 0.3], atol=0.15) and abs(got["amount"].extra[0] - 2) < 0.4
    assert np.allclose(got["TMIN"].coefficients, [20, -4, 0, 0], atol=1.5) and np.allclose(got["TMIN"].extra[:2], 1, atol=0.1)
    sites = spark.createDataFrame([(1, 0.0, 0.0)], "site_id bigint, y double, x double")
    prob = spark.createDataFrame([(1, 0.1, 0.2, 0.7)], "site_id bigint, pb double, pn double, pa double")
    scores = lm.season_scores(prob, sites, 100)
    season = s.season_calendar(spark, (2001, 2001), (7, 8)).select("day", "t")
    made = lm.simulate_models(fits, scores, sites, season, 100, ("TMIN",), harmonics=0)
    a = made.toPandas().merge(scores.toPandas(), on=["site_id", "member"])
    assert len(a) == 100 * 62 and a.z.mean() > 0.3 and not ((a.PRCP > 0) & (a.PRCP < 1)).any()
    assert abs(a[a.PRCP == 0].TMIN.mean() - a[a.PRCP > 0].TMIN.mean() - 4) < 0.3
    by = a.groupby("member").agg(wet=("PRCP", lambda v: (v > 0).mean()), z=("z", "first"))
    assert np.corrcoef(by.wet, by.z)[0, 1] > 0.8
    few = frame.where("season_year < 2003")
    assert lm.fit_models(few.drop("z"), few.select("site_id", "season_year", "z").distinct()).count() == 0
    totals = frame.groupBy("site_id", "season_year").agg(F.sum("PRCP").alias("total"))
    assert lm.transmission(made, scores, totals).first().slope > 0.5


def test_smoothing(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "occurrence", [float(1.0 + 0.3 * np.sin(i / 3) + 0.05 * rng.normal())], [0.0025], [0.5], 10) for i in range(20)]
    fits = spark.createDataFrame(rows, "site_id bigint, model string, coefficients array<double>, variances array<double>, extra array<double>, n int")
    sites = spark.createDataFrame([(i, i / 5, 0.0) for i in range(20)], "site_id bigint, y double, x double")
    got = lm.smooth_coefficients(fits, sites).orderBy("site_id").toPandas()
    km = lm.fields.position(np.arange(20) / 5, np.zeros(20))
    km = np.linalg.norm(km[:, None] - km[None], axis=-1)
    tau2, rho, level = got[["tau2", "rho", "level"]].iloc[0]
    k = tau2 * np.exp(-km / rho)
    b = np.array([r[2][0] for r in rows])
    assert np.allclose(got["mean"], level + k @ np.linalg.solve(k + 0.0025 * np.eye(20), b - level))
    assert np.allclose(got["variance"], np.diag(k - k @ np.linalg.solve(k + 0.0025 * np.eye(20), k)), atol=1e-9)
    truth = 1.0 + 0.3 * np.sin(np.arange(20) / 3)
    assert np.mean((got["mean"] - truth) ** 2) < np.mean((b - truth) ** 2)
    assert lm.with_smoothed(fits, lm.smooth_coefficients(fits, sites)).count() == 20
    with pytest.raises(ValueError, match="more than 5 sites"):
        lm.smooth_coefficients(fits, sites, most=5)


def test_forecast_plane(spark):
    rng = np.random.default_rng(6)
    cat = {2000 + y: y % 3 for y in range(30)}
    data = [(1, y, d, 7, float(rng.exponential(4 + 4 * c) if rng.random() < 0.6 else 0.0)) for y, c in cat.items() for d in range(31)]
    cube = spark.createDataFrame(data, "site_id bigint, season_year int, day int, month int, PRCP double")
    cats = spark.createDataFrame([(1, y, c) for y, c in cat.items()], "site_id bigint, season_year int, cat int")
    prob = lambda *p: spark.createDataFrame([(1, *p)], "site_id bigint, pb double, pn double, pa double")
    half = spark.createDataFrame([(7, 1.0)], "month int, alpha double")
    got = rf.forecast_plane(cube, cats, prob(0.2, 0.3, 0.5), alphas=half).first()
    # With one exponential the mean is the weighted mean, which is a ratio of linear functions of the forecast.
    x, c = np.array([r[4] for r in data]), np.array([cat[r[1]] for r in data])
    grid = [(i / 2, j / 2, 1 - i / 2 - j / 2) for i in range(3) for j in range(3 - i)]
    means = [np.average(x[x > 0], weights=np.array(q)[c][x > 0]) for q in grid]
    plane = np.linalg.lstsq(np.array([(1, q[0], q[2]) for q in grid]), np.array(means), rcond=None)[0]
    assert np.allclose(got.plane1, plane, rtol=1e-3) and np.isclose(got.beta1, plane @ [1, 0.2, 0.5], rtol=1e-3)
    low, high = (rf.forecast_plane(cube, cats, prob(*p)).first() for p in ((0.8, 0.1, 0.1), (0.1, 0.1, 0.8)))
    assert np.isclose(low.alpha, high.alpha) and low.alpha * low.beta1 + (1 - low.alpha) * low.beta2 < high.alpha * high.beta1 + (1 - high.alpha) * high.beta2
    assert np.isclose(rf.domain_alphas(cube).first().alpha, low.alpha)
    assert rf.forecast_plane(cube, cats.where("cat < 2"), prob(0.2, 0.3, 0.5)).count() == 0
    assert rf.forecast_plane(cube, cats, prob(None, 0.3, 0.5)).count() == 0
    with pytest.raises(ValueError):
        rf.forecast_plane(cube, cats, prob(0.2, 0.3, 0.5), resolution=9)
