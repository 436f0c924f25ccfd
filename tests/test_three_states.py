"""Rain in three states, and the companions of rain, against plain numpy and by construction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions.special import ndtr
from isohyet.operators import companions as cp
from isohyet.operators import semiparametric as sp


def cube(spark, seasons, months=None):
    rows = [(1, 2000 + y, d, (months or [7] * len(x))[d], None if v is None else float(v)) for y, x in enumerate(seasons) for d, v in enumerate(x)]
    return spark.createDataFrame(rows, "site_id bigint, season_year int, day int, month int, PRCP double")


def weights(spark, ws):
    return spark.createDataFrame([(1, 2000 + y, float(w)) for y, w in enumerate(ws)], "site_id bigint, season_year int, w double")


def test_states_by_hand(spark):
    seasons, w = [[0, 2, 2, 9, 0], [5, 0, 0, None, 3]], [1, 3]
    # Wet amounts 2 2 3 5 9 weigh 1 1 3 3 1: the cumulated weight reaches 0.8 of 9 at 5.
    r = sp.fit_three_states(cube(spark, seasons), weights(spark, w)).first()
    assert r.cutoff == 5
    # Shares of the years: 2/5 dry, 2/5 wet, 1/5 extreme; 2/4, 1/4, 1/4.
    assert np.allclose([r.pi0, r.pi1, r.pi2], [(0.4 + 1.5) / 4, (0.4 + 0.75) / 4, (0.2 + 0.75) / 4])
    assert np.allclose([r.t00, r.t01, r.t02], [0.75, 0.25, 0]) and np.allclose([r.t10, r.t11, r.t12], [0, 0.5, 0.5])
    assert np.allclose([r.t20, r.t21, r.t22], [1, 0, 0]) and [r.n0, r.n1, r.n2] == [2, 2, 2]
    t = np.array([[r[f"t{i}{j}"] for j in range(3)] for i in range(3)])
    s = np.array([r.s0, r.s1, r.s2])
    assert np.allclose(s @ t, s) and np.isclose(s.sum(), 1)


def test_cutoff_by_middles_of_weights(spark):
    days = sp.weighted_days(cube(spark, [[1, 2, 3, 4, 5]]), None)
    for q in (0.05, 0.5, 0.73, 0.95):
        middles = (np.arange(5) + 0.5) / 5
        assert np.isclose(sp.cutoffs(days, 0.1, q, method="hazen").first().cutoff, np.interp(q, middles, np.arange(1, 6)))


def test_states_without_days(spark):
    r = sp.fit_three_states(cube(spark, [[0, 0, 0, 0]])).first()
    assert r.cutoff is None and r.kernels is None and (r.pi0, r.t00, r.s0) == (1, 1, 1) and r.missing1 and r.missing2 and r.t10 == 1
    with pytest.raises(Exception, match="no transition"):
        sp.fit_three_states(cube(spark, [[0, 0, 0, 0]]), missing="error").collect()
    with pytest.raises(Exception, match="negative"):
        sp.fit_three_states(cube(spark, [[0, -1, 0, 0]])).collect()
    # August has no weighted day, so the site has no fit; a pair across months is none.
    assert sp.fit_three_states(cube(spark, [[0, 5, None, None]], [7, 7, 8, 8])).count() == 0
    assert {(x.month, x.n0 + x.n1 + x.n2) for x in sp.fit_three_states(cube(spark, [[0, 5, 5, 0]], [7, 7, 8, 8])).collect()} == {(7, 1), (8, 1)}
    assert sp.fit_three_states(cube(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sp.fit_three_states(cube(spark, [[0, 1]]), quantile=1.0)


def test_kernels_against_numpy(spark):
    rng = np.random.default_rng(4)
    seasons, w = rng.gamma(0.8, 6, (6, 31)).round(2), rng.uniform(0.1, 1, 6)
    days = sp.weighted_days(cube(spark, seasons.tolist()), weights(spark, w))
    rows = sp.with_states(days, sp.cutoffs(days, 0.1), 0.1)
    cut = rows.first().cutoff
    every = np.repeat(w, 31)
    for ddof in (0, 1):
        for kind in ("effective", "resampled"):
            for k in sp.fit_kernels(rows, 0.1, kind, ddof, 50).collect():
                mine = (seasons.ravel() > 0.1) & ((seasons.ravel() < cut) == (k.state == 1))
                x, q = seasons.ravel()[mine], every[mine] / every[mine].sum()
                var = q @ (x - q @ x) ** 2 / ((1 - q @ q) if ddof else 1)
                days_of = ((seasons > 0.1) & ((seasons < cut) == (k.state == 1))).sum(axis=1)
                n = 1 / (q @ q) if kind == "effective" else 50 * (w @ days_of) / w.sum()
                h = 1.06 * np.sqrt(var) * n**-0.2
                low, high = (0.1, cut) if k.state == 1 else (cut, np.inf)
                assert np.isclose(k.bandwidth, h) and sorted(x) == k.centres
                assert np.isclose(k.mismatch, 1 - q @ (ndtr((high - x) / h) - ndtr((low - x) / h)))


def test_simulated_states_follow_the_fit(spark):
    rng = np.random.default_rng(5)
    seasons = np.where(rng.random((20, 31)) < 0.5, 0, rng.gamma(0.8, 6, (20, 31)) + 0.2).tolist()
    params = sp.fit_three_states(cube(spark, seasons), start="stationary")
    sites = spark.createDataFrame([(1, 0.0, 0.0)], "site_id bigint, y double, x double")
    made = sp.simulate_three_states(params, sites, [7] * 31, 300, seed=3)
    a, p = made.toPandas(), params.first()
    assert np.isclose((a.PRCP > 0.1).mean(), p.pi1 + p.pi2, atol=0.02) and np.isclose((a.PRCP >= p.cutoff).mean(), p.pi2, atol=0.02)
    assert not ((a.PRCP > 0) & (a.PRCP <= 0.1)).any()
    # A batch of members agrees with the whole run, whatever the partitions.
    part = sp.simulate_three_states(params, sites.repartition(3), [7] * 31, 10, seed=3, member_start=20).toPandas()
    both = part.merge(a, on=["site_id", "member", "day"])
    assert len(both) == 310 and (both.PRCP_x == both.PRCP_y).all()
    same = sp.fit_three_states(cube(spark, [[0, 4, 4, 0, 4]] * 3))
    assert set(sp.simulate_three_states(same, sites, [7] * 5, 20, by_amount=True).toPandas().PRCP) <= {0.0, 4.0}


N = 40


def panel(spark, years=30, gaps=False):
    rng = np.random.default_rng(9)
    t, rows = np.linspace(-1, 1, N), []
    for y in range(years):
        z = np.zeros(2)
        for d in range(N):
            z = np.array([[0.6, 0.1], [0.0, 0.5]]) @ z + rng.normal(size=2) * 0.7
            wet = bool(rng.random() < 0.4)
            low = 10 - 2 * wet + 3 * t[d] + np.exp(0.3 * t[d]) * z[0]
            rows.append((1, 2000 + y, d, 7 if d < 20 else 8, 5.0 * wet, None if gaps and d % 7 == 0 else float(low), float(low + 12 + abs(z[1]))))
    return spark.createDataFrame(rows, "site_id bigint, season_year int, day int, month int, PRCP double, TMIN double, TMAX double")


def test_curves_against_least_squares(spark):
    frame = panel(spark, gaps=True)
    a = frame.toPandas()
    w = {2000 + y: 0.2 + y % 3 for y in range(30)}
    ws = spark.createDataFrame([(1, y, float(v)) for y, v in w.items()], "site_id bigint, season_year int, w double")
    rows = cp.latent_panel(frame, ("TMIN", "TMAX"), ws)
    found = cp.fit_curves(rows, N).toPandas().set_index(["variable", "state", "day"]).sort_index()
    t = np.linspace(-1, 1, N)
    for v in ("TMIN", "TMAX"):
        for state in (0, 1):
            part = a[(a.PRCP >= 1) == state].dropna(subset=[v])
            root = np.sqrt(part.season_year.map(w).to_numpy())
            x = np.stack([np.ones(len(part)), t[part.day], t[part.day] ** 2], axis=1)
            c = np.linalg.lstsq(x * root[:, None], part[v].to_numpy() * root, rcond=None)[0]
            got = found.loc[v, state]
            assert np.allclose(got["mean"], c[0] + c[1] * t + c[2] * t * t)
            # Together the curve's variances are the weighted variance of the deviations.
            assert np.isclose(np.average(got["sd"].to_numpy()[part.day] ** 2, weights=root**2), np.average((part[v] - x @ c) ** 2, weights=root**2))


def test_rare_states_take_all_days(spark):
    rows = [(1, 2000 + y, d, 7, 0.0 if d or y else 3.0, 5.0, None) for y in range(2) for d in range(6)]
    frame = spark.createDataFrame(rows, "site_id bigint, season_year int, day int, month int, PRCP double, WIND double, SOLAR double")
    found = cp.fit_curves(cp.latent_panel(frame, ("WIND", "SOLAR")), 6).toPandas()
    assert set(found.variable) == {"WIND"} and dict(found.groupby("state").pooled.first()) == {0: False, 1: True}
    assert np.allclose(found["mean"], np.log(6)) and np.allclose(found["sd"], 0)
    empty = frame.where("false")
    assert cp.fit_curves(cp.latent_panel(empty, ("WIND",)), 6).count() == 0
    with pytest.raises(Exception, match="TMIN above TMAX"):
        cp.latent_panel(panel(spark, 1).withColumn("TMIN", F.lit(99.0)), ("TMIN", "TMAX")).collect()


def test_dependence_and_simulation(spark):
    rows = cp.latent_panel(panel(spark), ("TMIN", "TMAX"))
    curves = cp.fit_curves(rows, N)
    left = cp.residuals(rows, curves)
    fit = cp.fit_dependence(left, ("TMIN", "TMAX"), [7, 8])
    for r in fit.collect():
        a, root, first = (np.array(r[k]) for k in ("transition", "innovation", "initial"))
        assert r.source == "monthly" and np.abs(np.linalg.eigvals(a)).max() < 0.981
        s = first @ first.T
        assert np.allclose(a @ s @ a.T + root @ root.T, s, atol=1e-8) and np.allclose(np.diag(s), 1)
    e = cp.innovations(left, fit).toPandas().pivot(index=["season_year", "day"], columns="variable", values="e")
    assert len(e) == 30 * (N - 1) and np.allclose(np.cov(e.T), np.eye(2), atol=0.15)
    sites = spark.createDataFrame([(1, 0.0, 0.0)], "site_id bigint, y double, x double")
    months = [7] * 20 + [8] * 20
    latent = cp.simulate_latent(fit, sites, months, 400, seed=2)
    z = latent.toPandas().pivot(index=["member", "day"], columns="variable", values="z")
    assert np.allclose(z.groupby("day").std(), 1, atol=0.15)
    lag = z.TMIN.unstack("day")
    seen = left.where("variable = 'TMIN'").toPandas().pivot(index="season_year", columns="day", values="z")
    assert np.isclose(np.corrcoef(lag[30], lag[31])[0, 1], np.nanmean(seen.to_numpy()[:, 21:-1] * seen.to_numpy()[:, 22:]), atol=0.12)
    rain = latent.where("variable = 'TMIN'").select("site_id", "member", "day", F.when(F.col("member") == 0, None).otherwise((F.col("day") % 2 * 4).cast("double")).alias("PRCP"))
    out = cp.simulate_companions(latent, curves, rain, ("TMIN", "TMAX")).toPandas()
    assert len(out) == 400 * N and out[out.member == 0].TMIN.isna().all() and (out.TMIN.dropna() <= out.TMAX.dropna()).all()
    mean = out[out.member > 0].groupby("day").TMIN.mean()
    want = curves.where("variable = 'TMIN'").toPandas().pivot(index="day", columns="state", values="mean")
    assert np.allclose(mean, [want.loc[d, d % 2] for d in range(N)], atol=0.25)


def test_short_records_have_variables_of_their_own(spark):
    rows = cp.latent_panel(panel(spark, 1).where("day < 9"), ("TMIN", "TMAX"))
    fit = cp.fit_dependence(cp.residuals(rows, cp.fit_curves(rows, 9)), ("TMIN", "TMAX"), [7]).first()
    assert fit.source == "single" and fit.transition[0][1] == 0 and fit.innovation[1][0] == 0
