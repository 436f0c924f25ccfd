"""Hand-made cases, one rule each."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions import scalar
from isohyet.operators import conditioning as c
from isohyet.operators import constraints as k
from isohyet.operators import dynamical as dy
from isohyet.operators import fields as fl
from isohyet.operators import hindcast as h
from isohyet.operators import rainfall as rf
from isohyet.operators import resampling as r
from isohyet.operators import season as s


def season(spark, rain, start="2001-07-01", site=1):
    d = datetime.date.fromisoformat(start)
    return spark.createDataFrame([(site, d + datetime.timedelta(i), None if v is None else float(v)) for i, v in enumerate(rain)], "site_id bigint, t date, PRCP double")


def cube(spark, seasons, months=None):
    rows = [(1, 2000 + y, d, (months or [7] * len(x))[d], None if v is None else float(v)) for y, x in enumerate(seasons) for d, v in enumerate(x)]
    return spark.createDataFrame(rows, "site_id bigint, season_year int, day int, month int, PRCP double")


@pytest.mark.parametrize("rain", [[0.0] * 10, [5.0] * 10, [3.0, 3.0, 3.0, 4.0, 3.0]])
def test_seasons_without_variance(spark, rain):
    row = s.weather_statistics(cube(spark, [rain]), len(rain)).first()
    assert row.lag1_occurrence is None and (row.lag1_amount is None) == (len(set(rain)) == 1) and row.total == sum(rain)


def onset_of(spark, rain):
    return s.onset(season(spark, rain, "2001-05-01"), (2001, 2001)).first()


def test_onset_check_begins_on_the_next_day(spark):
    dry_after = [0.0] * 5 + [30.0] + [0.0] * 8 + [8.0] * 200
    # Days 6 to 13 are a spell of 8 in the 30 days after days 3 to 5; three days bring 20 mm again from day 14 on.
    assert onset_of(spark, dry_after).value == 14
    assert onset_of(spark, [0.0] * 5 + [30.0] + [0.0] * 7 + [5.0] * 200).value == 3  # its three days hold the 30 mm, 7 dry days are allowed
    none = onset_of(spark, [0.0] * 220)
    assert none.value == 153 and none.event_observed == 0


def test_onset_and_gaps(spark):
    base = [0.0] * 5 + [30.0] + [5.0] * 210
    late = list(base)
    late[100] = None
    assert onset_of(spark, late).value == 3
    early = list(base)
    early[2] = None
    assert onset_of(spark, early).value is None
    inside = list(base)
    inside[20] = None
    assert onset_of(spark, inside).value is None


def test_any_rain_goes_against_cessation(spark):
    drizzle = s.cessation_by_rain(season(spark, [0.5] * 120, "2001-09-01"), (2001, 2001)).first()
    assert drizzle.value == 91 and drizzle.event_observed == 0
    assert s.cessation_by_rain(season(spark, [0.5] * 10 + [0.0] * 110, "2001-09-01"), (2001, 2001)).first().value == 9
    gap = [0.5] * 10 + [0.0] * 5 + [None] + [0.0] * 104
    assert s.cessation_by_rain(season(spark, gap, "2001-09-01"), (2001, 2001)).first().value is None


def test_year_weights_flags(spark):
    cats = spark.createDataFrame([(1, 2000 + i, x) for i, x in enumerate([0, 0, 1, 2, -1])] + [(2, 2000, 0), (2, 2001, 0), (3, 2000, -1), (4, 2000, 1)], "site_id bigint, season_year int, cat int")
    prob = spark.createDataFrame([(1, 0.2, 0.3, 0.5), (2, 0.2, 0.3, 0.5), (3, 0.2, 0.3, 0.5), (4, None, None, None), (5, 0.2, 0.3, 0.5)], "site_id bigint, pb double, pn double, pa double")
    got = {(x.site_id, x.season_year): (round(x.w, 6), x.flags) for x in c.year_weights(cats, prob).collect()}
    assert got[1, 2000] == (0.1, 0) and got[1, 2003] == (0.5, 0) and got[1, 2004] == (0.0, 0)
    assert got[2, 2000] == (0.5, c.EMPTY) and got[3, 2000] == (0.0, c.NO_HISTORY) and got[4, 2000] == (0.0, c.INVALID) and got[5, None] == (0.0, c.NO_HISTORY)
    assert {x.w for x in c.year_weights(cats, prob, "renormalize").where("site_id = 2").collect()} == {0.5}
    with pytest.raises(Exception, match="no years"):
        c.year_weights(cats, prob, "raise").collect()


def test_scores_need_three_reference_years(spark):
    rows = spark.createDataFrame([(1, 2000, 5.0), (1, 2001, -1.0), (1, 2002, 7.0), (2, 2000, 0.0), (2, 2001, 0.0), (2, 2002, 4.0), (2, 2010, 9.0)], "site_id bigint, season_year int, total double")
    got = {(x.site_id, x.season_year): x.z for x in c.normal_scores(rows, (2000, 2005)).collect()}
    assert got[1, 2000] is None and got[1, 2001] is None and got[2, 2000] == got[2, 2001] == pytest.approx(-0.3186393639, abs=1e-6) and got[2, 2010] == pytest.approx(1.1503493804, abs=1e-6)


def test_tercile_normal_meets_its_tails(spark):
    prob = spark.createDataFrame([(1, 0.2, 0.3, 0.5), (2, 1.0, 0.0, 0.0), (3, None, None, None)], "site_id bigint, pb double, pn double, pa double")
    got = {x.site_id: x for x in c.tercile_normal(prob).collect()}
    from isohyet.functions.special import ndtr

    z = c.UPPER_TERCILE
    assert ndtr((-z - got[1].mu) / got[1].sigma) == pytest.approx(0.2, abs=1e-6) and 1 - ndtr((z - got[1].mu) / got[1].sigma) == pytest.approx(0.5, abs=1e-6)
    assert got[2].sigma == pytest.approx(0.51, abs=0.02) and got[3].mu is None


def test_units_and_latent_scale(spark):
    one = spark.range(1)
    take = lambda col: one.select(col.alias("v")).first().v
    assert take(scalar.to_canonical("WIND", F.lit(1.0), F.lit("Knots"))) == 0.5144444444444445
    assert take(scalar.to_canonical("PRCP", F.lit(1.0), F.lit("kg m**-2 d-1"))) == 1.0 and take(scalar.to_canonical("TMIN", F.lit(32.0), F.lit("Fahrenheit"))) == pytest.approx(0)
    for bad in (lambda: take(scalar.to_latent("WIND", F.lit(-1.0))), lambda: take(scalar.to_canonical("WIND", F.lit(1.0), F.lit("beaufort")))):
        with pytest.raises(Exception, match="negative|unknown unit"):
            bad()
    assert take(scalar.normal_cdf(F.lit(1.959963984540054))) == pytest.approx(0.975, abs=1e-12) and take(scalar.log_normal_cdf(F.lit(-40.0))) == pytest.approx(-804.608442, rel=1e-6)


def test_rank_histogram_has_all_ranks_and_complete_cases(spark):
    e = spark.createDataFrame([(i, m, float(v) if v is not None else None) for i, x in enumerate([[1, 2, 3], [1, 2, None], [5, 5, 9]]) for m, v in enumerate(x)], "case int, member int, value double")
    o = spark.createDataFrame([(0, 4.0), (1, 4.0), (2, 5.0)], "case int, observed double")
    assert {x["rank"]: x.share for x in c.rank_histogram(e, o, ["case"], 3).collect()} == {0: pytest.approx(1 / 3), 1: pytest.approx(1 / 3), 2: pytest.approx(1 / 3), 3: 1.0}
    assert sum(x.share for x in c.rank_histogram(e, o, ["case"], 3, "random").collect()) == 2


def test_distances_are_chords(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 180.0), (3, 90.0, 5.0)], "site_id bigint, y double, x double")
    got = {(x.a, x.b): x.km for x in c.site_distances(rows).collect()}
    assert got[1, 2] == pytest.approx(2 * c.EARTH_KM) and got[1, 3] == pytest.approx(2**0.5 * c.EARTH_KM)


def test_constraint_weights_against_a_direct_minimum():
    rng = np.random.default_rng(3)
    cats = rng.integers(0, 3, (12, 2))
    g = np.concatenate([(cats[:, [j]] == np.arange(3)).astype(float) for j in range(2)], axis=1)
    t, w0 = np.array([0.2, 0.3, 0.5, 0.5, 0.3, 0.2]), np.full(12, 1 / 12)
    for method in ("mre", "croley"):
        tau = np.full(6, 0.05)
        w, ok = k.solve_site(g, t, w0, tau, method)
        cost = lambda v: (float(np.sum(v * np.log(np.maximum(v, 1e-300) / w0))) if method == "mre" else 6 * float(((v - w0) ** 2).sum())) + float((((v @ g - t) / 0.05) ** 2).sum()) / 2  # noqa: E731,B023
        assert ok and w.sum() == pytest.approx(1) and (w >= 0).all()
        for _ in range(200):  # no nearby distribution does better
            step = rng.normal(size=12) * 1e-3 * (w > 1e-9)
            near = np.maximum(w + step - step.sum() * (w > 1e-9) / max(1, (w > 1e-9).sum()), 0)
            assert cost(near / near.sum()) >= cost(w) - 1e-7
        exact, _ = k.solve_site(g, t, w0, tau, method, "exact")
        assert exact @ g == pytest.approx(t, abs=1e-5)
    with pytest.raises(ValueError, match="no weights"):
        k.solve_site(g[:, :3] * 0, t[:3], w0, np.full(3, 0.1), "mre", "exact")


def test_training_years():
    years = list(range(2000, 2012))
    assert h.training_years(years, 2003, "loyo", 1) == [2000, 2001, *range(2005, 2012)] and h.training_years(years, 2003, "past_only", 1) == [2000, 2001]
    assert h.training_years(years, 2003, "block", 0, 6) == list(range(2006, 2012)) and h.training_years(years, 2003, "in_sample") == years
    assert len(h.folds(years, "block", 0, 6)) == 2
    with pytest.raises(ValueError):
        h.training_years(years, 1990)


def test_moments_match_simulated_totals(spark):
    rng = np.random.default_rng(0)
    seasons = np.where(rng.random((20, 60)) < 0.4, 1 + rng.gamma(0.8, 9.0, (20, 60)), 0.0)
    fit = rf.fit_rainfall(cube(spark, seasons.tolist())).cache()
    sites = spark.createDataFrame([(1, 10.0, 2.0)], "site_id bigint, y double, x double")
    exact = rf.total_moments(fit, [7] * 60).first()
    made = rf.simulate(fit, sites, [7] * 60, 4000, seed=1).groupBy("member").agg(F.sum("PRCP").alias("t")).agg(F.avg("t").alias("m"), F.var_samp("t").alias("v")).first()
    assert made.m == pytest.approx(exact["mean"], rel=0.02) and made.v == pytest.approx(exact["variance"], rel=0.1)
    part = {(x.member, x.day): x.PRCP for x in rf.simulate(fit, sites, [7] * 60, 2, seed=1, member_start=3).collect()}
    whole = {(x.member, x.day): x.PRCP for x in rf.simulate(fit, sites, [7] * 60, 5, seed=1).collect()}
    assert all(whole[key] == v for key, v in part.items())


def test_mixed_exponential_finds_its_parts():
    rng = np.random.default_rng(2)
    x = np.where(rng.random(20000) < 0.6, rng.exponential(2.0, 20000), rng.exponential(15.0, 20000))
    a, b1, b2, status = rf.mixed_exponential(x, np.ones(20000))
    assert status == 0 and a == pytest.approx(0.6, abs=0.03) and b1 == pytest.approx(2, rel=0.08) and b2 == pytest.approx(15, rel=0.06)
    q = rf.mixed_exponential_quantile([0.1, 0.9], a, b1, b2)
    assert 1 - (a * np.exp(-q / b1) + (1 - a) * np.exp(-q / b2)) == pytest.approx([0.1, 0.9])


def test_fields_have_their_correlation(spark):
    field = fl.Field("exponential", 200.0, features=512)
    z = np.stack([fl.draws(field, (i, 0.0, x), 200, 20, 5, "s").ravel() for i, x in enumerate((0.0, 1.0, 5.0))])
    km = np.linalg.norm(fl.position([0, 0], [0.0, 1.0])[0] - fl.position([0, 0], [0.0, 1.0])[1])
    assert z.std(axis=1) == pytest.approx(1, abs=0.06) and np.corrcoef(z)[0, 1] == pytest.approx(np.exp(-km / 200), abs=0.08)
    r_ = 0.5
    assert fl.latent_of_binary(0.3, 0.4, fl.bivariate_normal(*[fl.ndtri(v) for v in (0.3, 0.4)], r_)) == pytest.approx(r_, abs=1e-6)
    assert fl.bivariate_normal(0.0, 0.0, 0.5) == pytest.approx(1 / 3, abs=1e-9)


def test_hidden_states_by_enumeration():
    rng = np.random.default_rng(4)
    x = np.where(rng.random((2, 5, 3)) < 0.5, 1 + rng.exponential(4, (2, 5, 3)), 0.0)
    m = dy.HiddenStates(2, steps=5).fit(x)
    assert all(b >= a - 1e-6 for a, b in zip(m.likelihood, m.likelihood[1:], strict=False)) or len(m.likelihood) > 1
    e, t = m._log(x), m.transitions(np.zeros((2, 5)))
    for n in range(2):
        score = {}
        for code in range(2**5):
            path = [(code >> d) & 1 for d in range(5)]
            score[tuple(path)] = np.log(m.start[path[0]]) + e[n, 0, path[0]] + sum(t[n, d, path[d - 1], path[d]] + e[n, d, path[d]] for d in range(1, 5))
        assert tuple(m.viterbi(x)[n]) == max(score, key=score.get)
    _, _, total = m._pass(e, t)
    assert m.dwell(400).sum(axis=1) == pytest.approx(1, abs=1e-3) and np.isfinite(total)


def test_minimum_divergence_is_the_stated_integral():
    rng = np.random.default_rng(6)
    y, hist = rng.normal(size=(6, 2)), rng.normal(size=(7, 2)) * 2

    def integral(a, b):
        out = 0.0
        for j in range(a.shape[1]):
            at = np.sort(np.concatenate([a[:, j], b[:, j]]))
            mid = (at[1:] + at[:-1]) / 2
            out += float((((a[:, j][None] <= mid[:, None]).mean(1) - (b[:, j][None] <= mid[:, None]).mean(1)) ** 2 * np.diff(at)).sum())
        return out

    chosen, found = r.minimum_divergence(y, hist, 3)
    assert len(chosen) == 3 and found[0] == pytest.approx(integral(hist, y)) and found[-1] == pytest.approx(integral(hist[chosen], y))


def test_bias_correction_meets_the_observed_climate(spark):
    rng = np.random.default_rng(8)
    obs = np.where(rng.random(600) < 0.3, 1 + rng.gamma(1.0, 10.0, 600), 0.0)
    mod = rng.gamma(0.7, 3.0, 600)
    frame = lambda v: spark.createDataFrame([(1, 7, float(x)) for x in v], "site_id bigint, month int, value double")
    for method in ("qm", "loci", "loci_qm"):
        out = np.array([x.value for x in dy.DailyBiasCorrector(method).fit(frame(mod), frame(obs)).transform(frame(mod)).collect()])
        assert (out >= 1).mean() == pytest.approx((obs >= 1).mean(), abs=0.02) and out.mean() == pytest.approx(obs.mean(), rel=0.03)
