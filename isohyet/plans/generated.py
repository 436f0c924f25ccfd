"""Registered queries of the fits, generators, corrections and hindcasts, with SQL where they are sums and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import companions as cp
from ..operators import conditioning as c
from ..operators import constraints as k
from ..operators import dynamical as dy
from ..operators import fields as fl
from ..operators import generators as g
from ..operators import hindcast as h
from ..operators import linear_models as lm
from ..operators import rainfall as rf
from ..operators import resampling as r
from ..operators import season as s
from ..operators import semiparametric as sp
from ..sources import panel as p
from ..sources.store import stored
from .queries import MONTHS, N_DAYS, SEASONS, YEARS, classes, cube, forecast, members, query, rain, sites, sql, totals, weights

EVERY_YEAR = list(range(YEARS[0], YEARS[1] + 1))
SEASON_MONTHS = [7] * 31 + [8] * 31 + [9] * 30


def kept_cube(spark, d):
    """The seasons' rain, written once: fits and copies both read it."""
    return stored(cube(spark, d), "cube")


# --- rain model ------------------------------------------------------------------------------------------------

YEARLY = """, l AS (SELECT c.*, w, lag(p) OVER x AS b, lag(month) OVER x AS mb FROM cube c JOIN weights v USING (site_id, season_year) WINDOW x AS (PARTITION BY c.site_id, c.season_year ORDER BY c.day)),
y AS (SELECT site_id, season_year, month, max(w) AS w, count(*) AS n, count(*) FILTER (WHERE p >= 1) AS wets, count(*) FILTER (WHERE mb = month AND b < 1) AS n0, count(*) FILTER (WHERE mb = month AND b >= 1) AS n1,
  count(*) FILTER (WHERE mb = month AND b < 1 AND p >= 1) AS n01, count(*) FILTER (WHERE mb = month AND b >= 1 AND p >= 1) AS n11 FROM l GROUP BY ALL),
m AS (SELECT site_id, month, sum(w * wets / n::DOUBLE) / sum(w) AS pi, coalesce(sum(n11) / nullif(sum(n1), 0)::DOUBLE - sum(n01) / nullif(sum(n0), 0)::DOUBLE, 0) AS d_raw, count(*) FILTER (WHERE w > 0) AS known_years, sum(n0 + n1)::BIGINT AS pairs FROM y GROUP BY ALL),
f AS (SELECT *, CASE WHEN pi <= 0 OR pi >= 1 THEN 0 ELSE greatest((pi - 1) / pi, -pi / (1 - pi), least(d_raw, 1)) END AS d FROM m)"""


@query("w_chain_fit", sql(YEARLY + " SELECT site_id, month::INT AS month, round(pi, 6) AS pi, round(pi * (1 - d), 6) AS p01, round(pi + (1 - pi) * d, 6) AS p11, round(d_raw, 6) AS d_raw, round(d, 6) AS d, known_years, pairs FROM f"))
def _(spark, d):
    return rf.fit_chain(kept_cube(spark, d), weights(spark, d))


@query("w_chain_fit_yearly", sql(YEARLY + " SELECT site_id, month::INT AS month, round(sum(w * wets / n::DOUBLE) / sum(w), 6) AS pi, round(coalesce(sum(w * n01 / n0::DOUBLE) FILTER (WHERE n0 > 0) / nullif(sum(w) FILTER (WHERE n0 > 0), 0), 0), 6) AS p01, round(coalesce(sum(w * n11 / n1::DOUBLE) FILTER (WHERE n1 > 0) / nullif(sum(w) FILTER (WHERE n1 > 0), 0), 0), 6) AS p11 FROM y GROUP BY ALL"))
def _(spark, d):
    return rf.fit_chain(kept_cube(spark, d), weights(spark, d), persistence="yearly").select("site_id", "month", "pi", "p01", "p11")


AMOUNTS = """, a AS (SELECT site_id, month, p, w FROM cube JOIN weights USING (site_id, season_year))
SELECT site_id, month::INT AS month, round(coalesce(sum(w) FILTER (WHERE p = 1) / nullif(sum(w) FILTER (WHERE p >= 1), 0), CASE WHEN coalesce(sum(w) FILTER (WHERE p >= 1), 0) > 0 THEN 0 ELSE 1 END), 6) AS atom, round(coalesce(power(sum(w) FILTER (WHERE p > 1 AND w > 0), 2) / nullif(sum(w * w) FILTER (WHERE p > 1), 0), 0), 6) AS n_eff,
  round(coalesce(sum(w) FILTER (WHERE p > 0 AND p < 1) / nullif(sum(w) FILTER (WHERE p < 1), 0), 0), 6) AS trace_p, round(sum(w * (p - 1)) FILTER (WHERE p > 1) / sum(w) FILTER (WHERE p > 1), 6) AS mean FROM a GROUP BY ALL"""


@query("w_amount_fit", sql(AMOUNTS))
def _(spark, d):
    """The Gamma law's mean, shape times scale, is the weighted mean of excesses whatever the shape; the shape itself is held
    against the likelihood in the tests and in w_gamma_fit."""
    a = rf.fit_amounts(kept_cube(spark, d), weights(spark, d))
    return a.select("site_id", "month", "atom", "n_eff", "trace_p", (F.col("shape") * F.col("scale")).alias("mean"))


@query("w_rain_fit")
def _(spark, d):
    return rf.fit_rainfall(kept_cube(spark, d), weights(spark, d))


@query("w_mixed_exponential")
def _(spark, d):
    return rf.fit_mixed_exponential(kept_cube(spark, d), weights(spark, d))


RUNS = """, a AS (SELECT site_id, season_year, month, day, (p >= 1)::INT AS st FROM cube), b AS (SELECT *, day - row_number() OVER (PARTITION BY site_id, season_year, st ORDER BY day) AS run FROM a),
e AS (SELECT *, row_number() OVER (PARTITION BY site_id, season_year, st, run ORDER BY day) AS length, min(day) OVER (PARTITION BY site_id, season_year, st, run) AS start FROM b),
q AS (SELECT x.site_id, x.month, x.st, z.st AS was_wet, least(z.length, CASE z.st WHEN 1 THEN 15 ELSE 40 END) AS run, z.start > 0 AS known FROM e x JOIN e z ON z.site_id = x.site_id AND z.season_year = x.season_year AND z.day = x.day - 1),
base AS (SELECT site_id, month, was_wet, avg(st) AS base FROM q GROUP BY ALL), pooled AS (SELECT site_id, month, avg(st) AS pooled FROM a GROUP BY ALL),
n AS (SELECT site_id, month, was_wet, run, count(*) AS risk, sum(st) AS wets FROM q WHERE known GROUP BY ALL),
grid AS (SELECT site_id, month, pooled, was_wet, run FROM pooled, (SELECT 0 AS was_wet, unnest(range(1, 41)) AS run UNION ALL SELECT 1, unnest(range(1, 16))) t)
SELECT site_id, month::INT AS month, was_wet, run::INT AS run, round((coalesce(wets, 0) + 3 * coalesce(base, pooled)) / (coalesce(risk, 0) + 3), 6) AS p FROM grid LEFT JOIN base USING (site_id, month, was_wet) LEFT JOIN n USING (site_id, month, was_wet, run)"""


@query("w_spell_fit", sql(RUNS))
def _(spark, d):
    return rf.fit_spells(cube(spark, d))


@query("w_total_moments")
def _(spark, d):
    calendar = [7] * 31 + [8] * 31 + [9] * 30
    return rf.total_moments(rf.fit_rainfall(kept_cube(spark, d), weights(spark, d)), calendar)


# --- constraints -----------------------------------------------------------------------------------------------


def attributes(spark, d):
    return s.compute_attributes(rain(spark, d), YEARS, {"total": ("total", {}), "dry": ("dry_spell", {})})


@query("w_attributes", sql(""", dry_spell AS (SELECT t.site_id, t.season_year, coalesce((SELECT max(length) FROM runs r WHERE r.site_id = t.site_id AND r.season_year = t.season_year), 0)::DOUBLE AS value FROM totals t)
SELECT site_id, season_year::INT AS season_year, 'total' AS name, round(total, 6) AS value, 1.0::DOUBLE AS event_observed FROM totals UNION ALL SELECT site_id, season_year::INT, 'dry', value, 1.0::DOUBLE FROM dry_spell"""))
def _(spark, d):
    return attributes(spark, d)


def constrained(spark, d, **options):
    values = stored(attributes(spark, d), "attributes").select("site_id", "season_year", "name", "value")
    prob = forecast(spark, d)
    probs = prob.withColumn("name", F.lit("total")).unionByName(prob.select("site_id", F.lit(0.4).alias("pb"), F.lit(0.3).alias("pn"), F.lit(0.3).alias("pa"), F.lit("dry").alias("name")))
    as_total = lambda n: values.where(F.col("name") == n).select("site_id", "season_year", F.col("value").alias("total"))
    limits = c.tercile_limits(as_total("total"), "site_id").withColumn("name", F.lit("total")).unionByName(c.tercile_limits(as_total("dry"), "site_id").withColumn("name", F.lit("dry")))
    return k.constrained_year_weights(values, probs, limits, **options).drop("achieved")


@query("w_constraint_weights")
def _(spark, d):
    return constrained(spark, d)


@query("w_constraint_weights_squares")
def _(spark, d):
    return constrained(spark, d, method="croley")


#: One attribute alone, met exactly: entropy keeps a category's years alike, so weights are those by terciles.
@query("w_constraint_exact", sql("SELECT site_id, season_year::INT AS season_year, round(w, 5) AS w FROM weights"))
def _(spark, d):
    t = totals(spark, d)
    values = t.select("site_id", "season_year", F.lit("total").alias("name"), F.col("total").alias("value"))
    limits = c.tercile_limits(t, "site_id").withColumn("name", F.lit("total"))
    # Sites without a year in some category can't meet the forecast and take all years alike, as their tercile weights do.
    met = weights(spark, d)
    can = met.where("flags = 0").select("site_id").distinct()
    found = k.constrained_year_weights(values.join(can, "site_id", "left_semi"), forecast(spark, d).withColumn("name", F.lit("total")), limits, mode="exact").select("site_id", "season_year", "w")
    return found.unionByName(met.where("flags <> 0").select("site_id", "season_year", "w")).withColumn("w", F.round("w", 5))


# --- resampling ------------------------------------------------------------------------------------------------


@query("w_point_quantiles", sql(", v AS (SELECT site_id, list(total ORDER BY total) AS v, count(*) AS n FROM totals GROUP BY site_id), a AS (SELECT *, i, (i + 0.5) / 5.0::DOUBLE * (n - 1) AS h FROM v, unnest(range(5)) AS t(i)) SELECT site_id, i::INT AS rank, round(v[floor(h)::INT + 1] + (h - floor(h)) * (v[least(floor(h)::INT + 2, n)] - v[floor(h)::INT + 1]), 6) AS value FROM a"))
def _(spark, d):
    return r.point_quantiles(totals(spark, d).select("site_id", F.col("total").alias("value")), 5, ["site_id"])


@query("w_copula_coupling")
def _(spark, d):
    raw = members(spark, d).select("site_id", "season_year", "member", F.col("total").alias("value"))
    one = totals(spark, d).select("site_id", F.col("total").alias("value"))
    calibrated = one.crossJoin(F.broadcast(spark.createDataFrame([(y,) for y in EVERY_YEAR], "season_year int")))  # the years
    return r.copula_coupling(raw, calibrated, SEASONS, 7)


@query("w_largest_remainder", sql(", x AS (SELECT site_id, season_year, w, 100 * w / sum(w) OVER (PARTITION BY site_id) AS raw FROM weights), y AS (SELECT *, floor(raw) AS f, 100 - sum(floor(raw)) OVER (PARTITION BY site_id) AS rest, row_number() OVER (PARTITION BY site_id ORDER BY round(raw - floor(raw), 12) DESC, season_year) AS i FROM x) SELECT site_id, season_year::INT AS season_year, (f + (i <= rest)::INT)::INT AS n FROM y"))
def _(spark, d):
    return r.largest_remainder(weights(spark, d).select("site_id", "season_year", "w"), 100, ["site_id"], "season_year", "w").select("site_id", "season_year", "n")


SYSTEMATIC = """, x AS (SELECT site_id, season_year, w, sum(w) OVER (PARTITION BY site_id ORDER BY season_year) / sum(w) OVER (PARTITION BY site_id) AS hi, (('0x' || substr(md5('7|systematic|' || site_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM weights WHERE w > 0),
t AS (SELECT site_id, i, (u + i) / 12 AS spot FROM (SELECT DISTINCT site_id, u FROM x), unnest(range(12)) AS r(i))
SELECT t.site_id, i::INT AS draw, coalesce(min(season_year) FILTER (WHERE hi > spot + 1e-13), max(season_year))::INT AS season_year FROM t JOIN x USING (site_id) GROUP BY ALL"""


@query("w_systematic", sql(SYSTEMATIC))
def _(spark, d):
    return r.systematic(weights(spark, d).select("site_id", "season_year", "w"), 12, 7, ["site_id"], "season_year")


@query("w_nearest", sql(", x AS (SELECT a.site_id, a.season_year, b.season_year AS other, abs(a.total - b.total) AS dist FROM totals a JOIN totals b ON a.site_id = b.site_id AND a.season_year <> b.season_year), y AS (SELECT *, row_number() OVER (PARTITION BY site_id, season_year ORDER BY dist, (('0x' || substr(md5('0|near|' || site_id || '|' || season_year || '|' || other), 1, 13))::BIGINT)) AS place FROM x) SELECT site_id, season_year::INT AS season_year, other::INT AS other, round(dist, 6) AS distance, place::INT AS place, round((1.0::DOUBLE / place) / (1 + 0.5 + 1.0::DOUBLE / 3), 6) AS w FROM y WHERE place <= 3"))
def _(spark, d):
    t = totals(spark, d)
    pairs = t.join(t.select("site_id", F.col("season_year").alias("other"), F.col("total").alias("o")), "site_id").where("season_year <> other").select("site_id", "season_year", "other", F.abs(F.col("total") - F.col("o")).alias("distance"))
    return r.nearest(pairs, SEASONS, 3, 0, "other").select("site_id", "season_year", "other", "distance", "place", "w")


@query("w_preferential_dates")
def _(spark, d):
    rows = kept_cube(spark, d)
    target = rows.where((F.col("season_year") == YEARS[1]) & F.col("day").between(7, 84)).select("site_id", (F.col("day") - 7).alias("day"), F.col("PRCP").alias("value"))
    shifted = rows.withColumn("day", F.col("day") - 7)
    return r.preferential_dates(target, r.trajectories(shifted, 7, 78), 20)


@query("w_select_members")
def _(spark, d):
    w, place = weights(spark, d), sites(spark, d)
    pool = g.analog_seasons(kept_cube(spark, d), w, place, 30).groupBy("site_id", "member").agg(F.sum("PRCP").alias("value"), F.lit("total").alias("name"))
    limits = c.tercile_limits(totals(spark, d), "site_id").withColumn("name", F.lit("total"))
    return r.select_members(pool, limits, forecast(spark, d).withColumn("name", F.lit("total")), place, 12)[0]


# --- generators ------------------------------------------------------------------------------------------------

ANALOG = """, ar AS (SELECT site_id, cos(radians(site_id // 5)) / sum(cos(radians(site_id // 5))) OVER () AS a FROM sites), rw AS (SELECT season_year, sum(w * a) AS w FROM weights JOIN ar USING (site_id) GROUP BY season_year),
st AS (SELECT season_year, sum(w) OVER (ORDER BY season_year) AS hi, w FROM rw), dr AS (SELECT m AS member, (('0x' || substr(md5('42|year|0|' || m), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM unnest(range(10)) AS t(m)),
dn AS (SELECT member, min(season_year) AS donor_year FROM dr JOIN st ON u < hi GROUP BY member)"""


@query("w_analog_seasons", sql(ANALOG + " SELECT site_id, member::INT AS member, day::INT AS day, round(p, 6) AS PRCP, donor_year::INT AS donor_year FROM dn JOIN cube ON season_year = donor_year"))
def _(spark, d):
    return g.analog_seasons(kept_cube(spark, d), weights(spark, d), sites(spark, d), 10)


@query("w_shuffled_seasons")
def _(spark, d):
    return g.shuffled_seasons(kept_cube(spark, d), weights(spark, d), sites(spark, d), N_DAYS, 7)


@query("w_neighbour_seasons")
def _(spark, d):
    return g.neighbour_seasons(kept_cube(spark, d), sites(spark, d), 5)


def generated(spark, d, **options):
    made = g.WeatherGenerator(months=MONTHS, climatology=YEARS, **options).fit(kept_cube(spark, d), forecast(spark, d), sites(spark, d))
    return made.generate(2002, 10)


@query("w_generator")
def _(spark, d):
    return generated(spark, d, spatial=fl.Field(features=64))


@query("w_generator_mixture")
def _(spark, d):
    return generated(spark, d, conditioning="mixture", amounts="mixed_exponential")


@query("w_generator_spells")
def _(spark, d):
    return generated(spark, d, occurrence="spell", weighting="pdf_ratio")


@query("w_generator_three_states")
def _(spark, d):
    return generated(spark, d, wet=20.0, strict=True, reset=True, three_states={"bandwidth": "resampled"})


@query("w_generator_companions")
def _(spark, d):
    span = (f"{YEARS[0]}-07-01", f"{YEARS[1]}-09-30")
    dates = s.complete_seasons(p.record(spark, d), MONTHS, YEARS)
    panel = p.canonicalize(p.observations(spark, d, dates.select("t"), span)).join(F.broadcast(dates), "t")  # one row a date
    made = g.WeatherGenerator(months=MONTHS, climatology=YEARS, conditioning="mixture", companions=cp.VARIABLES).fit(stored(panel, "panel"), forecast(spark, d), sites(spark, d))
    return made.generate(2002, 3)


@query("w_field")
def _(spark, d):
    return fl.sample(fl.Field("power", 200.0, 1.5, 64), sites(spark, d), 5, 10)


@query("w_pair_correlations", "WITH " + sql("")[5:] + ", a AS (SELECT site_id, t, p FROM cube) SELECT x.site_id AS a, y.site_id AS b, count(*) AS n, round(corr(x.p, y.p), 6) AS physical FROM a x JOIN a y ON x.t = y.t AND x.site_id < y.site_id WHERE x.site_id IN (SELECT site_id FROM a GROUP BY 1 HAVING max(p) > min(p)) AND y.site_id IN (SELECT site_id FROM a GROUP BY 1 HAVING max(p) > min(p)) GROUP BY ALL")
def _(spark, d):
    values = kept_cube(spark, d).select("site_id", F.col("t").alias("time"), F.col("PRCP").alias("value"))
    return fl.pair_correlations(values, sites(spark, d), pairs=10_000).select("a", "b", "n", "physical")


# --- model ensembles and hindcasts -----------------------------------------------------------------------------


def model(spark, d):
    rows = kept_cube(spark, d)
    made = dy.synthetic_ensemble(rows, EVERY_YEAR, 5)
    return stored(made.join(F.broadcast(rows.select("day", "month").distinct()), "day"), "model"), rows  # a season's days


@query("w_synthetic_ensemble")
def _(spark, d):
    return model(spark, d)[0]


def corrected(spark, d, method):
    made, rows = model(spark, d)
    return dy.DailyBiasCorrector(method).fit(made.select("site_id", "month", "value"), rows.select("site_id", "month", F.col("PRCP").alias("value"))).transform(made)


@query("w_quantile_mapping")
def _(spark, d):
    return corrected(spark, d, "qm")


@query("w_local_intensity")
def _(spark, d):
    return corrected(spark, d, "loci_qm")


@query("w_hidden_states")
def _(spark, d):
    return dy.hidden_state_days(cube(spark, d))


FOLDS = """, pr AS (SELECT a.season_year AS target, b.season_year FROM (SELECT DISTINCT season_year FROM totals) a, (SELECT DISTINCT season_year FROM totals) b WHERE abs(a.season_year - b.season_year) > 1),
fl AS (SELECT site_id, target AS season_year, quantile_cont(total, 1.0::DOUBLE / 3) AS q33, quantile_cont(total, 2.0::DOUBLE / 3) AS q67 FROM totals JOIN pr USING (season_year) GROUP BY ALL)"""


@query("w_fold_limits", sql(FOLDS + " SELECT site_id, season_year::INT AS season_year, round(q33, 6) AS q33, round(q67, 6) AS q67 FROM fl"))
def _(spark, d):
    return h.fold_limits(totals(spark, d).withColumnRenamed("total", "value"), EVERY_YEAR, buffer=1)


def experiment(spark, d):
    observed = totals(spark, d).select(*SEASONS, F.lit("total").alias("name"), F.col("total").alias("value"))
    own = members(spark, d).select(*SEASONS, "member", F.lit("total").alias("name"), (F.col("total") * 7).alias("value"))

    def climate(train, targets):
        rows = observed.where(F.col("season_year").isin(*train)).select("site_id", F.col("season_year").alias("member"), "name", "value")
        return rows.crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in targets], "season_year int")))  # the fold's years

    return h.HindcastExperiment(observed, r.area_weights(sites(spark, d)), EVERY_YEAR, buffer=1).add("lines", lambda train, targets: own).add("climate", climate)


HIND = FOLDS + """, ar AS (SELECT site_id, cos(radians(site_id // 5)) / sum(cos(radians(site_id // 5))) OVER () AS a FROM sites),
e AS (SELECT site_id, season_year, total * 7 AS v FROM members), k AS (SELECT e.*, t.total AS o, q33, q67, row_number() OVER (PARTITION BY site_id, season_year ORDER BY v) AS i, count(*) OVER (PARTITION BY site_id, season_year) AS m FROM e JOIN totals t USING (site_id, season_year) JOIN fl USING (site_id, season_year)),
u AS (SELECT site_id, season_year, o, power(avg((v <= q33)::INT) - (o <= q33)::INT, 2) + power(avg((v <= q67)::INT) - (o <= q67)::INT, 2) AS rps, power(1.0::DOUBLE / 3 - (o <= q33)::INT, 2) + power(2.0::DOUBLE / 3 - (o <= q67)::INT, 2) AS rps_clim, avg(abs(v - o)) - sum((2 * i - m - 1) * v / (m * m)) AS crps, avg(v) AS mean, var_samp(v) AS var FROM k GROUP BY site_id, season_year, o, q33, q67)
SELECT season_year::INT AS season_year, round(sum(rps * a) / sum(a), 6) AS rps, round(sum(rps_clim * a) / sum(a), 6) AS rps_clim, round(sum(crps * a) / sum(a), 6) AS crps, round(sum(o * a) / sum(a), 6) AS obs, round(sum(mean * a) / sum(a), 6) AS ens_mean, round(sum(power(mean - o, 2) * a) / sum(a), 5) AS err2 FROM u JOIN ar USING (site_id) GROUP BY season_year"""


@query("w_hindcast_scores", sql(HIND))
def _(spark, d):
    run, _ = experiment(spark, d).run()
    return run.where("method = 'lines'").select("season_year", "rps", "rps_clim", "crps", "obs", "ens_mean", F.round("err2", 5).alias("err2"))


@query("w_hindcast_skill")
def _(spark, d):
    return experiment(spark, d).run()[1]


@query("w_hindcast_reliability")
def _(spark, d):
    e = experiment(spark, d)
    return e.reliability(e.hindcasts(), "total", "lines")


@query("w_daily_scores")
def _(spark, d):
    made, rows = model(spark, d)
    time = (F.col("season_year") * 1000 + F.col("day")).alias("time")
    return h.daily_scores(rows.select("site_id", time, F.col("PRCP").alias("observed")), made.select("site_id", time, "member", "value"), 5, fair=True)


@query("w_ensemble_diagnostics")
def _(spark, d):
    rows = kept_cube(spark, d)
    return h.ensemble_diagnostics(g.analog_seasons(rows, weights(spark, d), sites(spark, d), 20), rows, forecast(spark, d), N_DAYS, (1995, 2000))


ATTRIBUTE = ", f AS (SELECT site_id, CASE WHEN m.total * 7 <= q33 THEN 0 WHEN m.total * 7 <= q67 THEN 1 ELSE 2 END AS cat, m.total * 7 AS v FROM members m JOIN limits USING (site_id)) SELECT site_id, 'total' AS name, count(*) AS members, round(avg(v), 6) AS mean, 0.0::DOUBLE AS censored, " + ", ".join(f"round(avg((cat = {i})::INT), 6) AS share_{n}" for i, n in enumerate(("pb", "pn", "pa"))) + ", " + ", ".join(f"round(avg((cat = {i})::INT) - {t}, 6) AS error_{n}" for i, (n, t) in enumerate((("pb", 0.2), ("pn", 0.3), ("pa", 0.5)))) + " FROM f GROUP BY site_id"


@query("w_attribute_diagnostics", sql(ATTRIBUTE))
def _(spark, d):
    values = members(spark, d).select("site_id", "member", F.lit("total").alias("name"), (F.col("total") * 7).alias("value"), F.lit(1.0).alias("event_observed"))
    limits = c.tercile_limits(totals(spark, d), "site_id").withColumn("name", F.lit("total"))
    return h.attribute_diagnostics(values, limits, forecast(spark, d).withColumn("name", F.lit("total")))


@query("w_normal_cdf")
def _(spark, d):
    x = (F.col("c_acctbal") / 1500).alias("x")
    rows = p.table(spark, d, "customer").select("c_custkey", x)
    return rows.select("c_custkey", scalar.normal_cdf(F.col("x")).alias("cdf"), scalar.log_normal_cdf(F.col("x")).alias("log_cdf"))


@query("w_interpolate", "SELECT c_custkey, round(CASE WHEN c_acctbal <= 0 THEN 1 WHEN c_acctbal <= 5000 THEN 1 + c_acctbal * (3 - 1) / 5000.0::DOUBLE WHEN c_acctbal <= 9000 THEN 3 + (c_acctbal - 5000) * (2 - 3) / 4000.0::DOUBLE ELSE 2 END, 3) AS y, round(ln(exp(c_acctbal / 1000) + exp(2.0::DOUBLE)), 6) AS soft FROM customer")
def _(spark, d):
    x = F.col("c_acctbal")
    return p.table(spark, d, "customer").select("c_custkey", scalar.interpolate(x, [0.0, 5000.0, 9000.0], [1.0, 3.0, 2.0]).alias("y0"), scalar.log_add_exp(x / 1000, F.lit(2.0)).alias("soft")).select("c_custkey", F.round("y0", 3).alias("y"), "soft")


@query("w_dry_spell_after_onset")
def _(spark, d):
    return s.dry_spell_after_onset(rain(spark, d), (1995, 2000))


# --- rain in three states --------------------------------------------------------------------------------------

THREE = """, d AS (SELECT c.site_id, c.season_year, c.day, c.month::INT AS month, p, w, lag(p) OVER x AS b, lag(c.month) OVER x AS mb FROM cube c JOIN weights v USING (site_id, season_year) WINDOW x AS (PARTITION BY c.site_id, c.season_year ORDER BY c.day)),
k AS (SELECT *, sum(w) OVER (PARTITION BY site_id, month ORDER BY p, season_year, day ROWS UNBOUNDED PRECEDING) AS u, sum(w) OVER (PARTITION BY site_id, month) AS a FROM d WHERE w > 0 AND p > 20),
cut AS (SELECT site_id, month, min(p) AS cutoff FROM k WHERE u >= 0.8::DOUBLE * a * (1 - 1e-12) GROUP BY ALL),
z AS (SELECT d.*, cutoff, CASE WHEN p <= 20 THEN 0 WHEN cutoff IS NULL OR p < cutoff THEN 1 ELSE 2 END AS s, CASE WHEN mb IS NULL OR mb <> month THEN NULL WHEN b <= 20 THEN 0 WHEN cutoff IS NULL OR b < cutoff THEN 1 ELSE 2 END AS f FROM d LEFT JOIN cut USING (site_id, month) WHERE w > 0)"""
SHARES = "".join(f", round(pi{i}, 6) AS pi{i}" for i in range(3)) + "".join(f", round(coalesce(t{i}{j}, pi{j}), 6) AS t{i}{j}" for i in range(3) for j in range(3)) + "".join(f", n{i}::BIGINT AS n{i}" for i in range(3))
YEAR_ROWS = ", ".join(f"count(*) FILTER (WHERE s = {i}) / count(*) AS p{i}" for i in range(3)) + ", " + ", ".join(f"count(*) FILTER (WHERE f = {i}) AS f{i}" for i in range(3)) + ", " + ", ".join(f"count(*) FILTER (WHERE f = {i} AND s = {j}) / nullif(count(*) FILTER (WHERE f = {i}), 0) AS y{i}{j}" for i in range(3) for j in range(3))
MEANS = ", ".join(f"sum(w * p{i}) / sum(w) AS pi{i}, sum(f{i}) AS n{i}" for i in range(3)) + ", " + ", ".join(f"sum(w * y{i}{j}) / sum(w) FILTER (WHERE f{i} > 0) AS t{i}{j}" for i in range(3) for j in range(3))


def three_states(spark, d, **options):
    return sp.fit_three_states(kept_cube(spark, d), weights(spark, d), wet=20.0, **options)


@query("w_three_states", sql(THREE + f", y AS (SELECT site_id, season_year, month, max(w) AS w, max(cutoff) AS cutoff, {YEAR_ROWS} FROM z GROUP BY site_id, season_year, month), m AS (SELECT site_id, month, max(cutoff) AS cutoff, {MEANS} FROM y GROUP BY site_id, month) SELECT site_id, month, round(cutoff, 6) AS cutoff{SHARES} FROM m"))
def _(spark, d):
    return three_states(spark, d).select("site_id", "month", "cutoff", *[f"pi{i}" for i in sp.STATES], *[f"t{i}{j}" for i in sp.STATES for j in sp.STATES], *[f"n{i}" for i in sp.STATES])


@query("w_three_state_kernels", sql(THREE + ", h AS (SELECT site_id, month, s, w / sum(w) OVER v AS q, p, sum(w * p) OVER v / sum(w) OVER v AS mean FROM z WHERE s > 0 WINDOW v AS (PARTITION BY site_id, month, s)), e AS (SELECT site_id, month, s, count(*)::INT AS days, 1 / sum(q * q) AS n_eff, sqrt(sum(q * power(p - mean, 2))) AS sd FROM h GROUP BY ALL) SELECT site_id, month, s AS state, days, round(n_eff, 6) AS n_eff, round(sd, 6) AS sd, round(CASE WHEN sd > 1e-10 THEN 1.06::DOUBLE * sd * power(n_eff, -0.2::DOUBLE) ELSE 0 END, 6) AS bandwidth FROM e"))
def _(spark, d):
    days = sp.weighted_days(kept_cube(spark, d), weights(spark, d))
    rows = sp.with_states(days, sp.cutoffs(days, 20.0), 20.0)
    return sp.fit_kernels(rows, 20.0).select("site_id", "month", "state", F.size("centres").alias("days"), "n_eff", "sd", "bandwidth")


@query("w_three_state_rain")
def _(spark, d):
    params = stored(three_states(spark, d, bandwidth="resampled", start="stationary"), "three-states")
    return sp.simulate_three_states(params, sites(spark, d), SEASON_MONTHS, 5, wet=20.0, seed=7)


# --- companions of rain ----------------------------------------------------------------------------------------

def companion_rows(spark, d, weighted=True):
    span = (f"{YEARS[0]}-07-01", f"{YEARS[1]}-09-30")
    dates = s.complete_seasons(p.record(spark, d), MONTHS, YEARS)
    panel = p.canonicalize(p.observations(spark, d, dates.select("t"), span)).join(F.broadcast(dates), "t")  # one row a date
    return stored(cp.latent_panel(panel, cp.VARIABLES, weights(spark, d) if weighted else None), "companions")


def least_squares(source: str, keys: str) -> str:
    """SQL of the weighted parabola through (t, y, w) by keys, as its three coefficients by Cramer's rule."""
    sums = ", ".join(f"sum(w * t ** {i}) AS s{i}" for i in range(5)) + ", " + ", ".join(f"sum(w * y * t ** {i}) AS r{i}" for i in range(3))
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    base = ["s0", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4"]
    of = lambda k: det([f"r{i // 3}" if i % 3 == k else b for i, b in enumerate(base)])
    return f"SELECT {keys}, {of(0)} / {det(base)} AS c0, {of(1)} / {det(base)} AS c1, {of(2)} / {det(base)} AS c2 FROM (SELECT {keys}, {sums} FROM {source} GROUP BY {keys})"


CURVES = f""", full_obs AS (SELECT o.site_id, year(o.t) AS season_year, date_diff('day', make_date(year(o.t), 7, 1), o.t)::INT AS day, (o.p >= 1)::INT AS own, w, CASE WHEN tn <= tx THEN tn END AS tn, CASE WHEN tn <= tx THEN tx END AS tx, CASE WHEN hn <= hx OR hn IS NULL OR hx IS NULL THEN hn END AS hn, CASE WHEN hn <= hx OR hn IS NULL OR hx IS NULL THEN hx END AS hx, wi, so FROM obs o JOIN weights v ON v.site_id = o.site_id AND v.season_year = year(o.t) WHERE month(o.t) IN (7, 8, 9) AND w > 0),
lv AS (SELECT site_id, day, own, w, unnest(['TMIN', 'TMAX', 'HUMIN', 'HUMAX', 'WIND', 'SOLAR']) AS variable, unnest([tn, tx, ln(greatest(1e-4, least(1 - 1e-4, hn / 100)) / (1 - greatest(1e-4, least(1 - 1e-4, hn / 100)))), ln(greatest(1e-4, least(1 - 1e-4, hx / 100)) / (1 - greatest(1e-4, least(1 - 1e-4, hx / 100)))), ln(1 + wi), ln(1 + so)]) AS y FROM full_obs),
st AS (SELECT unnest([0, 1]) AS state),
nn AS (SELECT site_id, variable, state, count(*) FILTER (WHERE own = state) < 6 AS pooled FROM lv, st WHERE y IS NOT NULL GROUP BY ALL),
us AS (SELECT lv.site_id, lv.variable, state, pooled, day, w, y, day * 2 / 91.0::DOUBLE - 1 AS t FROM lv JOIN nn USING (site_id, variable) WHERE y IS NOT NULL AND (own = state OR pooled)),
mc AS ({least_squares("us", "site_id, variable, state")}),
dv AS (SELECT site_id, variable, state, pooled, day, t, sum(w) AS w, sum(w * power(y - c0 - c1 * t - c2 * t * t, 2)) AS s2 FROM us JOIN mc USING (site_id, variable, state) GROUP BY ALL),
lg AS (SELECT site_id, variable, state, t, w, ln(s2 / w) AS y FROM dv WHERE s2 > 0),
vc AS ({least_squares("lg", "site_id, variable, state")}),
sc AS (SELECT site_id, variable, state, any_value(pooled) AS pooled, sum(s2) / sum(w * exp(c0 + c1 * t + c2 * t * t)) AS scale FROM dv JOIN vc USING (site_id, variable, state) GROUP BY site_id, variable, state)
SELECT m.site_id, m.variable, m.state, g.day::INT AS day, round(m.c0 + m.c1 * t + m.c2 * t * t, 4) AS mean, round(sqrt(scale * exp(v.c0 + v.c1 * t + v.c2 * t * t)), 4) AS sd, pooled
FROM mc m JOIN vc v USING (site_id, variable, state) JOIN sc USING (site_id, variable, state), (SELECT unnest(range(92)) AS day, unnest(range(92)) * 2 / 91.0::DOUBLE - 1 AS t) g"""


@query("w_companion_curves", sql(CURVES))
def _(spark, d):
    found = cp.fit_curves(companion_rows(spark, d), N_DAYS)
    return found.select("site_id", "variable", "state", "day", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "pooled")


def companion_fit(spark, d):
    """(curves under the forecast, dependence of the whole record, residuals)."""
    rows = companion_rows(spark, d)
    plain = rows.withColumn("w", F.lit(1.0))
    left = stored(cp.residuals(plain, cp.fit_curves(plain, N_DAYS)), "residuals")
    return cp.fit_curves(rows, N_DAYS), stored(cp.fit_dependence(left, cp.VARIABLES, MONTHS), "dependence"), left


@query("w_companion_dependence")
def _(spark, d):
    found = companion_fit(spark, d)[1]
    at = lambda name: F.posexplode(F.flatten(name))
    return found.select("site_id", "month", "source", "pairs", at("transition").alias("entry", "value"))


@query("w_companion_innovations")
def _(spark, d):
    _, dependence, left = companion_fit(spark, d)
    return cp.innovations(left, dependence)


@query("w_companions")
def _(spark, d):
    curves, dependence, _ = companion_fit(spark, d)
    made = rf.simulate(rf.fit_rainfall(kept_cube(spark, d), weights(spark, d)), sites(spark, d), SEASON_MONTHS, 5, seed=7)
    latent = cp.simulate_latent(dependence, sites(spark, d), SEASON_MONTHS, 5, seed=7)
    return cp.simulate_companions(latent, curves, made, cp.VARIABLES)


# --- linear models ---------------------------------------------------------------------------------------------


def site_models(spark, d):
    rows = kept_cube(spark, d)
    scores = stored(c.normal_scores(totals(spark, d)), "scores")
    return rows, scores, stored(lm.fit_models(rows, scores, wet=20.0), "models")


@query("w_model_design", sql(", z AS (SELECT c.*, (p >= 20)::INT AS state FROM cube c) SELECT site_id, season_year::INT AS season_year, day::INT AS day, state, lag(state) OVER (PARTITION BY site_id, season_year ORDER BY day) AS lag, round(sin(2 * pi() * dayofyear(t) / 365.25::DOUBLE), 6) AS s1, round(cos(2 * pi() * dayofyear(t) / 365.25::DOUBLE), 6) AS c1 FROM z"))
def _(spark, d):
    rows = lm.design(kept_cube(spark, d), c.normal_scores(totals(spark, d)), 1, wet=20.0)
    return rows.select("site_id", "season_year", F.col("day").cast("int").alias("day"), "state", "lag", F.col("h")[1].alias("s1"), F.col("h")[2].alias("c1"))


@query("w_site_models")
def _(spark, d):
    return site_models(spark, d)[2].select("site_id", "model", "n", F.posexplode("coefficients").alias("at", "value"))


@query("w_smoothed_models")
def _(spark, d):
    return lm.smooth_coefficients(site_models(spark, d)[2], sites(spark, d))


@query("w_model_seasons")
def _(spark, d):
    """From the sites' own coefficients; what smoothing does to them is said in ``smooth_coefficients``."""
    _, _, fits = site_models(spark, d)
    scores = lm.season_scores(forecast(spark, d), sites(spark, d), 10, field=fl.Field(features=64))
    dates = s.season_calendar(spark, (2002, 2002), MONTHS).select("day", "t")
    return lm.simulate_models(fits, scores, sites(spark, d), dates, 10, wet=20.0)


@query("w_model_transmission")
def _(spark, d):
    _, _, fits = site_models(spark, d)
    scores = stored(lm.season_scores(forecast(spark, d), sites(spark, d), 30), "season-scores")
    dates = s.season_calendar(spark, (2002, 2002), MONTHS).select("day", "t")
    return lm.transmission(lm.simulate_models(fits, scores, sites(spark, d), dates, 30, wet=20.0), scores, totals(spark, d))


@query("w_forecast_plane")
def _(spark, d):
    found = rf.forecast_plane(kept_cube(spark, d), classes(spark, d), forecast(spark, d))
    return found.select("site_id", "month", "alpha", "beta1", "beta2", "mix_status", *[F.col("plane1")[i].alias(f"plane1_{i}") for i in range(3)], *[F.col("plane2")[i].alias(f"plane2_{i}") for i in range(3)])
