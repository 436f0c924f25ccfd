"""The registered weather queries over the panel of supplied quantities, and the same in DuckDB SQL.

Season July to September of 1995 to 2001, forecast (0.2, 0.3, 0.5) everywhere;
ensemble members are line numbers.  Doubles are rounded to 6 digits in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import conditioning as c
from ..operators import grids as g
from ..operators import season as s
from ..operators import sequences as q
from ..operators import simulate
from ..operators import verification as v
from ..sources import panel as p
from ..sources.store import stored

MONTHS, YEARS, N_DAYS = (7, 8, 9), (1995, 2001), 92
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(k, 6).alias(k) if kind == "double" else F.col(k) for k, kind in df.dtypes])

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


# --- building blocks -------------------------------------------------------------------------------------------


def obs(spark, sf_dir):
    return p.canonicalize(p.observations(spark, sf_dir))


def rain(spark, sf_dir):
    """The panel's rain alone; the other variables are pruned from the scan."""
    return p.observations(spark, sf_dir).select("t", "site_id", "PRCP")


def cube(spark, sf_dir):
    """The seasons' rain: the calendar comes from what is asked for, so the items' dates are filtered in the scan."""
    span = (f"{YEARS[0]}-07-01", f"{YEARS[1]}-09-30")
    dates = s.complete_seasons(p.record(spark, sf_dir), MONTHS, YEARS)
    rows = p.observations(spark, sf_dir, dates.select("t"), span).select("t", "site_id", "PRCP")
    return rows.join(F.broadcast(dates), "t")  # one row a date


def totals(spark, sf_dir):
    """One narrow row a site and season; written once, because categories and limits both need them."""
    return stored(s.totals(cube(spark, sf_dir), N_DAYS), "totals")


def forecast(spark, sf_dir):
    sites = p.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site_id")).distinct()
    return p.prepare_probabilities(sites.select("site_id", F.lit(0.2).alias("pb"), F.lit(0.3).alias("pn"), F.lit(0.5).alias("pa")))


def classes(spark, sf_dir):
    t = totals(spark, sf_dir)
    return c.classify_seasons(t, c.tercile_limits(t, "site_id"))


def weights(spark, sf_dir):
    return stored(c.year_weights(classes(spark, sf_dir), forecast(spark, sf_dir)), "weights")


def sites(spark, sf_dir):
    k = F.col("s_nationkey")
    return p.table(spark, sf_dir, "supplier").select(k.alias("site_id"), F.expr("s_nationkey div 5").alias("y"), (k % 5).alias("x")).distinct()


def members(spark, sf_dir):
    """(site_id, season_year, member, total): rain by line number and season."""
    rows = p.supplied_days(spark, sf_dir).select("site_id", "t", F.col("l_linenumber").alias("member"), "l_quantity")
    dates = s.season_calendar(spark, YEARS, MONTHS).select("t", "season_year")
    found = rows.join(F.broadcast(dates), "t").groupBy("site_id", "season_year", "member").agg(F.sum("l_quantity").alias("total"))
    return found


PANEL = """
items AS (SELECT s_nationkey AS site_id, CAST(l_shipdate AS DATE) AS t, l_linenumber AS member, l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS x
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS t FROM (SELECT CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem)),
sites AS (SELECT DISTINCT s_nationkey AS site_id FROM supplier),
daily AS (SELECT site_id, t, sum(q) AS q, min(e) / 1000 AS tn, max(e) / 1000 AS tx, min(d) * 1000 AS hn, max(d) * 1000 AS hx, avg(x) * 100 AS wi, avg(e) / 2000 AS so FROM items GROUP BY ALL),
obs AS (SELECT sites.site_id, days.t, coalesce(q, 0.0) AS p, tn, tx, CASE WHEN hn BETWEEN 0 AND 100 THEN hn END AS hn, CASE WHEN hx BETWEEN 0 AND 100 THEN hx END AS hx, wi, so
        FROM sites CROSS JOIN days LEFT JOIN daily USING (site_id, t)),
cube AS (SELECT site_id, year(t) AS season_year, t, month(t) AS month, date_diff('day', make_date(year(t), 7, 1), t) AS day, p FROM obs WHERE month(t) IN (7, 8, 9)),
totals AS (SELECT site_id, season_year, sum(p) AS total FROM cube GROUP BY ALL HAVING count(*) = 92),
limits AS (SELECT site_id, quantile_cont(total, 1.0::DOUBLE / 3) AS q33, quantile_cont(total, 2.0::DOUBLE / 3) AS q67 FROM totals GROUP BY site_id HAVING count(*) >= 3),
classes AS (SELECT site_id, season_year, total, CASE WHEN total <= q33 THEN 0 WHEN total <= q67 THEN 1 ELSE 2 END AS cat FROM totals JOIN limits USING (site_id)),
shares AS (SELECT *, [0.2::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE][cat + 1] / count(*) OVER (PARTITION BY site_id, cat) AS raw, count(*) OVER (PARTITION BY site_id) AS n FROM classes),
weights AS (SELECT site_id, season_year, cat, total, CASE WHEN sum(raw) OVER (PARTITION BY site_id) < 1 - 1e-9 THEN 1.0::DOUBLE / n ELSE raw END AS w,
                   CASE WHEN sum(raw) OVER (PARTITION BY site_id) < 1 - 1e-9 THEN 1 ELSE 0 END AS flags FROM shares),
members AS (SELECT site_id, year(t) AS season_year, member, sum(q) AS total FROM items WHERE month(t) IN (7, 8, 9) GROUP BY ALL),
dry AS (SELECT site_id, season_year, day, day - row_number() OVER (PARTITION BY site_id, season_year ORDER BY day) AS run FROM cube WHERE p < 1),
runs AS (SELECT site_id, season_year, min(day) AS start, count(*) AS length FROM dry GROUP BY site_id, season_year, run)
"""


def sql(body: str) -> str:
    return f"WITH {PANEL} {body}"


# --- sources and checks ----------------------------------------------------------------------------------------


@query("w_observations", sql("SELECT t, site_id, site_id // 5 AS y, site_id % 5 AS x, round(p, 6) AS PRCP, round(tn, 6) AS TMIN, round(tx, 6) AS TMAX, round(hn, 6) AS HUMIN, round(hx, 6) AS HUMAX, round(wi, 6) AS WIND, round(so, 6) AS SOLAR FROM obs"))
def _(spark, d):
    return obs(spark, d).select("t", "site_id", F.col("y").cast("bigint").alias("y"), "x", *p.VARIABLES)


@query("w_grid_check", sql("SELECT count(*) AS n_rows, count(DISTINCT (site_id, t)) AS n_keys, 0::BIGINT AS n_null_keys, count(*) FILTER (WHERE abs(site_id // 5) > 90) AS n_bad_latitude FROM obs"))
def _(spark, d):
    return p.validate_grid(p.observations(spark, d))


@query("w_units", "SELECT l_orderkey, l_linenumber, round(l_quantity * (5.0::DOUBLE / 9) - 160.0::DOUBLE / 9, 6) AS tmin, round(l_quantity / 3.6::DOUBLE, 6) AS wind FROM lineitem")
def _(spark, d):
    q = F.col("l_quantity")
    return p.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.to_canonical("TMIN", q, F.lit("°F")).alias("tmin"), scalar.to_canonical("WIND", q, F.lit("km h**-1")).alias("wind"))


@query("w_probabilities", "SELECT s_suppkey AS site_id, CASE WHEN s_acctbal > 0 THEN 0.2::DOUBLE END AS pb, CASE WHEN s_acctbal > 0 THEN 0.3::DOUBLE END AS pn, CASE WHEN s_acctbal > 0 THEN 0.5::DOUBLE END AS pa FROM supplier")
def _(spark, d):
    ok = F.col("s_acctbal") > 0
    return p.prepare_probabilities(p.table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"), F.lit(20.0).alias("pb"), F.lit(30.0).alias("pn"), F.when(ok, 50.0).otherwise(70.0).alias("pa")))


@query("w_nearest_axis", "WITH a AS (SELECT DISTINCT s_nationkey // 5 AS y FROM supplier), t AS (SELECT unnest(range(-2, 12)) / 2.0::DOUBLE AS target) SELECT target, CASE WHEN target BETWEEN (SELECT min(y) FROM a) AND (SELECT max(y) FROM a) THEN (SELECT min_by(y, abs(y - target) * 1000 + y) FROM a)::DOUBLE END AS source FROM t")
def _(spark, d):
    return p.nearest_axis(spark.range(-2, 12).select((F.col("id") / 2.0).alias("y")), p.table(spark, d, "supplier").select(F.expr("s_nationkey div 5").alias("y")), "y")


# --- calendar, totals, spells ----------------------------------------------------------------------------------

DJF = """WITH y AS (SELECT unnest(range(1995, 2001)) AS season_year), a AS (SELECT season_year, CAST(unnest(generate_series(make_date(season_year, 12, 1), make_date(season_year + 1, 3, 1) - 1, INTERVAL 1 DAY)) AS DATE) AS t FROM y)
SELECT season_year::INT AS season_year, (row_number() OVER (PARTITION BY season_year ORDER BY t) - 1)::INT AS day, t, month(t)::INT AS month FROM a WHERE NOT (month(t) = 2 AND day(t) = 29)"""


@query("w_calendar_djf", DJF)
def _(spark, d):
    return s.season_calendar(spark, (1995, 2000), (12, 1, 2))


@query("w_season_cube", sql("SELECT site_id, season_year::INT AS season_year, day::INT AS day, t, month::INT AS month, round(p, 6) AS PRCP FROM cube"))
def _(spark, d):
    return cube(spark, d).select("site_id", "season_year", "day", "t", "month", "PRCP")


@query("w_totals", sql("SELECT site_id, season_year::INT AS season_year, round(total, 6) AS total FROM totals"))
def _(spark, d):
    return totals(spark, d)


@query("w_dry_runs", sql("SELECT site_id, season_year::INT AS season_year, start::INT AS start, length FROM runs"))
def _(spark, d):
    return s.dry_runs(cube(spark, d))


STATS = sql("""
, lagged AS (SELECT *, lag(p) OVER (PARTITION BY site_id, season_year ORDER BY day) AS b FROM cube),
st AS (SELECT site_id, season_year, sum(p) AS total, count(*) FILTER (WHERE p >= 1) / count(*)::DOUBLE AS wf, avg(p) FILTER (WHERE p >= 1) AS wa,
  CASE WHEN least(var_pop(CASE WHEN b IS NOT NULL THEN p END), var_pop(b)) > 0 THEN corr(p, b) END AS la,
  CASE WHEN least(var_pop(CASE WHEN b IS NOT NULL THEN (p >= 1)::INT END), var_pop((b >= 1)::INT)) > 0 THEN corr((p >= 1)::INT, (b >= 1)::INT) END AS lo, count(p) AS vd FROM lagged GROUP BY ALL)
SELECT site_id, season_year::INT AS season_year, round(total, 6) AS total, round(wf, 6) AS wet_frequency, round(wa, 6) AS wet_amount, round(la, 6) AS lag1_amount, round(lo, 6) AS lag1_occurrence, vd AS valid_days,
  coalesce((SELECT max(length) FROM runs r WHERE r.site_id = st.site_id AND r.season_year = st.season_year), 0) AS max_dry_spell FROM st""")


@query("w_weather_statistics", STATS)
def _(spark, d):
    return s.weather_statistics(cube(spark, d), N_DAYS)


@query("w_max_dry_spell", sql("SELECT site_id, t.season_year::INT AS season_year, coalesce((SELECT max(length) FROM runs r WHERE r.site_id = t.site_id AND r.season_year = t.season_year), 0)::DOUBLE AS value, 1.0::DOUBLE AS event_observed FROM totals t"))
def _(spark, d):
    return s.max_dry_spell(rain(spark, d), YEARS)


#: Written from the rule: a day is an onset if it and the next two bring 20 mm, one of them wet, and no 8 dry days in a row
#: lie in the 30 days that follow it.
ONSET = sql("""
, w AS (SELECT site_id, year(t) AS season_year, date_diff('day', make_date(year(t), 5, 1), t) AS day, p FROM obs WHERE month(t) >= 5 AND year(t) BETWEEN 1995 AND 2000),
r AS (SELECT a.site_id, a.season_year, a.day, sum(b.p) AS rain, max(b.p) AS most FROM w a JOIN w b ON b.site_id = a.site_id AND b.season_year = a.season_year AND b.day BETWEEN a.day AND a.day + 2 WHERE a.day < 153 GROUP BY ALL),
dd AS (SELECT site_id, season_year, day, day - row_number() OVER (PARTITION BY site_id, season_year ORDER BY day) AS g FROM w WHERE p < 1),
sp AS (SELECT site_id, season_year, min(day) AS lo, max(day) AS hi FROM dd GROUP BY site_id, season_year, g),
good AS (SELECT r.* FROM r WHERE rain >= 20 AND most >= 1 AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.site_id = r.site_id AND sp.season_year = r.season_year AND least(sp.hi, r.day + 30) - greatest(sp.lo, r.day + 1) + 1 > 7)),
k AS (SELECT DISTINCT site_id, season_year FROM w)
SELECT k.site_id, k.season_year::INT AS season_year, coalesce(min(day), 153)::DOUBLE AS value, (count(day) > 0)::INT::DOUBLE AS event_observed FROM k LEFT JOIN good USING (site_id, season_year) GROUP BY ALL""")


@query("w_onset", ONSET)
def _(spark, d):
    return s.onset(rain(spark, d), (1995, 2000))


@query("w_onset_all_years", ONSET.replace("BETWEEN 1995 AND 2000", "BETWEEN 1995 AND 2001"))
def _(spark, d):
    """The search and its check end on 2 November, which the record has in all seven years."""
    return s.onset(rain(spark, d), YEARS)


#: Written from the rule: the first day of the search that 20 days without any rain follow.
CESSATION = sql("""
, w AS (SELECT site_id, year(t) AS season_year, date_diff('day', make_date(year(t), 9, 1), t) AS day, p FROM obs WHERE month(t) >= 9 AND year(t) BETWEEN 1995 AND 2000),
c AS (SELECT a.site_id, a.season_year, a.day FROM w a JOIN w b ON b.site_id = a.site_id AND b.season_year = a.season_year AND b.day BETWEEN a.day + 1 AND a.day + 20 WHERE a.day < 91 GROUP BY ALL HAVING sum(b.p) = 0),
k AS (SELECT DISTINCT site_id, season_year FROM w)
SELECT k.site_id, k.season_year::INT AS season_year, coalesce(min(day), 91)::DOUBLE AS value, (count(day) > 0)::INT::DOUBLE AS event_observed FROM k LEFT JOIN c USING (site_id, season_year) GROUP BY ALL""")


@query("w_cessation_rain", CESSATION)
def _(spark, d):
    return s.cessation_by_rain(rain(spark, d), (1995, 2000))


#: The bucket as a recursion over the days from 1 May on.
BALANCE = "WITH RECURSIVE " + PANEL + """
, w AS (SELECT site_id, year(t) AS season_year, date_diff('day', make_date(year(t), 5, 1), t) AS day, p FROM obs WHERE month(t) BETWEEN 5 AND 11 AND year(t) BETWEEN 1995 AND 2000),
b AS (SELECT site_id, season_year, 0::BIGINT AS day, greatest(0, least(70, p - 5)) AS soil FROM w WHERE day = 0
      UNION ALL SELECT b.site_id, b.season_year, w.day, greatest(0, least(70, soil + p - 5)) FROM b JOIN w ON w.site_id = b.site_id AND w.season_year = b.season_year AND w.day = b.day + 1)
SELECT site_id, season_year::INT AS season_year, coalesce(min(day) FILTER (WHERE day >= 123 AND soil <= 0) - 123, 91)::DOUBLE AS value, (count(*) FILTER (WHERE day >= 123 AND soil <= 0) > 0)::INT::DOUBLE AS event_observed FROM b GROUP BY ALL"""


@query("w_cessation_balance", BALANCE)
def _(spark, d):
    return s.cessation_by_balance(rain(spark, d), (1995, 2000))


# --- categories, weights, resampling ---------------------------------------------------------------------------


@query("w_tercile_limits", sql("SELECT site_id, round(q33, 6) AS q33, round(q67, 6) AS q67 FROM limits"))
def _(spark, d):
    return c.tercile_limits(totals(spark, d), "site_id")


HAZEN = sql("""
, v AS (SELECT site_id, list(total ORDER BY total) AS v, count(*) AS n FROM totals GROUP BY site_id HAVING count(*) >= 3),
h AS (SELECT *, least(greatest(n * (1.0::DOUBLE / 3) + 0.5, 1), n) AS h1, least(greatest(n * (2.0::DOUBLE / 3) + 0.5, 1), n) AS h2 FROM v)
SELECT site_id, round(v[floor(h1)::INT] + (h1 - floor(h1)) * (v[least(floor(h1)::INT + 1, n)] - v[floor(h1)::INT]), 6) AS q33,
  round(v[floor(h2)::INT] + (h2 - floor(h2)) * (v[least(floor(h2)::INT + 1, n)] - v[floor(h2)::INT]), 6) AS q67 FROM h""")


@query("w_hazen_limits", HAZEN)
def _(spark, d):
    return c.hazen_limits(totals(spark, d), "site_id")


@query("w_classes", sql("SELECT site_id, season_year::INT AS season_year, round(total, 6) AS total, cat FROM classes"))
def _(spark, d):
    return classes(spark, d)


@query("w_year_weights", sql("SELECT site_id, season_year::INT AS season_year, cat, round(w, 6) AS w, flags FROM weights"))
def _(spark, d):
    return weights(spark, d)


@query("w_effective_years", sql("SELECT site_id, round(1 / sum(w * w), 6) AS n_eff, count(*) AS n_years FROM weights GROUP BY site_id"))
def _(spark, d):
    return c.effective_years(weights(spark, d))


@query("w_weighted_mean", sql("SELECT site_id, round(sum(w * total) / sum(w), 6) AS mean FROM weights GROUP BY site_id"))
def _(spark, d):
    return c.weighted_mean(totals(spark, d), weights(spark, d).select("site_id", "season_year", "w"))


@query("w_weighted_median", sql(", u AS (SELECT *, sum(w) OVER (PARTITION BY site_id ORDER BY total, season_year) AS until, sum(w) OVER (PARTITION BY site_id) AS mass FROM weights) SELECT site_id, round(min(total), 6) AS q FROM u WHERE until >= 0.45 * mass - 1e-12 GROUP BY site_id"))
def _(spark, d):
    return c.weighted_quantile(totals(spark, d), weights(spark, d).select("site_id", "season_year", "w"), 0.45)


def _quantile_sql(p: str) -> str:
    """Quantile of the standard normal: the same published rational approximation, as text."""
    poly = lambda c, x: "(" * (len(c) - 1) + repr(c[0]) + "::DOUBLE" + "".join(f" * {x} + {k!r}::DOUBLE)" for k in c[1:])
    tail = lambda q: f"({poly(scalar.ACKLAM_C, q)} / ({poly(scalar.ACKLAM_D, q)} * {q} + 1))"
    r = f"(({p}) - 0.5)"
    middle = f"({poly(scalar.ACKLAM_A, f'({r} * {r})')} * {r} / ({poly(scalar.ACKLAM_B, f'({r} * {r})')} * {r} * {r} + 1))"
    return f"(CASE WHEN ({p}) < 0.02425 THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN ({p}) > 0.97575 THEN -{tail(f'sqrt(-2 * ln(1 - ({p})))')} ELSE {middle} END)"


SCORES = ", sc AS (SELECT a.site_id, a.season_year, (count(*) FILTER (WHERE b.total < a.total) + count(*) FILTER (WHERE b.total = a.total) / 2.0::DOUBLE + 0.5) / (count(*) + 1.0::DOUBLE) AS pr FROM totals a JOIN totals b ON b.site_id = a.site_id AND b.season_year BETWEEN 1995 AND 2000 GROUP BY ALL), zs AS (SELECT site_id, season_year, " + _quantile_sql("pr") + " AS z FROM sc)"
TAILS = ", tn AS (SELECT " + _quantile_sql("0.2::DOUBLE") + " AS a, " + _quantile_sql("0.5::DOUBLE") + " AS b), nf AS (SELECT -0.430727299295457::DOUBLE - a * 2 * 0.430727299295457::DOUBLE / (b - a) AS mu, 2 * 0.430727299295457::DOUBLE / (b - a) AS sigma FROM tn)"


@query("w_normal_scores", sql(SCORES + " SELECT site_id, season_year::INT AS season_year, round(z, 6) AS z FROM zs"))
def _(spark, d):
    return c.normal_scores(totals(spark, d), (1995, 2000))


@query("w_normal_scores_gamma")
def _(spark, d):
    return c.normal_scores(totals(spark, d), (1995, 2000), "gamma")


@query("w_tercile_normal", sql(TAILS + " SELECT site_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM sites, nf"))
def _(spark, d):
    return c.tercile_normal(forecast(spark, d))


RATIO = SCORES + TAILS + """, q0 AS (SELECT site_id, season_year, cat, w, flags, z * z / 2 - power((z - mu) / sigma, 2) / 2 AS lq FROM weights JOIN zs USING (site_id, season_year), nf),
q1 AS (SELECT *, exp(lq - max(lq) OVER (PARTITION BY site_id)) AS q FROM q0),
q2 AS (SELECT *, q * sum(w) OVER (PARTITION BY site_id, cat) / sum(q) OVER (PARTITION BY site_id, cat) AS s FROM q1)"""


@query("w_density_ratio_weights", sql(RATIO + " SELECT site_id, season_year::INT AS season_year, cat, round(s / sum(s) OVER (PARTITION BY site_id), 6) AS w, flags FROM q2"))
def _(spark, d):
    return c.tercile_pdf_ratio_weights(c.normal_scores(totals(spark, d), (1995, 2000)), classes(spark, d), forecast(spark, d))


@query("w_pdf_ratio", sql(SCORES + TAILS + ", r AS (SELECT site_id, season_year, z * z / 2 - power((z - mu) / sigma, 2) / 2 AS l FROM zs, nf) SELECT site_id, season_year::INT AS season_year, round(exp(l) / sum(exp(l)) OVER (PARTITION BY site_id), 6) AS w FROM r"))
def _(spark, d):
    z = c.normal_scores(totals(spark, d), (1995, 2000)).join(c.tercile_normal(forecast(spark, d)), "site_id")
    rows = z.select("site_id", "season_year", F.col("z").alias("value"), (-F.pow((F.col("z") - F.col("mu")) / F.col("sigma"), 2.0) / 2).alias("log_f"), (-F.col("z") * F.col("z") / 2).alias("log_c"))
    return c.pdf_ratio_weights(rows).select("site_id", "season_year", "w")


CLASS = """, x AS (SELECT site_id, season_year, cat, w, k AS class, count(*) FILTER (WHERE cat = k) OVER s AS n, sum(CASE WHEN cat = k THEN w ELSE 0 END) OVER s AS mass, sum(w) OVER s AS every FROM weights, unnest(range(3)) AS r(k) WINDOW s AS (PARTITION BY site_id, k))
SELECT site_id, class::INT AS class, season_year::INT AS season_year, round(CASE WHEN n = 0 THEN w / every WHEN cat <> class THEN 0 WHEN mass > 0 THEN w / mass ELSE 1.0::DOUBLE / n END, 6) AS w, n = 0 AS empty FROM x"""


@query("w_class_weights", sql(CLASS))
def _(spark, d):
    return c.class_weights(weights(spark, d))


@query("w_gamma_classes")
def _(spark, d):
    t = totals(spark, d)
    return c.classify_seasons(t, c.gamma_limits(t, climatology=(1995, 2000)))


@query("w_normal_classes", sql(", m AS (SELECT site_id, avg(total - 300) AS m, stddev_samp(total - 300) AS s FROM totals WHERE season_year <= 2000 GROUP BY site_id) SELECT site_id, season_year::INT AS season_year, round(total - 300, 6) AS total, CASE WHEN total - 300 <= m - 0.430727299295457::DOUBLE * s THEN 0 WHEN total - 300 <= m + 0.430727299295457::DOUBLE * s THEN 1 ELSE 2 END AS cat FROM totals JOIN m USING (site_id)"))
def _(spark, d):
    """Signed values: totals less 300."""
    return c.classify_values(totals(spark, d).withColumn("total", F.col("total") - 300), method="normal", climatology=(1995, 2000))


RANKS = """WITH i AS (SELECT n_nationkey AS season_year, n_regionkey * 1.0::DOUBLE AS value FROM nation), r AS (SELECT *, abs(value - 1.5) AS dist, row_number() OVER (ORDER BY abs(value - 1.5), season_year) AS i, count(*) OVER () AS n FROM i),
m AS (SELECT *, least(i / n::DOUBLE, 1) - least((i - 1) / n::DOUBLE, 1) AS mass FROM r), a AS (SELECT season_year, avg(mass) OVER (PARTITION BY dist) AS w FROM m) SELECT season_year, round(w / sum(w) OVER (), 6) AS w FROM a"""


@query("w_rank_weights", RANKS)
def _(spark, d):
    return c.rank_weights(p.table(spark, d, "nation").select(F.col("n_nationkey").alias("season_year"), F.col("n_regionkey").cast("double").alias("value")), 1.5)


DRAW = """, steps AS (SELECT site_id, season_year, w, sum(w) OVER (PARTITION BY site_id ORDER BY season_year) AS until FROM weights),
ends AS (SELECT site_id, season_year, until - w AS lo, CASE WHEN until >= max(until) OVER (PARTITION BY site_id) - 1e-12 THEN 2 ELSE until END AS hi, w FROM steps),
drawn AS (SELECT site_id, m AS member, (('0x' || substr(md5('42|year|' || site_id || '|' || m), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM sites, unnest(range(20)) AS r(m)),
donors AS (SELECT site_id, member, min(season_year) AS season_year FROM drawn JOIN ends USING (site_id) WHERE u >= lo AND u < hi AND w > 0 GROUP BY ALL)"""


@query("w_draw_years", sql(DRAW + " SELECT site_id, member::INT AS member, season_year::INT AS season_year FROM donors"))
def _(spark, d):
    return c.draw_years(weights(spark, d), 20, 42)


@query("w_resampled_seasons", sql(DRAW + " SELECT site_id, member::INT AS member, donors.season_year::INT AS season_year, day::INT AS day, round(p, 6) AS PRCP FROM donors JOIN cube USING (site_id, season_year)"))
def _(spark, d):
    return c.copy_seasons(c.draw_years(weights(spark, d), 20, 42), cube(spark, d))


SHUFFLE = """, e AS (SELECT site_id, member, total AS v, row_number() OVER (PARTITION BY site_id ORDER BY total, member) AS k FROM members WHERE season_year = 1998),
o AS (SELECT site_id, member, row_number() OVER (PARTITION BY site_id ORDER BY total, member) AS k FROM members WHERE season_year = 1997) SELECT site_id, o.member, round(v, 6) AS value FROM o JOIN e USING (site_id, k)"""


@query("w_schaake_shuffle", sql(SHUFFLE))
def _(spark, d):
    of = lambda y: members(spark, d).where(F.col("season_year") == y).select("site_id", "member", F.col("total").alias("value"))
    return c.schaake_shuffle(of(1998), of(1997), ["site_id"])


SHUFFLE_SEASONS = """, s AS (SELECT min(season_year) AS lo, max(season_year) AS hi FROM members),
e AS (SELECT site_id, season_year, total AS v, row_number() OVER (PARTITION BY site_id, season_year ORDER BY total, member) AS k FROM members),
o AS (SELECT site_id, CASE WHEN season_year = hi THEN lo ELSE season_year + 1 END AS season_year, member, row_number() OVER (PARTITION BY site_id, season_year ORDER BY total, member) AS k FROM members, s)
SELECT site_id, season_year::INT AS season_year, o.member, round(v, 6) AS value FROM o JOIN e USING (site_id, season_year, k)"""


@query("w_schaake_shuffle_seasons", sql(SHUFFLE_SEASONS))
def _(spark, d):
    """Every season in the order of the one before it, the first in that of the last."""
    rows = members_all(spark, d).select("site_id", "season_year", "member", F.col("total").alias("value"))
    lo, hi = rows.agg(F.min("season_year"), F.max("season_year")).first()
    template = rows.withColumn("season_year", F.when(F.col("season_year") == hi, lo).otherwise(F.col("season_year") + 1))
    return c.schaake_shuffle(rows, template, ["site_id", "season_year"])


STRATA = """, i AS (SELECT site_id, total AS v, row_number() OVER (PARTITION BY site_id ORDER BY total) - 1 AS i, count(*) OVER (PARTITION BY site_id) AS n FROM totals),
b AS (SELECT *, least(i + 1.0, (bin + 1) * n / 4.0::DOUBLE) - greatest(i, bin * n / 4.0::DOUBLE) AS part FROM i, unnest(range(4)) AS r(bin)) SELECT site_id, bin::INT AS bin, round(sum(part * v) / sum(part), 6) AS value FROM b WHERE part > 0 GROUP BY ALL"""


@query("w_stratified_quantiles", sql(STRATA))
def _(spark, d):
    return c.stratified_quantiles(totals(spark, d).select("site_id", F.col("total").alias("value")), 4)


# --- verification ----------------------------------------------------------------------------------------------

SEASONS = ["site_id", "season_year"]


def paired(spark, d):
    """Members' totals times 7 against the panel's totals."""
    return members(spark, d).select(*SEASONS, "member", (F.col("total") * 7).alias("value")), totals(spark, d).select(*SEASONS, F.col("total").alias("observed"))


CRPS = """, e AS (SELECT site_id, season_year, total * 7 AS v FROM members), k AS (SELECT e.*, t.total AS o, row_number() OVER (PARTITION BY e.site_id, e.season_year ORDER BY v) AS i, count(*) OVER (PARTITION BY e.site_id, e.season_year) AS m FROM e JOIN totals t USING (site_id, season_year))"""


@query("w_crps", sql(CRPS + " SELECT site_id, season_year::INT AS season_year, round(avg(abs(v - o)) - sum((2 * i - m - 1) * v / (m * m)), 6) AS crps FROM k GROUP BY ALL"))
def _(spark, d):
    e, o = paired(spark, d)
    return c.crps(e, o, SEASONS)


@query("w_crps_fair", sql(CRPS + " SELECT site_id, season_year::INT AS season_year, CASE WHEN max(m) > 1 THEN round(avg(abs(v - o)) - sum((2 * i - m - 1) * v / nullif(m * (m - 1), 0)), 6) END AS crps FROM k GROUP BY ALL"))
def _(spark, d):
    e, o = paired(spark, d)
    return c.crps(e, o, SEASONS, fair=True)


RANK = """, e AS (SELECT site_id, season_year, m.total * 7 AS v, t.total AS o FROM members m JOIN totals t USING (site_id, season_year)),
r AS (SELECT count(*) FILTER (WHERE v < o) AS b, count(*) FILTER (WHERE v = o) AS q FROM e GROUP BY site_id, season_year HAVING count(*) = 7),
x AS (SELECT b + j AS rank, sum(1.0::DOUBLE / (q + 1)) AS share FROM r, unnest(range(q + 1)) AS t(j) GROUP BY 1)
SELECT k::INT AS rank, round(coalesce(share, 0), 6) AS share FROM unnest(range(8)) AS t(k) LEFT JOIN x ON rank = k"""


@query("w_rank_histogram", sql(RANK))
def _(spark, d):
    e, o = paired(spark, d)
    return c.rank_histogram(e, o, SEASONS, 7)


FREQUENCIES = """, f AS (SELECT site_id, m.season_year, CASE WHEN m.total * 7 <= q33 THEN 0 WHEN m.total * 7 <= q67 THEN 1 ELSE 2 END AS cat FROM members m JOIN limits USING (site_id))"""


@query("w_tercile_frequencies", sql(FREQUENCIES + " SELECT site_id, round(avg((cat = 0)::INT), 6) AS pb, round(avg((cat = 1)::INT), 6) AS pn, round(avg((cat = 2)::INT), 6) AS pa, count(*) AS n FROM f GROUP BY site_id"))
def _(spark, d):
    m = members(spark, d).select("site_id", (F.col("total") * 7).alias("total"))
    return c.tercile_frequencies(m, c.tercile_limits(totals(spark, d), "site_id"))


@query("w_rps", sql("SELECT site_id, season_year::INT AS season_year, round(power(0.2::DOUBLE - (cat <= 0)::INT, 2) + power(0.5::DOUBLE - (cat <= 1)::INT, 2), 6) AS rps FROM classes"))
def _(spark, d):
    rows = classes(spark, d).join(forecast(spark, d), "site_id")
    return rows.select(*SEASONS, c.rps([F.col("pb"), F.col("pn")], F.col("cat")).alias("rps"))


PROBS = """, g AS (SELECT site_id, m.season_year, avg((m.total * 7 > q67)::INT) AS prob FROM members m JOIN limits USING (site_id) GROUP BY ALL), f AS (SELECT prob, (cat = 2)::INT::DOUBLE AS outcome FROM g JOIN classes USING (site_id, season_year))"""


def probabilities(spark, d):
    limits = c.tercile_limits(totals(spark, d), "site_id")
    m = members(spark, d).join(limits, "site_id").groupBy(*SEASONS).agg(F.avg((F.col("total") * 7 > F.col("q67")).cast("double")).alias("prob"))
    return m.join(classes(spark, d), SEASONS).select("prob", (F.col("cat") == 2).cast("double").alias("outcome"))


@query("w_reliability", sql(PROBS + ", b AS (SELECT least(floor(prob * 10 + 1e-12), 9)::INT AS bin, avg(prob) AS mf, avg(outcome) AS fo, count(*) AS n FROM f GROUP BY 1) SELECT k::INT AS bin, round(mf, 6) AS mean_forecast, round(fo, 6) AS observed_frequency, coalesce(n, 0) AS n FROM unnest(range(10)) AS r(k) LEFT JOIN b ON bin = k"))
def _(spark, d):
    return c.reliability(probabilities(spark, d))


BRIER = PROBS + """, g2 AS (SELECT prob, count(*) AS n, avg(outcome) AS o FROM f GROUP BY prob), a AS (SELECT avg(outcome) AS base, count(*) AS total, avg((prob - outcome) * (prob - outcome)) AS score FROM f),
r AS (SELECT sum(n / total * power(prob - o, 2)) AS rel, sum(n / total * power(o - base, 2)) AS res FROM g2, a)
SELECT round(score, 6) AS score, round(rel, 6) AS reliability, round(res, 6) AS resolution, round(base * (1 - base), 6) AS uncertainty, round(score - (rel - res + base * (1 - base)), 6) + 0 AS binning_residual, total AS count FROM r, a"""


@query("w_brier_decomposition", sql(BRIER))
def _(spark, d):
    return c.brier_decomposition(probabilities(spark, d)).withColumn("binning_residual", F.round("binning_residual", 6) + 0.0)


@query("w_wilson", sql(", k AS (SELECT site_id, count(*) FILTER (WHERE p >= 1) AS n_wet, count(*) AS n FROM cube GROUP BY site_id), z AS (SELECT *, n_wet / n::DOUBLE AS s, 3.841458820694124::DOUBLE AS z2 FROM k) SELECT site_id, n_wet, n, round(greatest(0, (s + z2 / (2 * n) - sqrt(z2) * sqrt(s * (1 - s) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS low, round(least(1, (s + z2 / (2 * n) + sqrt(z2) * sqrt(s * (1 - s) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS high FROM z"))
def _(spark, d):
    k = cube(spark, d).groupBy("site_id").agg(F.count_if(F.col("PRCP") >= 1).alias("n_wet"), F.count("PRCP").alias("n"))
    low, high = scalar.wilson_bounds(F.col("n_wet"), F.col("n"))
    return k.select("site_id", "n_wet", "n", low.alias("low"), high.alias("high"))


# --- stochastic models' fits -----------------------------------------------------------------------------------


@query("w_markov_fit", sql(", l AS (SELECT *, lag(p) OVER w AS b, lag(month) OVER w AS mb FROM cube WINDOW w AS (PARTITION BY site_id, season_year ORDER BY day)) SELECT site_id, month::INT AS month, round(count(*) FILTER (WHERE mb = month AND b < 1 AND p >= 1) / nullif(count(*) FILTER (WHERE mb = month AND b < 1), 0)::DOUBLE, 6) AS p01, round(count(*) FILTER (WHERE mb = month AND b >= 1 AND p >= 1) / nullif(count(*) FILTER (WHERE mb = month AND b >= 1), 0)::DOUBLE, 6) AS p11, round(count(*) FILTER (WHERE p >= 1) / count(*)::DOUBLE, 6) AS pi, round(avg(p) FILTER (WHERE p >= 1), 6) AS wet_mean, count(*) AS n FROM l GROUP BY site_id, month"))
def _(spark, d):
    return c.markov_fit(cube(spark, d))


#: Newton's method on the likelihood's equation, as a recursion; digamma by its recurrence and series, trigamma as a difference quotient.
GAMMA = """WITH RECURSIVE """ + PANEL + """
, g AS (SELECT site_id, month, avg(p - 1) AS mean, ln(avg(p - 1)) - avg(ln(p - 1)) AS a, count(*) AS n FROM cube WHERE p > 1 GROUP BY ALL),
k AS (SELECT site_id, month, mean, a, 0 AS i, CASE WHEN a > 5e-7 THEN (3 - a + sqrt((a - 3) * (a - 3) + 24 * a)) / (12 * a) END AS k FROM g
      UNION ALL SELECT site_id, month, mean, a, i + 1, k - (f - a) / ((f2 - f) / (k * 1e-6)) FROM (
        SELECT *, DG(k) AS f, DG(k * (1 + 1e-6)) AS f2 FROM k WHERE i < 12))
SELECT m.site_id, m.month::INT AS month, round(CASE WHEN mean IS NULL THEN 1 WHEN a > 5e-7 THEN k ELSE 1e6 END, 6) AS shape, round(CASE WHEN mean IS NULL THEN 1 WHEN a > 5e-7 THEN mean / k ELSE mean / 1e6 END, 6) AS scale,
  (CASE WHEN mean IS NULL THEN 2 WHEN a > 5e-7 THEN 0 ELSE 1 END)::INT AS status FROM (SELECT DISTINCT site_id, month FROM cube) m LEFT JOIN (SELECT * FROM k WHERE i = 12) USING (site_id, month)"""


def _digamma_sql(x: str) -> str:
    """ln x - digamma(x)"""
    y = f"({x} + 10)"
    series = f"ln{y} - 0.5 / {y} - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6))"
    return f"(ln({x}) - ({series} - (" + " + ".join(f"1 / ({x} + {i})" for i in range(10)) + ")))"


GAMMA = GAMMA.replace("DG(k * (1 + 1e-6))", _digamma_sql("(k * 1.000001::DOUBLE)")).replace("DG(k)", _digamma_sql("k"))


@query("w_gamma_fit", GAMMA)
def _(spark, d):
    return c.gamma_fit(cube(spark, d))


@query("w_site_distances", "WITH a AS (SELECT DISTINCT s_nationkey AS k, radians(s_nationkey // 5) AS y, radians(s_nationkey % 5) AS x FROM supplier) SELECT p.k AS a, q.k AS b, round(6371.0088::DOUBLE * sqrt(2 - 2 * (sin(p.y) * sin(q.y) + cos(p.y) * cos(q.y) * cos(p.x - q.x))), 5) AS km FROM a p JOIN a q ON p.k < q.k")
def _(spark, d):
    return c.site_distances(sites(spark, d)).withColumn("km", F.round("km", 5))


# --- states, runs and sums along a season ----------------------------------------------------------------------

STATES = ", ext AS (SELECT site_id, month, quantile_cont(p, 0.8::DOUBLE) AS extreme FROM cube WHERE p >= 1 GROUP BY ALL), st AS (SELECT site_id, season_year, day, month, CASE WHEN p < 1 THEN 0 WHEN p > extreme THEN 2 WHEN extreme IS NOT NULL THEN 1 END AS state FROM cube LEFT JOIN ext USING (site_id, month))"


@query("w_rain_states", sql(STATES + " SELECT site_id, season_year::INT AS season_year, day::INT AS day, month::INT AS month, state::INT AS state FROM st"))
def _(spark, d):
    return q.states(cube(spark, d))


@query("w_state_durations", sql(STATES + ", i AS (SELECT *, day - row_number() OVER (PARTITION BY site_id, season_year, state ORDER BY day) AS run FROM st) SELECT site_id, season_year::INT AS season_year, state::INT AS state, min(day)::INT AS start, count(*) AS length FROM i GROUP BY site_id, season_year, state, run"))
def _(spark, d):
    return q.state_durations(q.states(cube(spark, d)))


@query("w_state_transitions", sql(STATES + ", l AS (SELECT *, lag(state) OVER w AS before, lag(month) OVER w AS mb FROM st WINDOW w AS (PARTITION BY site_id, season_year ORDER BY day)), k AS (SELECT site_id, month, before, state AS after, count(*) AS n FROM l WHERE mb = month GROUP BY ALL) SELECT site_id, month::INT AS month, before::INT AS before, after::INT AS after, n, round(n / sum(n) OVER (PARTITION BY site_id, month, before), 6) AS share FROM k"))
def _(spark, d):
    return q.state_transitions(q.states(cube(spark, d)))


@query("w_dry_run_ending", sql(", r AS (SELECT *, count(*) FILTER (WHERE p >= 1) OVER (PARTITION BY site_id, season_year ORDER BY day) AS g FROM cube) SELECT site_id, season_year::INT AS season_year, day::INT AS day, count(*) FILTER (WHERE p < 1) OVER (PARTITION BY site_id, season_year, g ORDER BY day) * (p < 1)::INT AS length FROM r"))
def _(spark, d):
    return q.dry_run_ending(cube(spark, d))


@query("w_accumulation", sql("SELECT site_id, season_year::INT AS season_year, day::INT AS day, CASE WHEN count(p) OVER w = 5 THEN round(sum(p) OVER w, 6) END AS total FROM cube WINDOW w AS (PARTITION BY site_id, season_year ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)"))
def _(spark, d):
    return q.accumulation(cube(spark, d), 5)


@query("w_running_mean", sql(", a AS (SELECT site_id, season_year, day, unnest(range(-3, 4)) AS k FROM cube) SELECT a.site_id, a.season_year::INT AS season_year, a.day::INT AS day, round(avg(p), 6) AS mean FROM a JOIN cube c ON c.site_id = a.site_id AND c.season_year = a.season_year AND c.day = least(91, greatest(0, a.day + k)) GROUP BY ALL"))
def _(spark, d):
    return q.running_mean(cube(spark, d), 7)


@query("w_pooled_days", sql(", a AS (SELECT site_id, season_year, day, unnest(range(-2, 3)) AS shift FROM cube) SELECT a.site_id, a.season_year::INT AS season_year, a.day::INT AS day, shift::INT AS shift, round(p, 6) AS value FROM a JOIN cube c ON c.site_id = a.site_id AND c.season_year = a.season_year AND c.day = least(91, greatest(0, a.day + shift))"))
def _(spark, d):
    return q.pooled_days(cube(spark, d), 2)


@query("w_lagged", sql("SELECT c.site_id, c.season_year::INT AS season_year, c.day::INT AS day, round(c.p, 6) AS value, round(o.p, 6) AS before FROM cube c LEFT JOIN obs o ON o.site_id = c.site_id AND o.t = c.t - 1"))
def _(spark, d):
    return q.lagged(rain(spark, d), cube(spark, d))


@query("w_state_before", sql(", b AS (SELECT c.site_id, c.season_year, back, o.p >= 1 AS w FROM cube c, unnest(range(1, 31)) AS r(back) JOIN obs o ON o.site_id = c.site_id AND o.t = c.t - back::INT WHERE c.day = 0), f AS (SELECT site_id, season_year, w AS wet FROM b WHERE back = 1) SELECT site_id, season_year::INT AS season_year, wet, coalesce(min(back) FILTER (WHERE w <> wet) - 1, 30) AS length FROM b JOIN f USING (site_id, season_year) GROUP BY site_id, season_year, wet"))
def _(spark, d):
    return q.state_before(rain(spark, d), cube(spark, d), 30)


# --- grids -----------------------------------------------------------------------------------------------------


def cells(spark, sf_dir):
    """(season_year, iy, ix, y, x, total): seasonal totals on the grid of five columns."""
    at = F.col("site_id")
    return totals(spark, sf_dir).select("season_year", F.expr("site_id div 5").alias("iy"), (at % 5).alias("ix"), F.expr("site_id div 5").alias("y"), (at % 5).alias("x"), "total")


@query("w_block_mean", sql("SELECT season_year::INT AS season_year, (site_id // 5) // 2 AS iy, (site_id % 5) // 2 AS ix, round(avg(total), 6) AS mean FROM totals GROUP BY ALL"))
def _(spark, d):
    return g.block_mean(cells(spark, d), 2, ["season_year"], "total")


@query("w_bilinear", sql(", v AS (SELECT site_id // 5 AS y, site_id % 5 AS x, total FROM totals WHERE season_year = 1996), a AS (SELECT i / 2.0::DOUBLE AS y, j / 2.0::DOUBLE AS x FROM unnest(range(9)) AS r(i), unnest(range(10)) AS s(j)), k AS (SELECT a.y, a.x, sum((1 - abs(a.y - v.y)) * (1 - abs(a.x - v.x)) * total) AS total, sum((1 - abs(a.y - v.y)) * (1 - abs(a.x - v.x))) AS w FROM a JOIN v ON abs(a.y - v.y) < 1 AND abs(a.x - v.x) < 1 GROUP BY ALL) SELECT a.y, a.x, CASE WHEN w > 1 - 1e-9 THEN round(total, 6) END AS total FROM a LEFT JOIN k USING (y, x)"))
def _(spark, d):
    half = lambda n, name: spark.range(n).select((F.col("id") / 2.0).alias(name))
    return g.bilinear(cells(spark, d).where("season_year = 1996"), half(9, "y").crossJoin(F.broadcast(half(10, "x"))), "total")


BILINEAR_SEASONS = """, v AS (SELECT season_year, site_id // 5 AS y, site_id % 5 AS x, total FROM totals), a AS (SELECT season_year, i / 2.0::DOUBLE AS y, j / 2.0::DOUBLE AS x FROM (SELECT DISTINCT season_year FROM v), unnest(range(9)) AS r(i), unnest(range(10)) AS s(j)),
k AS (SELECT a.season_year, a.y, a.x, sum((1 - abs(a.y - v.y)) * (1 - abs(a.x - v.x)) * total) AS total, sum((1 - abs(a.y - v.y)) * (1 - abs(a.x - v.x))) AS w FROM a JOIN v ON a.season_year = v.season_year AND abs(a.y - v.y) < 1 AND abs(a.x - v.x) < 1 GROUP BY ALL)
SELECT a.season_year::INT AS season_year, a.y, a.x, CASE WHEN w > 1 - 1e-9 THEN round(total, 6) END AS total FROM a LEFT JOIN k USING (season_year, y, x)"""


@query("w_bilinear_seasons", sql(BILINEAR_SEASONS))
def _(spark, d):
    half = lambda n, name: spark.range(n).select((F.col("id") / 2.0).alias(name))
    return g.bilinear(cells(spark, d), half(9, "y").crossJoin(F.broadcast(half(10, "x"))), "total", ["season_year"])


@query("w_latitude_weights", "WITH a AS (SELECT DISTINCT s_nationkey // 5 AS y FROM supplier), b AS (SELECT y::DOUBLE AS y, sin(radians(y + 0.5)) - sin(radians(y - 0.5)) AS area FROM a) SELECT y, round(area / sum(area) OVER (), 6) AS weight FROM b")
def _(spark, d):
    return g.latitude_weights(p.table(spark, d, "supplier").select(F.expr("s_nationkey div 5").alias("y")))


# --- ensembles against training totals -------------------------------------------------------------------------

FOLDS = ", tr AS (SELECT site_id, total FROM members WHERE season_year BETWEEN 1992 AND 1996), ta AS (SELECT * FROM members WHERE season_year > 1996), lim AS (SELECT site_id, quantile_cont(total, 1.0::DOUBLE / 3) AS lo, quantile_cont(total, 2.0::DOUBLE / 3) AS hi FROM tr GROUP BY site_id)"


def folds(spark, sf_dir):
    m = members_all(spark, sf_dir)
    return m.where("season_year > 1996"), m.where("season_year BETWEEN 1992 AND 1996")


def members_all(spark, sf_dir):
    """(site_id, season_year, member, total) of all years, the season July to September."""
    rows = p.supplied_days(spark, sf_dir).where(F.month("t").isin(*MONTHS))
    return rows.groupBy("site_id", F.year("t").alias("season_year"), F.col("l_linenumber").alias("member")).agg(F.sum("l_quantity").alias("total"))


@query("w_model_tercile_probabilities", sql(FOLDS + " SELECT site_id, season_year::INT AS season_year, round(avg((total <= lo)::INT), 6) AS pb, round(avg((total > lo AND total <= hi)::INT), 6) AS pn, round(avg((total > hi)::INT), 6) AS pa FROM ta JOIN lim USING (site_id) GROUP BY ALL"))
def _(spark, d):
    target, train = folds(spark, d)
    return v.model_tercile_probabilities(target, train, ["site_id", "season_year"])


@query("w_ensemble_positions", sql(FOLDS + " SELECT site_id, season_year::INT AS season_year, member, round(((SELECT count(*) FILTER (WHERE tr.total < ta.total) + 0.5::DOUBLE * count(*) FILTER (WHERE tr.total = ta.total) + 1 FROM tr WHERE tr.site_id = ta.site_id)) / ((SELECT count(*) FROM tr WHERE tr.site_id = ta.site_id) + 2), 6) AS position FROM ta"))
def _(spark, d):
    target, train = folds(spark, d)
    return v.ensemble_positions(target, train).select("site_id", "season_year", "member", "position")


RPS = FOLDS + ", cl AS (SELECT site_id, season_year, avg((total <= lo)::INT) AS f0, avg((total <= hi)::INT) AS f1, count(*) AS n FROM ta JOIN lim USING (site_id) GROUP BY ALL), z AS (SELECT cl.*, c.cat FROM cl JOIN classes c USING (site_id, season_year)), s AS (SELECT *, power(f0 - (cat <= 0)::INT, 2) + power(f1 - (cat <= 1)::INT, 2) AS r FROM z)"


def classed_members(spark, sf_dir):
    target, train = folds(spark, sf_dir)
    limits = train.groupBy("site_id").agg(F.percentile("total", 1 / 3).alias("q33"), F.percentile("total", 2 / 3).alias("q67"))
    cat = c.classify(F.col("total"), F.col("q33"), F.col("q67"))
    seen = classes(spark, sf_dir).select("site_id", "season_year", F.col("cat").alias("seen"))
    return target.join(limits, "site_id").select("site_id", "season_year", cat.alias("cat")).join(seen, ["site_id", "season_year"])


@query("w_rps_ensemble", sql(RPS + " SELECT site_id, season_year::INT AS season_year, round(r, 6) AS rps FROM s"))
def _(spark, d):
    return v.rps_ensemble(classed_members(spark, d), ["site_id", "season_year"])


@query("w_rps_fair", sql(RPS + " SELECT site_id, season_year::INT AS season_year, CASE WHEN n > 1 THEN round(r - (f0 * (1 - f0) + f1 * (1 - f1)) / nullif(n - 1, 0), 6) END AS rps FROM s"))
def _(spark, d):
    return v.rps_ensemble(classed_members(spark, d), ["site_id", "season_year"], fair=True)


# --- the rain simulator ----------------------------------------------------------------------------------------

SIMULATED = """, l AS (SELECT *, lag(p) OVER w AS b, lag(month) OVER w AS mb FROM cube WINDOW w AS (PARTITION BY site_id, season_year ORDER BY day)),
fit AS (SELECT site_id, month, count(*) FILTER (WHERE mb = month AND b < 1 AND p >= 1) / nullif(count(*) FILTER (WHERE mb = month AND b < 1), 0)::DOUBLE AS p01, count(*) FILTER (WHERE mb = month AND b >= 1 AND p >= 1) / nullif(count(*) FILTER (WHERE mb = month AND b >= 1), 0)::DOUBLE AS p11, count(*) FILTER (WHERE p >= 1) / count(*)::DOUBLE AS pi, coalesce(avg(p) FILTER (WHERE p >= 1), 1) AS mean FROM l GROUP BY ALL),
par AS (SELECT site_id, month, coalesce(p01, pi) AS p01, coalesce(p11, pi) AS p11, pi, mean FROM fit),
cal AS (SELECT i AS day, month(make_date(1995, 7, 1) + i::INT) AS month FROM unnest(range(92)) AS r(i)),
draws AS (SELECT s, day, member, site_id, (('0x' || substr(md5('7|' || s || '|' || day || '|' || member || '|' || site_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM unnest([0, 1]) AS q(s), (SELECT day FROM cal UNION ALL SELECT -3) AS d(day), unnest(range(5)) AS m(member), (SELECT DISTINCT site_id FROM cube)),
chain AS (SELECT site_id, member, -1::BIGINT AS day, u < pi AS wet FROM draws JOIN par USING (site_id) WHERE s = 0 AND day = -3 AND month = 7
  UNION ALL SELECT k.site_id, k.member, k.day + 1, d.u < CASE WHEN k.wet THEN p11 ELSE p01 END FROM chain k JOIN cal ON cal.day = k.day + 1 JOIN par ON par.site_id = k.site_id AND par.month = cal.month JOIN draws d ON d.s = 0 AND d.day = cal.day AND d.member = k.member AND d.site_id = k.site_id)
SELECT k.site_id, k.member::INT AS member, k.day::INT AS day, CASE WHEN wet THEN round(1 - (mean - 1) * ln(1 - u), 6) ELSE 0 END AS PRCP FROM chain k JOIN cal USING (day) JOIN par USING (site_id, month) JOIN draws d ON d.s = 1 AND d.day = k.day AND d.member = k.member AND d.site_id = k.site_id WHERE k.day >= 0"""


@query("w_simulated_rain", sql(SIMULATED).replace("WITH", "WITH RECURSIVE", 1))
def _(spark, d):
    return simulate.simulate_rain(c.markov_fit(cube(spark, d)), [7] * 31 + [8] * 31 + [9] * 30, 5, 7)


# --- functions and checks by themselves --------------------------------------------------------------------------


@query("w_fixed_classes", sql("SELECT site_id, season_year::INT AS season_year, CASE WHEN total <= 800 THEN 0 WHEN total <= 1200 THEN 1 ELSE 2 END AS cat FROM totals"))
def _(spark, d):
    return totals(spark, d).select("site_id", "season_year", c.classify(F.col("total"), F.lit(800.0), F.lit(1200.0)).alias("cat"))


@query("w_latent", "WITH a AS (SELECT l_orderkey, l_linenumber, least(0.9999::DOUBLE, greatest(0.0001::DOUBLE, l_quantity * 2 / 100)) AS h, l_quantity AS w FROM lineitem) SELECT l_orderkey, l_linenumber, round(ln(h / (1 - h)), 6) AS humidity, round(ln(1 + w), 6) AS wind, round(100 * h, 6) AS humidity_back, round(w, 6) AS wind_back FROM a")
def _(spark, d):
    x = F.col("l_quantity")
    humidity, wind = scalar.to_latent("HUMAX", x * 2.0), scalar.to_latent("WIND", x)
    return p.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", humidity.alias("humidity"), wind.alias("wind"), scalar.from_latent("HUMAX", humidity).alias("humidity_back"), scalar.from_latent("WIND", wind).alias("wind_back"))


@query("w_kernel_correlation", "WITH a AS (SELECT n_nationkey AS k, n_nationkey * 50.0::DOUBLE AS km FROM nation) SELECT k, round(exp(-km / 300), 6) AS exponential, round(power(1 + km / 300, -1.5::DOUBLE), 6) AS heavy FROM a")
def _(spark, d):
    km = F.col("n_nationkey") * 50.0
    return p.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), c.kernel_correlation(km, "exponential", 300.0).alias("exponential"), c.kernel_correlation(km, "power", 300.0, 1.5).alias("heavy"))


@query("w_brier_fair", sql(FOLDS + ", f AS (SELECT site_id, season_year, avg((total > hi)::INT) AS f, count(*) AS n FROM ta JOIN lim USING (site_id) GROUP BY ALL) SELECT site_id, season_year::INT AS season_year, round(power(f - (cat = 2)::INT, 2), 6) AS brier, CASE WHEN n > 1 THEN round(power(f - (cat = 2)::INT, 2) - f * (1 - f) / nullif(n - 1, 0), 6) END AS fair FROM f JOIN classes USING (site_id, season_year)"))
def _(spark, d):
    shares = classed_members(spark, d).groupBy("site_id", "season_year").agg(F.avg((F.col("cat") == 2).cast("double")).alias("f"), F.max((F.col("seen") == 2).cast("double")).alias("o"), F.count(F.lit(1)).alias("n"))
    return shares.select("site_id", "season_year", scalar.brier(F.col("f"), F.col("o")).alias("brier"), v.brier_ensemble(F.col("f"), F.col("o"), F.col("n")).alias("fair"))


@query("w_box", sql("SELECT site_id, t, round(p, 6) AS PRCP FROM obs WHERE site_id // 5 BETWEEN 1 AND 3 AND site_id % 5 BETWEEN 2 AND 4"))
def _(spark, d):
    return p.observations(spark, d).where("y BETWEEN 1 AND 3 AND x BETWEEN 2 AND 4").select("site_id", "t", "PRCP")


@query("w_run_histogram", sql("SELECT site_id, month(make_date(season_year, 7, 1) + start::INT)::INT AS month, length, count(*) AS n FROM runs GROUP BY ALL"))
def _(spark, d):
    firsts = cube(spark, d).select("site_id", "season_year", F.col("day").alias("start"), "month")
    return s.dry_runs(cube(spark, d)).join(firsts, ["site_id", "season_year", "start"]).groupBy("site_id", "month", "length").agg(F.count(F.lit(1)).alias("n"))


@query("w_exact_align", sql("SELECT t, site_id, round(p, 6) AS PRCP, round(tx, 6) AS TMAX FROM obs"))
def _(spark, d):
    both = p.observations(spark, d)
    return p.exact_align(both.select("t", "site_id", "PRCP"), both.select("t", "site_id", "TMAX"), ["t", "site_id"])


@query("w_harmonics", sql("SELECT t, round(sin(2 * pi() * 2 * dayofyear(t) / 365.25::DOUBLE), 6) AS s, round(cos(2 * pi() * 2 * dayofyear(t) / 365.25::DOUBLE), 6) AS c FROM days"))
def _(spark, d):
    dates = p.observations(spark, d).select("t").distinct()
    sine, cosine = scalar.harmonics(F.col("t"), 2)
    return dates.select("t", sine.alias("s"), cosine.alias("c"))
