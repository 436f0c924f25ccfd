"""Operators against DuckDB on the small tables, and rules that those tables don't exercise."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from isohyet.functions import scalar
from isohyet.operators import conditioning as c
from isohyet.operators import season as s
from isohyet.plans.queries import QUERIES, SQL
from isohyet.sources import panel

DATA = "/root/testdata/sf0.001"
CHECKED = ["w_totals", "w_year_weights", "w_weather_statistics", "w_onset", "w_draw_years", "w_crps_fair", "w_hazen_limits", "w_calendar_djf", "w_state_durations", "w_state_before", "w_bilinear", "w_rps_fair", "w_ensemble_positions", "w_simulated_rain"]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.5f}" if isinstance(v, (int, float)) else str(v)[:10]


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "supplier", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    wanted = con.sql(SQL[name])
    rows = sorted(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in found.collect())
    assert rows == sorted(tuple(plain(v) for _, v in sorted(zip(wanted.columns, r, strict=True))) for r in wanted.fetchall())
    assert sorted(found.columns) == sorted(wanted.columns)


@pytest.mark.parametrize("name", ["w_bilinear_seasons", "w_schaake_shuffle_seasons", "w_onset_all_years"])
def test_every_season(spark, name):
    test_same_as_sql(spark, name)
    assert QUERIES[name](spark, DATA).select("season_year").distinct().count() >= 7


def test_leap_february_and_contiguity(spark):
    rows = s.season_calendar(spark, (1995, 1996), (12, 1, 2)).collect()
    assert len(rows) == 180 and dt.date(1996, 2, 29) not in {r.t for r in rows}
    days = {r.t: r.day for r in s.season_calendar(spark, (1996, 1996), (1, 2, 3)).collect()}
    assert days[dt.date(1996, 3, 1)] == days[dt.date(1996, 2, 28)] + 1


def season(spark, rain, year=2001):
    first = dt.date(year, 7, 1)
    return spark.createDataFrame([(1, first + dt.timedelta(days=i), p) for i, p in enumerate(rain)], "site_id int, t date, PRCP double")


def test_missing_day_is_never_dry(spark):
    rain = [0.0] * 92
    rain[10] = None
    cube = s.seasonal_cube(season(spark, rain), (7, 8, 9), (2001, 2001))
    assert s.totals(cube, 92).first().total is None
    assert sorted((r.start, r.length) for r in s.dry_runs(cube).collect()) == [(0, 10), (11, 81)]
    assert s.seasonal_cube(season(spark, rain[:-1]), (7, 8, 9), (2001, 2001)).count() == 0


def test_ties_go_to_the_lower_class(spark):
    row = spark.range(1).select(c.classify(F.lit(2.0), F.lit(2.0), F.lit(3.0)).alias("a"), c.classify(F.lit(3.0), F.lit(2.0), F.lit(3.0)).alias("b"), c.classify(F.lit(None).cast("double"), F.lit(2.0), F.lit(3.0)).alias("m")).first()
    assert (row.a, row.b, row.m) == (0, 1, -1)


@pytest.mark.parametrize(("total", "valid"), [(0.98, True), (0.979, False), (100.0, True), (102.1, False)])
def test_probability_sums(spark, total, valid):
    row = panel.prepare_probabilities(spark.createDataFrame([(1, 0.2 * total, 0.3 * total, 0.5 * total)], "site_id int, pb double, pn double, pa double")).first()
    assert (row.pb is not None) == valid
    assert not valid or abs(row.pb + row.pn + row.pa - 1) < 1e-12


def test_inverted_ranges_are_null(spark):
    row = panel.canonicalize(spark.createDataFrame([(5.0, 3.0, -1.0, float("nan"))], "TMIN double, TMAX double, PRCP double, WIND double")).first()
    assert (row.TMIN, row.TMAX, row.PRCP, row.WIND) == (None, None, None, None)


def test_empty_category(spark):
    cats = spark.createDataFrame([(1, 2000, 0), (1, 2001, 0), (1, 2002, 2)], "site_id int, season_year int, cat int")
    prob = spark.createDataFrame([(1, 0.2, 0.3, 0.5)], "site_id int, pb double, pn double, pa double")
    assert {(round(r.w, 6), r.flags) for r in c.year_weights(cats, prob).collect()} == {(0.333333, 1)}
    assert sorted(round(r.w, 6) for r in c.year_weights(cats, prob, "renormalize").collect()) == [0.142857, 0.142857, 0.714286]


def test_onset_and_censoring(spark):
    days = [(1, dt.date(2001, 5, 1) + dt.timedelta(days=i), 10.0 if i in (5, 6) else 20.0 if i > 40 and i % 3 == 0 else 0.0) for i in range(200)]
    obs = spark.createDataFrame(days, "site_id int, t date, PRCP double")
    row = s.onset(obs, (2001, 2001)).first()
    assert row.value == 40.0 and row.event_observed == 1.0  # the first rains are a false start: a dry spell follows
    none = s.onset(obs.withColumn("PRCP", F.lit(0.0)), (2001, 2001)).first()
    assert (none.value, none.event_observed) == (153.0, 0.0)


def test_cessation_by_balance(spark):
    days = [(1, dt.date(2001, 5, 1) + dt.timedelta(days=i), 10.0 if i < 130 else 0.0) for i in range(214)]
    row = s.cessation_by_balance(spark.createDataFrame(days, "site_id int, t date, PRCP double"), (2001, 2001)).first()
    soil, want = 0.0, None
    for i in range(214):
        soil = min(70.0, max(0.0, soil + (10.0 if i < 130 else 0.0) - 5.0))
        if want is None and i >= 123 and soil <= 0:
            want = i - 123
    assert row.value == want and row.event_observed == 1.0


def test_inverse_normal(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.2, 0.5, 0.77, 0.99, 1 - 1e-6]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", scalar.inverse_normal(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-7 for r in rows)


def test_uniform_does_not_depend_on_partitions(spark):
    one = [r.u for r in spark.range(0, 100, 1, 1).select("id", scalar.uniform(F.lit(1), F.col("id")).alias("u")).orderBy("id").collect()]
    many = [r.u for r in spark.range(0, 100, 1, 7).select("id", scalar.uniform(F.lit(1), F.col("id")).alias("u")).orderBy("id").collect()]
    assert one == many and 0 < min(one) and max(one) < 1


def test_fair_score_of_one_member_is_null(spark):
    e = spark.createDataFrame([(1, 0, 2.0)], "k int, member int, value double")
    o = spark.createDataFrame([(1, 3.0)], "k int, observed double")
    assert c.crps(e, o, ["k"], fair=True).first().crps is None and c.crps(e, o, ["k"]).first().crps == 1.0
