"""Cases of the sequence, grid and simulator operators that the queries' panel doesn't have."""

import pytest

from isohyet.operators import grids as g
from isohyet.operators import sequences as q
from isohyet.operators import simulate
from isohyet.operators import verification as v


def season(spark, rain):
    return spark.createDataFrame([(1, 2001, i, 7, x) for i, x in enumerate(rain)], "site_id int, season_year int, day int, month int, PRCP double")


def by_day(df, column):
    return [r[column] for r in df.orderBy("day").collect()]


def test_missing_days(spark):
    cube = season(spark, [0.0, 0.0, None, 0.0, 5.0, 0.0])
    assert by_day(q.dry_run_ending(cube), "length") == [1, 2, 0, 1, 0, 1]
    assert by_day(q.accumulation(cube, 2), "total") == [0.0, None, None, 5.0, 5.0, None]
    assert by_day(q.running_mean(cube, 3), "mean") == pytest.approx([0.0, None, None, None, 5 / 3, 5 / 3], nan_ok=True)
    runs = {(r.state, r.start): r.length for r in q.state_durations(q.states(cube)).collect()}
    assert runs == {(0, 0): 2, (0, 3): 1, (1, 4): 1, (0, 5): 1}
    assert {(r.before, r.after): r.n for r in q.state_transitions(q.states(cube)).collect()} == {(0, 0): 1, (0, 1): 1, (1, 0): 1}


def test_empty_season(spark):
    cube = season(spark, [])
    for df in (q.dry_run_ending(cube), q.accumulation(cube, 2), q.running_mean(cube, 3), q.pooled_days(cube, 1), q.states(cube)):
        assert df.count() == 0


def test_bilinear_next_to_a_missing_cell(spark):
    cells = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, 3.0), (1.0, 0.0, None), (1.0, 1.0, 7.0)], "y double, x double, v double")
    at = spark.createDataFrame([(0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (2.0, 0.0)], "y double, x double")
    assert {(r.y, r.x): r.v for r in g.bilinear(cells, at, "v").collect()} == {(0.0, 0.5): 2.0, (0.5, 0.5): None, (0.5, 1.0): 5.0, (2.0, 0.0): None}


def test_latitudes_end_at_the_poles(spark):
    w = {r.y: r.weight for r in g.latitude_weights(spark.createDataFrame([(-90.0,), (0.0,), (90.0,)], "y double")).collect()}
    assert sum(w.values()) == pytest.approx(1) and w[0.0] > w[90.0] == pytest.approx(w[-90.0])


def test_simulated_rain_is_of_the_chain_and_of_any_layout(spark):
    fit = spark.createDataFrame([(s, 7, 0.2, 0.7, 0.4, 9.0) for s in range(4)] + [(9, 8, 0.2, 0.7, 0.4, 9.0)], "site_id int, month int, p01 double, p11 double, pi double, wet_mean double")
    run = lambda df: {(r.site_id, r.member, r.day): r.PRCP for r in simulate.simulate_rain(df, [7] * 31, 50, 3).collect()}
    rain = run(fit)
    assert rain == run(fit.repartition(7)) and len(rain) == 4 * 50 * 31  # site 9 lacks the month
    wet = [x for x in rain.values() if x > 0]
    assert min(wet) >= 1 and len(wet) / len(rain) == pytest.approx(0.4, abs=0.03) and sum(wet) / len(wet) == pytest.approx(9, rel=0.06)


def test_fair_score_needs_two_members(spark):
    rows = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (2, 2, 1)], "k int, cat int, seen int")
    assert {r.k: r.rps for r in v.rps_ensemble(rows, ["k"], fair=True).collect()} == {1: None, 2: 0.0}
    assert {r.k: r.rps for r in v.rps_ensemble(rows, ["k"]).collect()} == {1: 0.0, 2: 0.5}


def test_positions_without_training_totals(spark):
    target = spark.createDataFrame([(1, 5.0), (2, 5.0)], "site_id int, total double")
    train = spark.createDataFrame([(1, 5.0), (1, 9.0)], "site_id int, total double")
    found = {r.site_id: (r.position, r.score) for r in v.ensemble_positions(target, train).collect()}
    assert found[1][0] == pytest.approx(0.375) and found[1][1] == pytest.approx(-0.318639, abs=1e-5) and found[2] == (None, None)
