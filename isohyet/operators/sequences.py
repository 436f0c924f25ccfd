"""Runs, states, lags and sums along the days of a season.

Frames have site_id, season_year, day and a value; a missing day breaks a run
and leaves every sum over it null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEASON = ("site_id", "season_year")


def rain_state(rain: Column, wet: float, extreme: Column) -> Column:
    """0 dry, 1 wet, 2 extremely wet; null for a missing amount or limit."""
    return F.when(rain < wet, 0).when(rain > extreme, 2).when(rain.isNotNull() & extreme.isNotNull(), 1)


def extreme_limits(cube: DataFrame, wet: float, share: float) -> DataFrame:
    """(site_id, month, extreme): the quantile ``share`` of a month's wet amounts, by linear interpolation."""
    return cube.where(F.col("PRCP") >= wet).groupBy("site_id", "month").agg(F.percentile("PRCP", share).alias("extreme"))


def states(cube: DataFrame, wet: float = 1.0, share: float = 0.8) -> DataFrame:
    """(site_id, season_year, day, month, state)."""
    limits = extreme_limits(cube, wet, share)
    rows = cube.join(limits, ["site_id", "month"], "left")
    return rows.select(*SEASON, "day", "month", rain_state(F.col("PRCP"), wet, F.col("extreme")).alias("state"))


def state_durations(states_: DataFrame) -> DataFrame:
    """(site_id, season_year, state, start, length) of all runs, those at a season's ends included."""
    by = Window.partitionBy(*SEASON, "state").orderBy("day")
    rows = states_.where("state IS NOT NULL").withColumn("run", F.col("day") - F.row_number().over(by))
    return rows.groupBy(*SEASON, "state", "run").agg(F.min("day").alias("start"), F.count(F.lit(1)).alias("length")).drop("run")


def state_transitions(states_: DataFrame) -> DataFrame:
    """(site_id, month, before, after, n, share): neighbouring days of one month and season."""
    by = Window.partitionBy(*SEASON).orderBy("day")
    rows = states_.select("site_id", "month", F.col("state").alias("after"), F.lag("state").over(by).alias("before"), (F.lag("month").over(by) == F.col("month")).alias("same"), (F.col("day") - F.lag("day").over(by)).alias("gap"))
    n = rows.where("same AND gap = 1 AND before IS NOT NULL AND after IS NOT NULL").groupBy("site_id", "month", "before", "after").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("site_id", "month", "before"))
    return n.select("site_id", "month", "before", "after", "n", (F.col("n").cast("double") / total).alias("share"))


def dry_run_ending(cube: DataFrame, wet: float = 1.0) -> DataFrame:
    """(site_id, season_year, day, length): the dry run that ends at each day; 0 at a wet or missing one."""
    by = Window.partitionBy(*SEASON).orderBy("day")
    dry = F.coalesce(F.col("PRCP") < wet, F.lit(False))
    last = F.last(F.when(~dry, F.col("day")), ignorenulls=True).over(by)
    first = F.first("day").over(by)
    return cube.select(*SEASON, "day", F.when(dry, F.col("day") - F.coalesce(last, first - 1)).otherwise(0).cast("bigint").alias("length"))


def accumulation(cube: DataFrame, days: int, value: str = "PRCP") -> DataFrame:
    """(site_id, season_year, day, total): the sum from each day over ``days`` days, null unless all are there."""
    ahead = Window.partitionBy(*SEASON).orderBy("day").rangeBetween(0, days - 1)
    return cube.select(*SEASON, "day", F.when(F.count(value).over(ahead) == days, F.sum(value).over(ahead)).alias("total"))


def running_mean(cube: DataFrame, days: int, value: str = "PRCP") -> DataFrame:
    """(site_id, season_year, day, mean) over ``days`` days, the middle one being the day (the later of two middles);
    beyond a season's ends its first and last values are repeated."""
    by = Window.partitionBy(*SEASON).orderBy("day")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = days // 2, days - 1 - days // 2
    inside = by.rowsBetween(-before, after)
    i, n = F.row_number().over(by), F.count(F.lit(1)).over(whole)
    early, late = F.greatest(F.lit(0), before - i + 1), F.greatest(F.lit(0), i + after - n)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    total = F.sum(value).over(inside) + F.when(early > 0, early * first).otherwise(0.0) + F.when(late > 0, late * last).otherwise(0.0)
    return cube.select(*SEASON, "day", F.when(F.count(value).over(inside) == F.count(F.lit(1)).over(inside), total / days).alias("mean"))


def pooled_days(cube: DataFrame, reach: int, value: str = "PRCP") -> DataFrame:
    """(site_id, season_year, day, shift, value): each day with its neighbours up to ``reach`` days away, the season's
    first and last day standing for those beyond."""
    by = Window.partitionBy(*SEASON)
    near = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("shift")
    asked = cube.select(*SEASON, "day", F.min("day").over(by).alias("lo"), F.max("day").over(by).alias("hi")).select("*", near)
    asked = asked.withColumn("source", F.least("hi", F.greatest("lo", F.col("day") + F.col("shift")))).drop("lo", "hi")
    given = cube.select(*SEASON, F.col("day").alias("source"), F.col(value).alias("value"))
    return asked.join(given, [*SEASON, "source"], "left").select(*SEASON, "day", "shift", "value")


def lagged(obs: DataFrame, cube: DataFrame, value: str = "PRCP") -> DataFrame:
    """(site_id, season_year, day, value, before): the value of the calendar day before; a season's first day takes it
    from the record before the season."""
    by = Window.partitionBy(*SEASON).orderBy("day")
    given = obs.select("site_id", F.date_add("t", 1).alias("t"), F.col(value).alias("earlier"))
    head = cube.where("day = 0").select("site_id", "season_year", "t").join(given, ["site_id", "t"], "left").select(*SEASON, "earlier")
    rows = cube.select(*SEASON, "day", F.col(value).alias("value"), F.lag(value).over(by).alias("inner")).join(head, list(SEASON), "left")
    return rows.select(*SEASON, "day", "value", F.when(F.col("day") == 0, F.col("earlier")).otherwise(F.col("inner")).alias("before"))


def state_before(obs: DataFrame, cube: DataFrame, days: int, wet: float = 1.0) -> DataFrame:
    """(site_id, season_year, wet, length): whether the day before the season is wet, and for how many days up to
    ``days`` it has been so; null and 0 where that day is missing."""
    head = cube.where("day = 0").select("site_id", "season_year", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("back"), "t")
    head = head.select("site_id", "season_year", "back", F.date_sub("t", F.col("back")).alias("t"))
    rows = head.join(obs.select("site_id", "t", (F.col("PRCP") >= wet).alias("is_wet")), ["site_id", "t"], "left")
    first = rows.groupBy(*SEASON).agg(F.max(F.when(F.col("back") == 1, F.col("is_wet"))).alias("wet"))
    both = rows.join(first, list(SEASON))
    ends = both.groupBy(*SEASON, "wet").agg(F.min(F.when(~F.coalesce(F.col("is_wet") == F.col("wet"), F.lit(False)), F.col("back"))).alias("other"))
    return ends.select(*SEASON, "wet", F.coalesce(F.col("other") - 1, F.lit(days)).cast("bigint").alias("length"))
