"""Calendar, seasonal totals, dry spells, statistics and agro-climatic attributes.

A missing day never becomes a dry one: every aggregate counts the days that it
needs and is null where one is missing.  29 February is in no season.
"""

from __future__ import annotations

import calendar as months_of

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WET = 1.0


def validate_months(months: tuple[int, ...]) -> tuple[int, ...]:
    ok = months and all(isinstance(m, int) and 1 <= m <= 12 for m in months) and len(set(months)) == len(months) and all((b - a) % 12 == 1 for a, b in zip(months, months[1:], strict=False))
    if not ok:
        raise ValueError(f"months must be different, from 1 to 12 and follow one another: {months}")
    return tuple(months)


def season_calendar(spark: SparkSession, years: tuple[int, int], months: tuple[int, ...]) -> DataFrame:
    """(season_year, day, t, month): the dates of the seasons that start in the years from..to, February with 28 days."""
    months = validate_months(months)
    last = months[-1]
    wraps = int(last < months[0])
    starts = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("season_year"))
    first = F.make_date("season_year", F.lit(months[0]), F.lit(1))
    final = F.last_day(F.make_date(F.col("season_year") + wraps, F.lit(last), F.lit(1)))
    days = starts.select("season_year", F.explode(F.sequence(first, final)).alias("t")).where("NOT (month(t) = 2 AND day(t) = 29)")
    offset = F.datediff("t", F.make_date("season_year", F.lit(months[0]), F.lit(1)))
    # 29 February lies between the season's start and a later date: one day less.
    leap = F.make_date(F.year("t"), F.lit(3), F.lit(1))
    skipped = (F.col("t") >= leap) & (F.datediff(leap, F.make_date(F.year("t"), F.lit(2), F.lit(28))) == 2) & (F.make_date("season_year", F.lit(months[0]), F.lit(1)) < leap)
    return days.select("season_year", (offset - F.when(skipped, 1).otherwise(0)).alias("day"), "t", F.month("t").alias("month"))


def season_length(months: tuple[int, ...]) -> int:
    return sum(months_of.monthrange(2001, m)[1] for m in months)


def complete_seasons(days: DataFrame, months: tuple[int, ...], years: tuple[int, int]) -> DataFrame:
    """The calendar of the seasons all of whose dates are among ``days`` (t)."""
    dates = season_calendar(days.sparkSession, years, months)
    complete = dates.join(days, "t", "left_semi").groupBy("season_year").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == season_length(months))
    return dates.join(F.broadcast(complete.select("season_year")), "season_year", "left_semi")


def seasonal_cube(obs: DataFrame, months: tuple[int, ...], years: tuple[int, int] = (1990, 2010)) -> DataFrame:
    """The panel by season: (site_id, season_year, day, month, t, variables), only seasons all of whose dates are in
    the record; a missing value of a cell drops nothing."""
    kept = complete_seasons(obs.select("t").distinct(), months, years)
    return obs.join(F.broadcast(kept), "t")  # a calendar: one row a date of the years asked for


def totals(cube: DataFrame, n_days: int, *keys: str) -> DataFrame:
    """(site_id, season_year, total): null unless every day has a value."""
    return cube.groupBy("site_id", "season_year", *keys).agg(F.when(F.count("PRCP") == n_days, F.sum("PRCP")).alias("total"))


def dry_runs(cube: DataFrame, *keys: str, wet: float = WET) -> DataFrame:
    """(site_id, season_year, start, length) of dry runs; wet and missing days and gaps of dates end a run."""
    by = Window.partitionBy("site_id", "season_year", *keys).orderBy("day")
    dry = F.col("PRCP") < wet
    rows = cube.select("site_id", "season_year", *keys, "day", dry.alias("dry"))
    rows = rows.withColumn("new", F.when(F.col("dry") & F.coalesce(F.lag("dry").over(by), F.lit(False)) & (F.col("day") - F.lag("day").over(by) == 1), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(by)).where("dry")
    return rows.groupBy("site_id", "season_year", *keys, "run").agg(F.min("day").alias("start"), F.count(F.lit(1)).alias("length")).drop("run")


def weather_statistics(cube: DataFrame, n_days: int, wet: float = WET) -> DataFrame:
    """By site and season: total, wet frequency, mean wet amount, lag-1 correlations of amount and occurrence, the
    longest dry spell, valid days."""
    by = Window.partitionBy("site_id", "season_year").orderBy("day")
    p = F.col("PRCP")
    rows = cube.select("site_id", "season_year", "day", "PRCP", F.lag("PRCP").over(by).alias("before"), F.lag("day").over(by).alias("day_before"))
    paired = (F.col("day") - F.col("day_before") == 1) & p.isNotNull() & F.col("before").isNotNull()
    occurs = lambda x: F.when(x >= wet, 1.0).otherwise(0.0)
    pick = lambda x: F.when(paired, x)
    out = rows.groupBy("site_id", "season_year").agg(
        F.when(F.count("PRCP") == n_days, F.sum("PRCP")).alias("total"),
        F.try_divide(F.count_if(p >= wet).cast("double"), F.count("PRCP")).alias("wet_frequency"),
        F.avg(F.when(p >= wet, p)).alias("wet_amount"),
        _corr(pick(p), pick(F.col("before"))).alias("lag1_amount"),
        _corr(pick(occurs(p)), pick(occurs(F.col("before")))).alias("lag1_occurrence"),
        F.count("PRCP").alias("valid_days"),
    )
    longest = dry_runs(cube, wet=wet).groupBy("site_id", "season_year").agg(F.max("length").alias("longest"))
    return out.join(longest, ["site_id", "season_year"], "left").withColumn("max_dry_spell", F.when(F.col("valid_days") > 0, F.coalesce("longest", F.lit(0)))).drop("longest")


def _corr(x: Column, y: Column) -> Column:
    """Pearson's correlation of at least three pairs, null without variance."""
    return F.when(F.count(x) >= 3, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def window_calendar(spark: SparkSession, years: tuple[int, int], start: str, end: str, after: int = 0) -> DataFrame:
    """(season_year, day, t, inside): the dates of MM-DD windows and ``after`` more, without 29 February."""
    wraps = int(end < start)
    first = F.to_date(F.concat(F.col("season_year").cast("string"), F.lit(f"-{start}")))
    final = F.to_date(F.concat((F.col("season_year") + wraps).cast("string"), F.lit(f"-{end}")))
    rows = spark.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("season_year")).select("season_year", final.alias("final"), F.explode(F.sequence(first, F.date_add(final, after + 1))).alias("t"))
    rows = rows.where("NOT (month(t) = 2 AND day(t) = 29)")
    day = F.row_number().over(Window.partitionBy("season_year").orderBy("t")) - 1
    rows = rows.withColumn("day", day).withColumn("inside", F.col("t") <= F.col("final"))
    length = F.count_if("inside").over(Window.partitionBy("season_year"))
    return rows.withColumn("length", length).where(F.col("day") < F.col("length") + after).select("season_year", "day", "t", "inside", "length")


def windows(obs: DataFrame, years: tuple[int, int], start: str, end: str, after: int = 0) -> DataFrame:
    """(site_id, season_year, day, inside, length, PRCP) of all dates of the windows; null where the record has none."""
    dates = window_calendar(obs.sparkSession, years, start, end, after)
    sites = obs.select("site_id").distinct()
    grid = F.broadcast(dates).crossJoin(sites)  # the windows' dates for each site
    return grid.join(obs.select("site_id", "t", "PRCP"), ["site_id", "t"], "left").withColumn("PRCP", F.when(F.col("PRCP") >= 0, F.col("PRCP")))


def _onset_days(obs: DataFrame, years: tuple[int, int], search: tuple[str, str], amount: float, days: int, min_wet: int, dry_spell: int, check: int, wet: float) -> DataFrame:
    if days < 1 or min_wet < 1 or min(dry_spell, check) < 0 or min_wet > days or not amount > 0 or not wet > 0:
        raise ValueError("days and min_wet are at least 1, min_wet at most days, amount and wet positive, the others not negative")
    rows = windows(obs, years, *search, after=max(check, days - 1))
    by = Window.partitionBy("site_id", "season_year").orderBy("day")
    p = F.col("PRCP")
    ahead, back = by.rowsBetween(0, days - 1), by.rowsBetween(-dry_spell, 0)
    rows = rows.withColumns({"rain": F.coalesce(F.sum("PRCP").over(ahead), F.lit(0.0)), "wets": F.count_if(p >= wet).over(ahead), "known": F.count("PRCP").over(ahead), "dry": F.count_if(p < wet).over(back)})
    # The check begins on the day after the candidate; a spell that breaks it lies in it as a whole, and a gap is in no spell.
    checked = by.rowsBetween(1, max(check, 1))
    ends = by.rowsBetween(dry_spell + 1, check)
    broken = F.coalesce(F.max(F.when(F.col("dry") == dry_spell + 1, 1).otherwise(0)).over(ends), F.lit(0)) if check > dry_spell else F.lit(0)
    seen = F.count("PRCP").over(checked) if check else F.lit(0)
    rows = rows.withColumns({"broken": broken, "seen": seen})
    candidate = (F.col("rain") >= amount) & (F.col("wets") >= min_wet)
    whole, clear = F.col("known") == days, F.col("seen") == check
    good = candidate & whole & clear & (F.col("broken") == 0)
    unresolved = ~whole | (candidate & ~clear & (F.col("broken") == 0))
    return rows.withColumns({"good": good, "unresolved": unresolved})


def onset(obs: DataFrame, years: tuple[int, int], *, search: tuple[str, str] = ("05-01", "09-30"), amount: float = 20.0, days: int = 3, min_wet: int = 1, dry_spell: int = 7, check: int = 30, wet: float = WET) -> DataFrame:
    """(site_id, season_year, value, event_observed): first day whose ``days`` days from it on bring ``amount`` with at
    least ``min_wet`` wet days, without a dry spell longer than ``dry_spell`` in the ``check`` days after it.

    A gap matters only up to the first onset: a candidate that a gap leaves open before it makes the value null.
    Without onset the value is the window's length and event_observed is 0.
    """
    rows = _onset_days(obs, years, search, amount, days, min_wet, dry_spell, check, wet)
    first = rows.where("inside").groupBy("site_id", "season_year").agg(F.min(F.when(F.col("good"), F.col("day"))).alias("good"), F.min(F.when(F.col("unresolved"), F.col("day"))).alias("open"), F.max("length").alias("length"))
    return _event(first)


def _event(first: DataFrame) -> DataFrame:
    """The first sure event unless an undecided one comes before it; the window's length without any."""
    unresolved = F.col("open").isNotNull() & (F.col("good").isNull() | (F.col("open") < F.col("good")))
    value = F.when(~unresolved, F.coalesce(F.col("good"), F.col("length")).cast("double"))
    return first.select("site_id", "season_year", value.alias("value"), F.when(value.isNotNull(), F.col("good").isNotNull().cast("double")).alias("event_observed"))


def cessation_by_balance(obs: DataFrame, years: tuple[int, int], *, search: tuple[str, str] = ("09-01", "11-30"), balance_start: str = "05-01", capacity: float = 70.0, loss: float = 5.0, initial: float = 0.0) -> DataFrame:
    """(site_id, season_year, value, event_observed): first day of the search at which a soil bucket is empty.

    The bucket is an ordered fold over one window's days, whose number is fixed; a gap up to that day makes it null.
    """
    rows = windows(obs, years, balance_start, search[1])
    lead = F.datediff(F.to_date(F.concat(F.col("season_year").cast("string"), F.lit(f"-{search[0]}"))), F.to_date(F.concat(F.col("season_year").cast("string"), F.lit(f"-{balance_start}"))))
    days = rows.groupBy("site_id", "season_year").agg(F.array_sort(F.collect_list(F.struct("day", "PRCP"))).alias("days"), F.max("length").alias("length")).withColumn("lead", lead)
    start = F.struct(F.lit(initial).alias("soil"), F.lit(False).alias("gap"), F.lit(-1).alias("found"), F.lit(False).alias("unknown"))

    def step(a: Column, d: Column) -> Column:
        gap = a["gap"] | d["PRCP"].isNull()
        soil = F.greatest(F.lit(0.0), F.least(F.lit(capacity), a["soil"] + F.coalesce(d["PRCP"], F.lit(0.0)) - loss))
        hit = (a["found"] < 0) & ~gap & (d["day"] >= F.col("lead")) & (soil <= 0)
        return F.struct(soil.alias("soil"), gap.alias("gap"), F.when(hit, (d["day"] - F.col("lead")).cast("int")).otherwise(a["found"]).alias("found"), (a["unknown"] | (gap & (a["found"] < 0))).alias("unknown"))

    done = days.withColumn("r", F.aggregate("days", start, step))
    value = F.when(F.col("r.found") >= 0, F.col("r.found").cast("double")).when(~F.col("r.unknown"), (F.col("length") - F.col("lead")).cast("double"))
    return done.select("site_id", "season_year", value.alias("value"), F.when(value.isNotNull(), (F.col("r.found") >= 0).cast("double")).alias("event_observed"))


def cessation_by_rain(obs: DataFrame, years: tuple[int, int], *, search: tuple[str, str] = ("09-01", "11-30"), dry_days: int = 20) -> DataFrame:
    """First day of the search after which ``dry_days`` fully observed days bring no rain at all."""
    rows = windows(obs, years, *search, after=dry_days)
    ahead = Window.partitionBy("site_id", "season_year").orderBy("day").rowsBetween(1, dry_days)
    rows = rows.withColumns({"seen": F.count("PRCP").over(ahead), "rains": F.count_if(F.col("PRCP") > 0).over(ahead)})
    none = F.col("rains") == 0
    first = rows.where("inside").groupBy("site_id", "season_year").agg(F.min(F.when(none & (F.col("seen") == dry_days), F.col("day"))).alias("good"), F.min(F.when(none & (F.col("seen") < dry_days), F.col("day"))).alias("open"), F.max("length").alias("length"))
    return _event(first)


def dry_spell_after_onset(obs: DataFrame, years: tuple[int, int], *, length_days: int = 50, search: tuple[str, str] = ("05-01", "09-30"), wet: float = WET, **rule) -> DataFrame:
    """Longest dry run in the ``length_days`` days from the onset on; ``length_days`` without onset, null where the onset
    is unknown or a day is missing."""
    found = onset(obs, years, search=search, wet=wet, **rule)
    after = max(length_days - 1, rule.get("check", 30), rule.get("days", 3) - 1)
    rows = windows(obs, years, *search, after=after).join(found, ["site_id", "season_year"])
    rows = rows.where((F.col("event_observed") == 1) & (F.col("day") >= F.col("value")) & (F.col("day") < F.col("value") + length_days))
    known = rows.groupBy("site_id", "season_year").agg(F.count("PRCP").alias("known"), F.count(F.lit(1)).alias("n"))
    longest = dry_runs(rows, wet=wet).groupBy("site_id", "season_year").agg(F.max("length").alias("longest"))
    out = found.join(known, ["site_id", "season_year"], "left").join(longest, ["site_id", "season_year"], "left")
    value = F.when(F.col("event_observed") == 0, F.lit(float(length_days))).when(F.col("known") == F.col("n"), F.coalesce("longest", F.lit(0)).cast("double"))
    return out.select("site_id", "season_year", value.alias("value"), F.when(value.isNotNull(), F.col("event_observed")).alias("event_observed"))


def seasonal_total(obs: DataFrame, years: tuple[int, int], *, window: tuple[str, str] = ("07-01", "09-30")) -> DataFrame:
    """(site_id, season_year, value, event_observed): the rain of a window, null unless every day has a value."""
    rows = windows(obs, years, *window).where("inside").groupBy("site_id", "season_year").agg(F.count("PRCP").alias("known"), F.max("length").alias("length"), F.sum("PRCP").alias("rain"))
    value = F.when(F.col("known") == F.col("length"), F.col("rain"))
    return rows.select("site_id", "season_year", value.alias("value"), F.when(value.isNotNull(), 1.0).alias("event_observed"))


#: Attributes of a season by name, all with the columns site_id, season_year, value, event_observed.
ATTRIBUTES = {"total": seasonal_total, "onset": onset, "cessation": cessation_by_balance, "cessation_rain": cessation_by_rain}


def compute_attributes(obs: DataFrame, years: tuple[int, int], asked: dict[str, tuple[str, dict]]) -> DataFrame:
    """(site_id, season_year, name, value, event_observed) of several attributes: name to (kind, parameters)."""
    out = None
    for name, (kind, options) in asked.items():
        rows = (ATTRIBUTES | {"dry_spell": max_dry_spell, "dry_spell_after_onset": dry_spell_after_onset})[kind](obs, years, **options)
        rows = rows.select("site_id", "season_year", F.lit(name).alias("name"), "value", "event_observed")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no attribute is asked for")
    return out


def max_dry_spell(obs: DataFrame, years: tuple[int, int], *, window: tuple[str, str] = ("07-01", "09-30"), wet: float = WET) -> DataFrame:
    """Longest dry run inside the window, cut at its edges; null if a day is missing."""
    rows = windows(obs, years, *window).where("inside")
    known = rows.groupBy("site_id", "season_year").agg(F.count("PRCP").alias("known"), F.max("length").alias("length"))
    longest = dry_runs(rows, wet=wet).groupBy("site_id", "season_year").agg(F.max("length").alias("longest"))
    return known.join(longest, ["site_id", "season_year"], "left").select("site_id", "season_year", F.when(F.col("known") == F.col("length"), F.coalesce("longest", F.lit(0)).cast("double")).alias("value"), F.lit(1.0).alias("event_observed"))
