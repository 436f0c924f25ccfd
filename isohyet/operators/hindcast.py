"""Hindcast experiments: which years may be learned from, scores of a year, skill, daily verification, ensemble maps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import wilson_bounds
from ..sources.store import stored
from . import conditioning as c
from . import season as s

SITE_YEAR = ["site_id", "season_year"]


def training_years(years: list[int], target: int, scheme: str = "loyo", buffer: int = 0, block_size: int = 6) -> list[int]:
    """Years that may be learned from when ``target`` is forecast.

    ``loyo``: all but the target and ``buffer`` years on both sides; ``block``:
    all outside the run of ``block_size`` years that holds the target, and
    buffers around it; ``past_only``: those before the target less the buffer;
    ``in_sample``: all.
    """
    if not years or len(set(years)) != len(years) or target not in years or buffer < 0 or block_size < 1:
        raise ValueError("years are different and hold the target, buffer is not negative, block_size at least 1")
    if scheme == "in_sample":
        return list(years)
    if scheme == "past_only":
        return [y for y in years if y < target - buffer]
    if scheme == "loyo":
        first = last = target
    elif scheme == "block":
        order = sorted(years)
        start = order.index(target) // block_size * block_size
        block = order[start : start + block_size]
        first, last = block[0], block[-1]
    else:
        raise ValueError("scheme is loyo, block, past_only or in_sample")
    return [y for y in years if y < first - buffer or y > last + buffer]


def folds(years: list[int], scheme: str = "loyo", buffer: int = 0, block_size: int = 6) -> list[tuple[list[int], list[int]]]:
    """(targets, training years): years with the same training years share a fold, so a method is fitted once for them."""
    out: dict[tuple, list[int]] = {}
    for y in sorted(years):
        out.setdefault(tuple(training_years(years, y, scheme, buffer, block_size)), []).append(y)
    return [(targets, list(train)) for train, targets in out.items()]


def fold_limits(values: DataFrame, years: list[int], **scheme) -> DataFrame:
    """(site_id, season_year, q33, q67): each year's tercile limits from its own training years, in one pass: a year's
    values meet the targets that may learn from them, which are known beforehand."""
    pairs = [(t, y) for targets, train in folds(years, **scheme) for t in targets for y in train]
    allowed = F.broadcast(values.sparkSession.createDataFrame(pairs, "target int, season_year int"))  # years times years
    rows = values.select("site_id", "season_year", F.col("value").alias("total")).join(allowed, "season_year").select("site_id", F.col("target").alias("season_year"), "total")
    return c.tercile_limits(rows, *SITE_YEAR, allow_negative=True)


def year_scores(ensemble: DataFrame, observed: DataFrame, limits: DataFrame, area: DataFrame, climate: DataFrame) -> DataFrame:
    """(season_year, rps, rps_clim, crps, crps_clim, obs, ens_mean, spread2, err2): area means over sites that have both.

    ensemble: (site_id, season_year, member, value); observed: (site_id,
    season_year, observed); limits by site and year; climate: (site_id,
    season_year, value), the sample that stands for the climatological forecast.
    """
    cat = lambda v: c.classify(v, F.col("q33"), F.col("q67"))
    rows = ensemble.where("value IS NOT NULL").join(observed.where("observed IS NOT NULL"), SITE_YEAR).join(limits, SITE_YEAR, "left")
    share = lambda k: F.avg(F.when(cat(F.col("value")) >= 0, (cat(F.col("value")) <= k).cast("double")))
    sums = rows.groupBy(*SITE_YEAR, "observed", "q33", "q67").agg(share(0).alias("p0"), share(1).alias("p1"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    hit = lambda k: F.when(cat(F.col("observed")) >= 0, (cat(F.col("observed")) <= k).cast("double"))
    sums = sums.withColumns({"rps": F.pow(F.col("p0") - hit(0), 2.0) + F.pow(F.col("p1") - hit(1), 2.0), "rps_clim": F.pow(1 / 3 - hit(0), 2.0) + F.pow(2 / 3 - hit(1), 2.0)})
    sums = sums.join(c.crps(ensemble, observed, SITE_YEAR), SITE_YEAR, "left").join(c.crps(climate, observed, SITE_YEAR).withColumnRenamed("crps", "crps_clim"), SITE_YEAR, "left").join(F.broadcast(area), "site_id")  # one narrow row a site
    mean = lambda x: F.try_divide(F.sum(x * F.col("area")), F.sum(F.when(x.isNotNull(), F.col("area"))))
    named = {"rps": F.col("rps"), "rps_clim": F.col("rps_clim"), "crps": F.col("crps"), "crps_clim": F.col("crps_clim"), "obs": F.col("observed"), "ens_mean": F.col("mean"), "spread2": F.col("var"), "err2": F.pow(F.col("mean") - F.col("observed"), 2.0)}
    return sums.groupBy("season_year").agg(*[mean(x).alias(k) for k, x in named.items()])


def climate_sample(values: DataFrame, years: list[int], **scheme) -> DataFrame:
    """(site_id, season_year, value): for each target year the values of its training years."""
    pairs = [(t, y) for targets, train in folds(years, **scheme) for t in targets for y in train]
    allowed = F.broadcast(values.sparkSession.createDataFrame(pairs, "target int, season_year int"))  # years times years
    return values.select("site_id", "season_year", "value").join(allowed, "season_year").select("site_id", F.col("target").alias("season_year"), "value")


def skill(scores: DataFrame) -> DataFrame:
    """(method, attribute, years, rpss, crpss, correlation, spread_error, bias): skill against climatology over all years."""
    safe = lambda a, b: 1 - F.try_divide(a, b)
    return scores.groupBy("method", "attribute").agg(
        F.count(F.lit(1)).alias("years"), safe(F.avg("rps"), F.avg("rps_clim")).alias("rpss"), safe(F.avg("crps"), F.avg("crps_clim")).alias("crpss"),
        F.when(F.count("obs") >= 3, F.try_divide(F.covar_pop("obs", "ens_mean"), F.stddev_pop("obs") * F.stddev_pop("ens_mean"))).alias("correlation"),
        F.sqrt(F.try_divide(F.avg("spread2"), F.avg("err2"))).alias("spread_error"), F.avg(F.col("ens_mean") - F.col("obs")).alias("bias"),
    )


@dataclass
class HindcastExperiment:
    """Methods tried on each year with what may be learned for it, and scored by season attributes.

    A method is a function (training years, target years) to an ensemble
    (site_id, season_year, member, name, value) of attribute values.
    """

    observed: DataFrame
    area: DataFrame
    years: list[int]
    scheme: str = "loyo"
    buffer: int = 0
    block_size: int = 6
    methods: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, method: Callable[[list[int], list[int]], DataFrame]) -> HindcastExperiment:
        if name in self.methods:
            raise ValueError(f"a method named {name} is there already")
        self.methods[name] = method
        return self

    def _scheme(self) -> dict:
        return {"scheme": self.scheme, "buffer": self.buffer, "block_size": self.block_size}

    def hindcasts(self) -> DataFrame:
        """(method, site_id, season_year, member, name, value) of all methods and years."""
        out = None
        for name, method in self.methods.items():
            for targets, train in folds(self.years, **self._scheme()):
                if not train:
                    continue
                rows = method(train, targets).where(F.col("season_year").isin(*targets)).select(F.lit(name).alias("method"), *SITE_YEAR, "member", "name", "value")
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("no method, or no year has training years")
        return stored(out, "hindcasts")

    def yearly(self, hindcasts: DataFrame) -> DataFrame:
        """The scores of each method, attribute and year."""
        out = None
        for method in self.methods:
            for (name,) in hindcasts.where(F.col("method") == method).select("name").distinct().collect():  # attributes
                own = self.observed.where(F.col("name") == name).select(*SITE_YEAR, "value")
                ensemble = hindcasts.where((F.col("method") == method) & (F.col("name") == name))
                rows = year_scores(ensemble.select(*SITE_YEAR, "member", "value"), own.withColumnRenamed("value", "observed"), fold_limits(own, self.years, **self._scheme()), self.area, climate_sample(own, self.years, **self._scheme()))
                rows = rows.select(F.lit(method).alias("method"), F.lit(name).alias("attribute"), "*")
                out = rows if out is None else out.unionByName(rows)
        return out

    def reliability(self, hindcasts: DataFrame, name: str, method: str, category: int = 2, bins: int = 10) -> DataFrame:
        """The reliability table of one category's forecast probabilities, over sites and years."""
        own = self.observed.where(F.col("name") == name).select(*SITE_YEAR, "value")
        limits = fold_limits(own, self.years, **self._scheme())
        cat = c.classify(F.col("value"), F.col("q33"), F.col("q67"))
        known = lambda df: df.join(limits, SITE_YEAR).withColumn("cat", cat).where("cat >= 0")
        hit = (F.col("cat") == category).cast("double")
        prob = known(hindcasts.where((F.col("name") == name) & (F.col("method") == method))).groupBy(*SITE_YEAR).agg(F.avg(hit).alias("prob"))
        return c.reliability(known(own).select(*SITE_YEAR, hit.alias("outcome")).join(prob, SITE_YEAR).select("prob", "outcome"), bins)

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(yearly scores, skill)."""
        scores = stored(self.yearly(self.hindcasts()), "hindcast-scores")
        return scores, skill(scores)


def site_correlation(rows: DataFrame, by: list[str], most: int = 2500) -> DataFrame:
    """(by, corr): mean over site pairs of the correlation of concurrent values; at most ``most`` sites.  rows: (by, site_id,
    time, value)."""
    if rows.select("site_id").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} sites; give a sample of them")
    a, b = (rows.where("value IS NOT NULL").select(*by, "time", F.col("site_id").alias("s" + k), F.col("value").alias("v" + k)) for k in "ab")
    pairs = a.join(b, [*by, "time"]).where("sa < sb").groupBy(*by, "sa", "sb").agg(F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop("va", "vb"), F.stddev_pop("va") * F.stddev_pop("vb"))).alias("r"))
    return pairs.groupBy(*by).agg(F.avg("r").alias("corr"))


def daily_scores(observed: DataFrame, ensemble: DataFrame, members: int, wet: float = 1.0, fair: bool = False, seed: int = 0) -> DataFrame:
    """One row of daily verification over sites and days.

    observed: (site_id, time, observed); ensemble: (site_id, time, member,
    value).  Negative rain is missing; only days on which both sides have a
    value count.  Columns: crps, mae_median, spread_error, rank_index of all and
    of wet observations (sum of |share - 1/(M + 1)|), wet-day frequencies,
    intensities, 0.99 quantiles, mean site correlations and the wet share of
    cells on days with a wet mean, each of observations and members.
    """
    ok = lambda x: F.when((x >= 0) & ~F.isnan(x), x)
    keys = ["site_id", "time"]
    e = ensemble.select(*keys, "member", ok(F.col("value")).alias("value"))
    o = observed.select(*keys, ok(F.col("observed")).alias("observed")).where("observed IS NOT NULL")
    some = e.where("value IS NOT NULL").select(*keys).distinct()
    o = stored(o.join(some, keys, "left_semi"), "daily-observed")
    e = stored(e.join(o.select(*keys), keys, "left_semi"), "daily-ensemble")
    cell = e.where("value IS NOT NULL").groupBy(*keys).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.percentile("value", F.lit(0.5)).alias("median")).join(o, keys)
    out = cell.agg(F.avg(F.abs(F.col("median") - F.col("observed"))).alias("mae_median"), F.sqrt(F.try_divide(F.avg("var"), F.avg(F.pow(F.col("mean") - F.col("observed"), 2.0)))).alias("spread_error"))
    rows = [c.crps(e, o, keys).agg(F.avg("crps").alias("crps")), out]
    if fair:
        rows.append(c.crps(e, o, keys, fair=True).agg(F.avg("crps").alias("fair_crps")))
    for name, part in (("rank_index", o), ("rank_index_wet", o.where(F.col("observed") >= wet))):
        h = c.rank_histogram(e, part, keys, members, "random", seed).withColumn("whole", F.sum("share").over(Window.partitionBy(F.lit(0))))  # members + 1 rows
        rows.append(h.agg(F.sum(F.abs(F.try_divide("share", "whole") - 1 / (members + 1))).alias(name)))
    marginal = lambda x: (F.avg((x >= wet).cast("double")).alias("wet_"), F.avg(F.when(x >= wet, x)).alias("intensity_"), F.percentile(x, F.lit(0.99)).alias("q99_"))
    for which, df, x in (("obs", o, "observed"), ("sim", e.where("value IS NOT NULL"), "value")):
        one = df.agg(*marginal(F.col(x)))
        rows.append(one.select(*[F.col(k).alias(k + which) for k in one.columns]))
        own = df.select(*keys, F.col(x).alias("value"), *([F.lit(0).alias("member")] if which == "obs" else ["member"]))
        rows.append(site_correlation(own, ["member"]).agg(F.avg("corr").alias(f"site_corr_{which}")))
        field_ = own.groupBy("member", "time").agg(F.avg("value").alias("m"), F.sum((F.col("value") >= wet).cast("double")).alias("wets"), F.count("value").alias("n")).where(F.col("m") >= wet)
        rows.append(field_.groupBy("member").agg(F.try_divide(F.sum("wets"), F.sum("n")).alias("f")).agg(F.avg("f").alias(f"wet_fraction_{which}")))
    done = rows[0]
    for x in rows[1:]:
        done = done.crossJoin(F.broadcast(x))  # one row each
    return done


def ensemble_diagnostics(ensemble: DataFrame, reference_cube: DataFrame, prob: DataFrame, n_days: int, climatology: tuple[int, int] | None = None, wet: float = 1.0) -> DataFrame:
    """By site: tercile shares of members less the forecast, their Monte Carlo errors and Wilson bounds, limits, members with
    whole seasons, and mean statistics of members and of reference seasons.

    ensemble: (site_id, member, day, PRCP); reference_cube as seasonal cubes are.
    """
    totals = s.totals(reference_cube, n_days)
    limits = c.tercile_limits(totals, "site_id", climatology=climatology)
    as_seasons = ensemble.select("site_id", F.col("member").alias("season_year"), "day", "PRCP")
    made = s.weather_statistics(as_seasons, n_days, wet)
    shares = made.join(limits, "site_id").withColumn("cat", c.classify(F.col("total"), F.col("q33"), F.col("q67"))).where("cat >= 0")
    names = ("pb", "pn", "pa")
    shares = shares.groupBy("site_id", "q33", "q67").agg(F.count(F.lit(1)).alias("members"), *[F.count_if(F.col("cat") == k).alias("n_" + n) for k, n in enumerate(names)]).join(prob, "site_id", "left")
    columns = []
    for n in names:
        p = F.col("n_" + n) / F.col("members")
        low, high = wilson_bounds(F.col("n_" + n), F.col("members"))
        columns += [p.alias("share_" + n), (p - F.col(n)).alias("error_" + n), F.sqrt(p * (1 - p) / F.col("members")).alias("mc_" + n), low.alias("low_" + n), high.alias("high_" + n)]
    out = shares.select("site_id", "q33", "q67", "members", *columns)
    kept = ["total", "wet_frequency", "wet_amount", "lag1_amount", "lag1_occurrence", "max_dry_spell"]
    mean = lambda df, end: df.groupBy("site_id").agg(*[F.avg(k).alias(k + end) for k in kept])
    old = s.weather_statistics(reference_cube if climatology is None else reference_cube.where(F.col("season_year").between(*climatology)), n_days, wet)
    return out.join(mean(made, "_sim"), "site_id").join(mean(old, "_ref"), "site_id", "left")


def attribute_diagnostics(values: DataFrame, limits: DataFrame, prob: DataFrame) -> DataFrame:
    """(site_id, name, members, share_*, error_*, mean, censored): members' attribute classes against the forecasts.  values:
    (site_id, member, name, value, event_observed)."""
    rows = values.join(limits, ["site_id", "name"], "left").withColumn("cat", c.classify(F.col("value"), F.col("q33"), F.col("q67")))
    out = rows.groupBy("site_id", "name").agg(F.count_if(F.col("cat") >= 0).alias("members"), F.avg("value").alias("mean"), (1 - F.avg("event_observed")).alias("censored"), *[F.try_divide(F.count_if(F.col("cat") == k).cast("double"), F.count_if(F.col("cat") >= 0)).alias("share_" + n) for k, n in enumerate(("pb", "pn", "pa"))])
    return out.join(prob, ["site_id", "name"], "left").select("site_id", "name", "members", "mean", "censored", *["share_" + n for n in ("pb", "pn", "pa")], *[(F.col("share_" + n) - F.col(n)).alias("error_" + n) for n in ("pb", "pn", "pa")])


def finite_mean(x: Column) -> Column:
    """The mean of the finite values, null without any."""
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
