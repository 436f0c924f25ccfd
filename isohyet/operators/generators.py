"""Forecast-conditioned generators of daily seasons: parametric, analog, shuffled and nearest-neighbour."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_cdf, uniform
from ..sources.store import stored
from . import conditioning as c
from . import companions as cp
from . import constraints as k
from . import fields, rainfall
from . import resampling as r
from . import season as s
from . import semiparametric as sp

EVERY = [0, 1, 2]


def season_weights(totals: DataFrame, prob: DataFrame, *, climatology: tuple[int, int] | None = None, terciles: str = "empirical", weighting: str = "terciles", empty_policy: str = "climatology", constraints: list[k.SeasonalConstraint] | None = None, attributes: DataFrame | None = None, prior: DataFrame | None = None, total_tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(weights, limits) of historical seasons by terciles of totals, by densities, or by several attributes' forecasts."""
    make = {"empirical": lambda t: c.tercile_limits(t, "site_id", climatology=climatology), "hazen": lambda t: c.hazen_limits(c.reference(t, climatology), "site_id"), "gamma": lambda t: c.gamma_limits(t, climatology=climatology)}
    if terciles not in make or weighting not in ("terciles", "pdf_ratio", "mre", "croley"):
        raise ValueError("terciles are empirical, hazen or gamma; weighting is terciles, pdf_ratio, mre or croley")
    limits = make[terciles](totals)
    cats = c.classify_seasons(totals, limits)
    if weighting == "terciles":
        return c.year_weights(cats, prob, empty_policy), limits
    if weighting == "pdf_ratio":
        z = c.normal_scores(totals, climatology, "gamma" if terciles == "gamma" else "empirical")
        return c.tercile_pdf_ratio_weights(z, cats, prob, empty_policy=empty_policy), limits
    main = totals.select("site_id", "season_year", F.lit("forecast_total").alias("name"), F.col("total").alias("value"))
    values, probs, tolerances = main, prob.withColumn("name", F.lit("forecast_total")), {"forecast_total": total_tolerance}
    every = limits.withColumn("name", F.lit("forecast_total"))
    for one in constraints or []:
        mine = attributes.where(F.col("name") == one.name).select("site_id", "season_year", "name", "value")
        values = values.unionByName(mine)
        probs = probs.unionByName((prob if one.prob is None else one.prob).select("site_id", "pb", "pn", "pa", F.lit(one.name).alias("name")))
        as_total = mine.select("site_id", "season_year", F.col("value").alias("total"))
        own = k.fixed_limits(mine.select("site_id").distinct(), *one.limits) if one.limits else c.tercile_limits(as_total, "site_id", climatology=climatology, allow_negative=True)
        every = every.unionByName(own.withColumn("name", F.lit(one.name)).select(*every.columns))
        tolerances[one.name] = one.tolerance
    found = k.constrained_year_weights(values, probs, every, prior=prior, tolerances=tolerances, method=weighting)
    return found.join(cats.select("site_id", "season_year", "cat"), ["site_id", "season_year"], "left"), limits


@dataclass(frozen=True)
class WeatherGenerator:
    """Rain of a season, conditioned on a tercile forecast.

    Historical seasons are weighted so that their terciles have the forecast's
    probabilities; a chain of wet and dry days with random amounts is fitted to
    the weighted record by month, and run for each member and site with normal
    numbers that hang together in space.  ``mixture`` first draws a member's
    tercile and uses the parameters of that class, pulled to the mean by
    ``shrinkage`` (``moments``: so far that the classes' spread and the chain's
    own make up the observed variance of totals).

    ``three_states`` (options of ``semiparametric.fit_three_states``) replaces
    chain and amounts by three states with smoothed amounts.  ``companions``
    names other variables of the cube: their curves follow the same weights,
    their dependence is the whole record's.
    """

    months: tuple[int, ...] = (7, 8, 9)
    climatology: tuple[int, int] | None = (1991, 2020)
    wet: float = 1.0
    strict: bool = False
    terciles: str = "empirical"
    weighting: str = "terciles"
    empty_policy: str = "climatology"
    persistence: str = "climatology"
    amounts: str = "gamma"
    hold_alpha: bool = True
    basis: str = "excess"
    reset: bool = False
    by_amount: bool = False
    traces: bool = False
    occurrence: str = "markov"
    conditioning: str = "mean"
    shrinkage: float | str = "moments"
    class_draw: str = "shared"
    spatial: fields.Field | dict | None = None
    constraints: tuple = ()
    total_tolerance: float = 0.01
    three_states: dict | None = None
    companions: tuple[str, ...] = ()
    pairs: str = "sort"
    seed: int = 42
    train_years: tuple[int, ...] | None = None
    fitted: dict = field(default_factory=dict, compare=False)

    def __post_init__(self):
        s.validate_months(self.months)
        if self.occurrence not in ("markov", "spell") or self.conditioning not in ("mean", "mixture") or self.class_draw not in ("shared", "fitted"):
            raise ValueError("occurrence is markov or spell, conditioning mean or mixture, class_draw shared or fitted")
        if self.occurrence == "spell" and self.reset:
            raise ValueError("a chain with run lengths is not started anew each month")
        if self.class_draw == "fitted" and self.spatial is None:
            raise ValueError("classes from a field need one")
        if self.three_states is not None and (self.occurrence == "spell" or self.traces or self.conditioning == "mixture" and self.shrinkage == "moments"):
            raise ValueError("three states have neither run lengths nor traces, and no moments to shrink classes by")
        if set(self.companions) - set(cp.VARIABLES) or self.pairs not in ("sort", "none", "error"):
            raise ValueError(f"companions are among {cp.VARIABLES}; pairs is sort, none or error")

    def _options(self) -> dict:
        return {"wet": self.wet, "strict": self.strict, "persistence": self.persistence, "amounts": self.amounts, "basis": self.basis}

    def _fit(self, cube: DataFrame, weights: DataFrame, alphas: DataFrame | None) -> DataFrame:
        if self.three_states is not None:
            return sp.fit_three_states(cube, weights, wet=self.wet, **self.three_states)
        return rainfall.fit_rainfall(cube, weights, alphas=alphas, **self._options())

    def _fit_companions(self, cube: DataFrame, weights: DataFrame) -> dict:
        """Curves of the companions under the weights, and their dependence over the whole record."""
        n_days = s.season_length(self.months)
        plain = stored(cp.latent_panel(cube, self.companions, None, wet=self.wet, strict=self.strict), "generator-companions")
        left = cp.residuals(plain, stored(cp.fit_curves(plain, n_days), "generator-climate-curves"))
        found = {"dependence": stored(cp.fit_dependence(left, self.companions, list(self.months)), "generator-dependence")}
        weighted = plain.drop("w").join(weights.select("site_id", "season_year", "w"), ["site_id", "season_year"])
        return found | {"curves": stored(cp.fit_curves(weighted, n_days), "generator-curves")}

    def fit(self, cube: DataFrame, prob: DataFrame, sites: DataFrame, *, attributes: DataFrame | None = None, prior: DataFrame | None = None) -> WeatherGenerator:
        """The generator with ``fitted``: weights, limits, params, spells and, for a mixture, the classes' parameters.

        cube: (site_id, season_year, day, month, PRCP and companions) of complete calendars; prob: (site_id, pb, pn, pa).
        """
        if self.train_years is not None:
            cube = cube.where(F.col("season_year").isin(*self.train_years))
        totals = stored(s.totals(cube, s.season_length(self.months)), "generator-totals")
        if totals.select("season_year").distinct().limit(3).count() < 3:
            raise ValueError("at least three complete seasons are needed")
        weights, limits = season_weights(totals, prob, climatology=self.climatology, terciles=self.terciles, weighting=self.weighting, empty_policy=self.empty_policy, constraints=list(self.constraints), attributes=attributes, prior=prior, total_tolerance=self.total_tolerance)
        weights = stored(weights, "generator-weights")
        alphas = None
        if self.amounts == "mixed_exponential" and self.hold_alpha:
            known = weights.select("site_id", "season_year", (F.col("cat") >= 0).cast("double").alias("w"))
            alphas = stored(rainfall.fit_mixed_exponential(cube, known, wet=self.wet, strict=self.strict, basis=self.basis).select("site_id", "month", "alpha"), "generator-alphas")
        found = {"weights": weights, "limits": limits, "params": stored(self._fit(cube, weights, alphas), "generator-params"), "prob": prob, "sites": sites, "totals": totals}
        if self.companions:
            found |= self._fit_companions(cube, weights)
        if self.occurrence == "spell":
            found["spells"] = stored(rainfall.fit_spells(cube, weights, wet=self.wet, strict=self.strict), "generator-spells")
        if self.conditioning == "mixture":
            own = stored(c.class_weights(weights), "generator-classes")
            kappa = self._kappa(cube, own, alphas, totals, prob)
            if self.companions:
                curves = [self._class_curves(cube, own.where(F.col("class") == i)).withColumn("class", F.lit(i)) for i in EVERY]
                found["class_curves"] = stored(curves[0].unionByName(curves[1]).unionByName(curves[2]), "generator-class-curves")
            blend = own.join(weights.select("site_id", "season_year", F.col("w").alias("mean_w")), ["site_id", "season_year"]).join(kappa, "site_id")
            blend = blend.withColumn("w", (1 - F.col("kappa")) * F.col("mean_w") + F.col("kappa") * F.col("w"))
            params = [self._fit(cube, blend.where(F.col("class") == i), alphas).withColumn("class", F.lit(i)) for i in EVERY]
            found |= {"class_params": stored(params[0].unionByName(params[1]).unionByName(params[2]), "generator-class-params"), "kappa": kappa}
        return replace(self, fitted=found)

    def _class_curves(self, cube: DataFrame, weights: DataFrame) -> DataFrame:
        return cp.fit_curves(cp.latent_panel(cube, self.companions, weights, wet=self.wet, strict=self.strict), s.season_length(self.months))

    def _kappa(self, cube, own, alphas, totals, prob) -> DataFrame:
        """(site_id, kappa): how much of a class's own deviation stays in its members' parameters."""
        if self.shrinkage != "moments":
            return prob.select("site_id", F.lit(1.0 if self.shrinkage == "none" else float(self.shrinkage)).alias("kappa"))
        calendar = [int(x["month"]) for x in cube.select("day", "month").distinct().orderBy("day").collect()]  # a season's days
        moments = None
        for i, p in zip(EVERY, ("pb", "pn", "pa"), strict=True):
            one = rainfall.total_moments(self._fit(cube, own.where(F.col("class") == i), alphas), calendar, wet=self.wet, basis=self.basis)
            one = one.join(prob.select("site_id", F.col(p).alias("p")), "site_id")
            moments = one if moments is None else moments.unionByName(one)
        m = moments.groupBy("site_id").agg(F.sum(F.col("p") * F.col("variance")).alias("noise"), (F.sum(F.col("p") * F.pow("mean", F.lit(2.0))) - F.pow(F.sum(F.col("p") * F.col("mean")), F.lit(2.0))).alias("between"))
        seen = c.reference(totals, self.climatology).groupBy("site_id").agg(F.var_samp("total").alias("observed"))
        square = F.try_divide(F.col("observed") - F.col("noise"), F.col("between"))
        kappa = F.when(F.col("between") > 0, F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(square, F.lit(0.0)))))).otherwise(0.0)
        return stored(m.join(seen, "site_id", "left").select("site_id", kappa.alias("kappa")), "generator-kappa")

    def classes(self, members: int, member_start: int = 0) -> DataFrame:
        """(site_id, member, class): a member's tercile, one draw for all sites or a field's."""
        prob, sites = self.fitted["prob"], self.fitted["sites"]
        if self.class_draw == "fitted":
            at = self.spatial.get("season_class") if isinstance(self.spatial, dict) else self.spatial
            z = fields.sample(at, sites, member_start + members, 1, self.seed, "season_class").where(F.col("member") >= member_start)
            rows = z.select("site_id", "member", normal_cdf(F.col("z")).alias("u"))
        else:
            rows = sites.select("site_id", F.explode(F.sequence(F.lit(member_start), F.lit(member_start + members - 1))).alias("member")).withColumn("u", uniform(F.lit(self.seed), F.lit("class"), F.col("member")))
        rows = rows.join(prob, "site_id")
        pb, pn = F.coalesce("pb", F.lit(1 / 3)), F.coalesce("pn", F.lit(1 / 3))
        return rows.select("site_id", "member", F.when(F.col("u") <= pb, 0).when(F.col("u") <= pb + pn, 1).otherwise(2).alias("class"))

    def generate(self, year: int, members: int = 20, *, member_start: int = 0, allow_historical: bool = False) -> DataFrame:
        """(site_id, member, t, PRCP, tercile_class and companions) of the season that starts in ``year``."""
        if not self.fitted:
            raise RuntimeError("fit first")
        last = self.fitted["totals"].agg(F.max("season_year")).first()[0]
        if year <= last and not allow_historical:
            raise ValueError("the year lies in the training record; allow_historical says that this is meant")
        spark = self.fitted["params"].sparkSession
        dates = s.season_calendar(spark, (year, year), self.months).select("day", "t", "month")
        calendar = [int(x["month"]) for x in dates.orderBy("day").collect()]  # a season's days
        options = {"wet": self.wet, "strict": self.strict, "basis": self.basis, "reset": self.reset, "by_amount": self.by_amount, "traces": self.traces}
        classes = self.classes(members, member_start) if self.conditioning == "mixture" else None
        params = self.fitted["class_params"] if classes is not None else self.fitted["params"]
        sites, common = self.fitted["sites"], {"seed": self.seed, "member_start": member_start, "field": self.spatial}
        if self.three_states is not None:
            out = sp.simulate_three_states(params, sites, calendar, members, classes=classes, wet=self.wet, reset=self.reset, by_amount=self.by_amount, **common)
        else:
            out = rainfall.simulate(params, sites, calendar, members, spells=self.fitted.get("spells"), classes=classes, **common, **options)
        if self.companions:
            out = stored(out, "generated-rain")
            latent = cp.simulate_latent(self.fitted["dependence"], sites, calendar, members, **common)
            curves = self.fitted["class_curves"] if classes is not None else self.fitted["curves"]
            others = cp.simulate_companions(latent, curves, out, self.companions, wet=self.wet, strict=self.strict, pairs=self.pairs, classes=classes)
            out = out.join(others.drop("crossed"), ["site_id", "member", "day"], "left")
        out = out.join(F.broadcast(dates.select("day", "t")), "day")  # a season's days
        if classes is None:
            return out.select("site_id", "member", "t", "PRCP", F.lit(None).cast("int").alias("tercile_class"), *self.companions)
        return out.join(classes, ["site_id", "member"]).select("site_id", "member", "t", "PRCP", F.col("class").alias("tercile_class"), *self.companions)

    def diagnostics(self) -> dict:
        """What the fit came to, as plain values."""
        w, p = self.fitted["weights"], self.fitted["params"]
        flags = {str(x["flags"]): x["n"] for x in w.select("site_id", "flags").distinct().groupBy("flags").agg(F.count(F.lit(1)).alias("n")).collect()}
        implied = w.where("cat >= 0").groupBy("cat").agg((F.sum("w") / F.lit(max(1, w.select("site_id").distinct().count()))).alias("p")).collect()
        status = {str(x["status"]): x["n"] for x in p.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()} if "status" in p.columns else {}
        return {"months": list(self.months), "climatology": self.climatology, "weighting": self.weighting, "conditioning": self.conditioning, "amounts": self.amounts, "occurrence": self.occurrence, "seed": self.seed, "weight_flags": flags, "implied_probability": {str(x["cat"]): x["p"] for x in implied}, "gamma_status": status}

    def diagnostics_json(self) -> str:
        return json.dumps(self.diagnostics(), sort_keys=True)


#: Published set-ups: strict threshold of 0.1 mm, raw amounts, yearly transitions, a chain that starts anew each month; and
#: the chain with mixed exponential amounts whose mixing weight stays climatological.
PRESETS = {
    "monthly_gamma": {"wet": 0.1, "strict": True, "basis": "raw", "persistence": "yearly", "reset": True, "by_amount": True, "amounts": "gamma", "terciles": "hazen"},
    "monthly_mixed": {"wet": 0.1, "strict": True, "basis": "raw", "persistence": "yearly", "reset": True, "by_amount": True, "amounts": "mixed_exponential", "hold_alpha": False, "terciles": "hazen"},
    "three_states": {"wet": 0.1, "strict": True, "reset": True, "three_states": {}, "terciles": "hazen"},
    "fixed_mixing": {"wet": 1.0, "persistence": "climatology", "amounts": "mixed_exponential", "hold_alpha": True},
}


def preset(name: str, **options) -> WeatherGenerator:
    return WeatherGenerator(**(PRESETS[name] | options))


def regional_weights(weights: DataFrame, sites: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(season_year, w): the area mean of the sites' weights over sites that have any, times a prior, adding up to 1."""
    active = weights.groupBy("site_id").agg(F.sum("w").alias("mass")).where("mass > 0").select("site_id")
    rows = weights.join(active, "site_id").join(F.broadcast(r.area_weights(sites)), "site_id")  # one narrow row a site
    years = rows.groupBy("season_year").agg(F.sum(F.col("w") * F.col("area")).alias("w"))
    if prior is not None:
        years = years.join(prior.select("season_year", F.col("w").alias("p")), "season_year").withColumn("w", F.col("w") * F.col("p")).drop("p")
    return years.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(0))))  # one row a year


def analog_seasons(cube: DataFrame, weights: DataFrame, sites: DataFrame, members: int, seed: int = 42, prior: DataFrame | None = None) -> DataFrame:
    """(site_id, member, day, PRCP, donor_year): whole seasons of donors that all sites share, as they were observed."""
    region = regional_weights(weights, sites, prior).withColumn("site_id", F.lit(0).cast("bigint"))
    donors = c.draw_years(region, members, seed).select("member", F.col("season_year").alias("donor_year"))
    valid = weights.groupBy("site_id").agg(F.sum("w").alias("mass")).where("mass > 0").select("site_id")
    rows = cube.join(valid, "site_id", "left_semi").join(F.broadcast(donors), F.col("season_year") == F.col("donor_year"))  # one row a member
    return rows.select("site_id", "member", "day", "PRCP", "donor_year")


def shuffled_seasons(cube: DataFrame, weights: DataFrame, sites: DataFrame, days: int, members: int, *, window: int = 7, seed: int = 42) -> DataFrame:
    """(site_id, member, day, PRCP, template_year): each day's values drawn near that day from weighted years, site by
    site, and put in the order that whole historical seasons, the same for all days and sites, have among themselves.

    A draw whose day is missing is drawn anew among the observed ones by
    leaving missing days out beforehand.  Templates are distinct complete
    seasons if there are enough, else they repeat.
    """
    complete = cube.groupBy("season_year").agg(F.count("PRCP").alias("n"), F.count(F.lit(1)).alias("all")).where("n = all").select("season_year")
    order = Window.orderBy(uniform(F.lit(seed), F.lit("template"), F.col("season_year")))
    ranked = complete.withColumn("place", F.row_number().over(order) - 1).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # one row a year
    if ranked.limit(2).count() < 2:
        raise ValueError("templates need two complete seasons")
    places = cube.sparkSession.range(members).select(F.col("id").cast("int").alias("member"))
    templates = places.join(F.broadcast(ranked), F.col("member") % F.col("k") == F.col("place")).select("member", F.col("season_year").alias("template_year"))
    # The mass of a target day: weights of years times days of the window that were observed.
    near = cube.where("PRCP IS NOT NULL").select("site_id", "season_year", F.col("day").alias("donor_day"), "PRCP", F.explode(F.sequence(F.greatest(F.lit(0), F.col("day") - window), F.least(F.lit(days - 1), F.col("day") + window))).alias("day"))
    near = near.join(F.broadcast(weights.where("w > 0").select("site_id", "season_year", "w")), ["site_id", "season_year"])  # one narrow row a site and year
    by = Window.partitionBy("site_id", "day")
    until = F.sum("w").over(by.orderBy("season_year", "donor_day"))
    mass = F.sum("w").over(by)
    pool = near.withColumns({"hi": until / mass, "lo": (until - F.col("w")) / mass})
    pool = pool.groupBy("site_id", "day").agg(F.sort_array(F.collect_list(F.struct("hi", "PRCP"))).alias("pool"))  # years times the window's days
    asked = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("draw")).withColumn("u", uniform(F.lit(seed), F.lit("marginal"), F.col("site_id"), F.col("day"), F.col("draw")))
    hit = F.get(F.filter("pool", lambda x: x["hi"] > F.col("u")), F.lit(0))
    values = asked.withColumn("value", F.coalesce(hit["PRCP"], F.element_at("pool", -1)["PRCP"])).select("site_id", "day", F.col("draw").alias("member"), "value")
    values = r.ranks(values, ["site_id", "day"], seed, "member").select("site_id", "day", "rank", F.col("value").alias("PRCP"))
    shape = cube.join(F.broadcast(templates), F.col("season_year") == F.col("template_year")).select("site_id", "day", "member", "template_year", F.col("PRCP").alias("value"))  # one row a member
    shape = r.ranks(shape, ["site_id", "day"], seed + 1, "member")
    return shape.join(values, ["site_id", "day", "rank"]).select("site_id", "member", "day", "PRCP", "template_year")


def neighbour_dates(region: DataFrame, members: int, *, sample: list[int] | None = None, wet: float = 1.0, extreme: float = 0.8, window: int = 7, k_nearest: int | None = None, seed: int = 42, most: int = 1_000_000) -> DataFrame:
    """(member, day, season_year, donor_day, state): donor dates of a three-state chain with nearest-neighbour successors.

    region: (season_year, day, month, value) of one area's daily mean, at most
    ``most`` rows; ``sample``: the seasons to learn from, repeats counted.  A day
    is dry, wet or extreme by its month's quantile of wet days; the next state
    comes from the month's transitions, and the next day from the days within
    the window whose pair of states is the same, the k nearest in value with
    weights 1 / place (k: the root of their number).
    """
    rows = region.limit(most + 1).toPandas()
    if len(rows) > most or rows["value"].isna().any():
        raise ValueError("the region has too many days, or missing ones")
    table = rows.pivot(index="season_year", columns="day", values="value").sort_index()
    months = rows.groupby("day")["month"].first().sort_index().to_numpy(int)
    years = np.array(sample if sample is not None else list(table.index))
    x = table.loc[years].to_numpy(float)
    n_days = x.shape[1]
    limit = {}
    for m in np.unique(months):
        v = x[:, months == m]
        limit[m] = float(np.quantile(v[v >= wet], extreme)) if (v >= wet).any() else wet
    states_at = lambda v, q: np.where(v < wet, 0, np.where(v > q, 2, 1))
    own = states_at(x, np.array([limit[m] for m in months]))
    start = np.bincount(own[:, months == months[0]].ravel(), minlength=3) / max(1, (months == months[0]).sum() * len(x))
    move = {}
    for m in np.unique(months):
        to = np.flatnonzero(months[1:] == m) + 1
        share = np.bincount(own[:, months == m].ravel(), minlength=3).astype(float)
        counts = np.array([[((own[:, to - 1] == a) & (own[:, to] == b)).sum() for b in EVERY] for a in EVERY], float)
        move[m] = np.array([row / row.sum() if row.sum() else share / share.sum() for row in counts])
    scale = float(x.std(ddof=1)) or 1.0
    pools = {}
    for d in range(1, n_days):
        near = np.arange(max(0, d - 1 - window), min(n_days - 2, d - 1 + window) + 1)
        for width in (near, np.arange(n_days - 1)):  # the whole season where the window has no such pair
            a, b = states_at(x[:, width], limit[months[d - 1]]), states_at(x[:, width + 1], limit[months[d]])
            for i in EVERY:
                for j in EVERY:
                    if not len(pools.get((d, i, j), ((), ()))[0]):
                        at, day = np.nonzero((a == i) & (b == j))
                        pools[d, i, j] = (at, width[day])

    def run(batches):
        for batch in batches:
            for member in batch["id"]:
                rng = fields._generator(seed, "neighbours", member)
                state = int(rng.choice(3, p=start / start.sum()))
                first = np.argwhere(states_at(x[:, : window + 1], limit[months[0]]) == state)
                if not len(first):
                    first = np.argwhere(states_at(x, limit[months[0]]) == state)
                at, day = first[rng.integers(len(first))]
                out = [(int(member), 0, int(years[at]), int(day), state)]
                for d in range(1, n_days):
                    p = move[months[d]][state] * [len(pools[d, state, j][0]) > 0 for j in EVERY]
                    following = int(rng.choice(3, p=p / p.sum()))
                    rows_, days_ = pools[d, state, following]
                    gap = np.abs(x[rows_, days_] - x[at, day]) / scale
                    order = np.lexsort((rng.random(len(gap)), gap))[: k_nearest or max(1, int(np.sqrt(len(gap))))]
                    w = 1 / np.arange(1, len(order) + 1)
                    pick = order[rng.choice(len(order), p=w / w.sum())]
                    at, day, state = rows_[pick], days_[pick] + 1, following
                    out.append((int(member), d, int(years[at]), int(day), state))
                yield pd.DataFrame(out, columns=["member", "day", "season_year", "donor_day", "state"])

    return region.sparkSession.range(members).mapInPandas(run, "member int, day int, season_year int, donor_day int, state int")


def neighbour_seasons(cube: DataFrame, sites: DataFrame, members: int, **options) -> DataFrame:
    """(site_id, member, day, PRCP, season_year, donor_day, state): the fields of the donor dates of the area's mean."""
    area = r.area_weights(sites)
    region = cube.join(F.broadcast(area), "site_id").groupBy("season_year", "day", "month").agg((F.sum(F.col("PRCP") * F.col("area")) / F.sum("area")).alias("value"))  # one narrow row a site
    dates = neighbour_dates(region, members, **options)
    donors = cube.select("site_id", "season_year", F.col("day").alias("donor_day"), "PRCP")
    return donors.join(F.broadcast(dates), ["season_year", "donor_day"]).select("site_id", "member", "day", "PRCP", "season_year", "donor_day", "state")  # members times days


def bootstrap_years(classes: DataFrame, prob: tuple[float, float, float], n: int, seed: int = 42) -> list[int]:
    """n seasons, repeats counted, whose classes have the forecast's shares to the nearest whole number.  classes:
    (season_year, cat) of one region."""
    spark = classes.sparkSession
    shares = spark.createDataFrame([(0, i, float(p)) for i, p in enumerate(prob)], "region int, cat int, share double")
    counts = {x["cat"]: x["n"] for x in r.largest_remainder(shares, n, ["region"], "cat").collect()}  # three rows
    years = {}
    for x in classes.where("cat >= 0").select("season_year", "cat").orderBy("season_year").collect():  # one row a year
        years.setdefault(x["cat"], []).append(x["season_year"])
    if any(counts[i] and not years.get(i) for i in EVERY):
        raise ValueError("a category with probability has no years")
    rng = fields._generator(seed, "bootstrap")
    out = np.concatenate([rng.choice(years[i], counts[i]) for i in EVERY if counts[i]])
    rng.shuffle(out)
    return [int(y) for y in out]
