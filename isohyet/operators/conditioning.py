"""Categories, historical-year weights, normal scores, resampling and reordering, verification scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip, inverse_normal, uniform
from ..functions.special import gammainc, gammaincinv, ndtri, weighted_gamma_mle

#: Flags of year weights: empty category, invalid forecast, no history.
EMPTY, INVALID, NO_HISTORY = 1, 2, 4
UPPER_TERCILE = 0.430727299295457  # of the standard normal distribution


def classify(value: Column, low: Column, high: Column) -> Column:
    """0 up to the lower limit, 1 up to the upper one, else 2; -1 where anything is missing."""
    return F.when(value.isNull() | low.isNull() | high.isNull(), -1).when(value <= low, 0).when(value <= high, 1).otherwise(2)


def reference(totals: DataFrame, climatology: tuple[int, int] | None, allow_negative: bool = False) -> DataFrame:
    """The totals that fix a climate: of the years from..to, finite, and not negative unless allowed."""
    x = F.col("total")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = ok if allow_negative else ok & (x >= 0)
    if climatology is not None:
        if climatology[0] > climatology[1]:
            raise ValueError("climatology is (first year, last year)")
        ok = ok & F.col("season_year").between(*climatology)
    return totals.where(ok)


def tercile_limits(totals: DataFrame, *keys: str, climatology: tuple[int, int] | None = None, allow_negative: bool = False) -> DataFrame:
    """(keys, q33, q67) by linear interpolation of order statistics; null with fewer than three values."""
    q = F.percentile("total", F.array(F.lit(1 / 3), F.lit(2 / 3)))
    enough = F.count("total") >= 3
    return reference(totals, climatology, allow_negative).groupBy(*keys).agg(F.when(enough, q[0]).alias("q33"), F.when(enough, q[1]).alias("q67"))


def gaussian_limits(values: DataFrame, key: str = "site_id", climatology: tuple[int, int] | None = None) -> DataFrame:
    """(key, q33, q67): mean and sample deviation at the normal terciles, for signed values such as temperatures."""
    rows = reference(values, climatology, True).groupBy(key).agg(F.avg("total").alias("m"), F.stddev_samp("total").alias("s"), F.count("total").alias("n"))
    enough = F.col("n") >= 3
    return rows.select(key, F.when(enough, F.col("m") - UPPER_TERCILE * F.col("s")).alias("q33"), F.when(enough, F.col("m") + UPPER_TERCILE * F.col("s")).alias("q67"))


def _gamma_of(sample: np.ndarray) -> tuple[float, float, float] | None:
    """(share of zeros, shape, scale) of a zero-inflated Gamma distribution, or None where it can't be told."""
    positive = sample[sample > 0]
    if len(positive) < 3 or positive.std() <= 1e-12 * max(positive.mean(), 1.0):
        return None
    shape, scale, status = weighted_gamma_mle(positive, np.ones(len(positive)))
    return (1 - len(positive) / len(sample), shape, scale) if status == 0 else None


def gamma_limits(totals: DataFrame, key: str = "site_id", climatology: tuple[int, int] | None = None) -> DataFrame:
    """(key, q33, q67) of a zero-inflated Gamma distribution; order statistics where it can't be fitted.  A group holds one
    value a year."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = group["total"].to_numpy()
        q = [None, None]
        if len(x) >= 3:
            q = np.quantile(x, [1 / 3, 2 / 3])
            if (found := _gamma_of(x)) is not None:
                dry, shape, scale = found
                wet = (np.array([1 / 3, 2 / 3]) - dry) / (1 - dry)
                q = gammaincinv(shape, np.maximum(wet, 0.0)) * scale
        return pd.DataFrame({key: [group[key].iloc[0]], "q33": [q[0]], "q67": [q[1]]}).astype({"q33": float, "q67": float})

    kind = totals.schema[key].dataType.simpleString()
    return reference(totals, climatology).select(key, "total").groupBy(key).applyInPandas(fit, f"{key} {kind}, q33 double, q67 double")


def hazen_limits(totals: DataFrame, key: str) -> DataFrame:
    """(key, q33, q67) with plotting positions (i - 1/2) / n, clipped to the sample."""
    ordered = totals.where("total IS NOT NULL").groupBy(key).agg(F.sort_array(F.collect_list("total")).alias("v"))  # one value a year

    def at(p: float) -> Column:
        h = clip(F.size("v") * F.lit(p) + 0.5, 1.0, 1e9)
        h = F.least(h, F.size("v").cast("double"))
        i = F.floor(h).cast("int")
        lo, hi = F.get("v", i - 1), F.get("v", F.least(i, F.size("v") - 1))
        return F.when(F.size("v") >= 3, lo + (h - i) * (hi - lo))

    return ordered.select(key, at(1 / 3).alias("q33"), at(2 / 3).alias("q67"))


def classify_seasons(totals: DataFrame, limits: DataFrame, allow_negative: bool = False) -> DataFrame:
    """(site_id, season_year, total, cat); negative totals count as missing unless allowed, and a site without limits
    has category -1 throughout."""
    x = F.col("total") if allow_negative else F.when(F.col("total") >= 0, F.col("total"))
    return totals.join(limits, "site_id", "left").select("site_id", "season_year", "total", classify(x, F.col("q33"), F.col("q67")).alias("cat"))


def classify_values(values: DataFrame, *, method: str = "empirical", climatology: tuple[int, int] | None = None) -> DataFrame:
    """Terciles of a signed seasonal value: by order statistics or, with ``normal``, by mean and deviation."""
    if method not in ("empirical", "normal"):
        raise ValueError("method is empirical or normal")
    limits = gaussian_limits(values, climatology=climatology) if method == "normal" else tercile_limits(values, "site_id", climatology=climatology, allow_negative=True)
    return classify_seasons(values, limits, allow_negative=True)


def year_weights(categories: DataFrame, prob: DataFrame, empty_policy: str = "climatology") -> DataFrame:
    """(site_id, season_year, cat, w, flags): the probability of a year's category, shared by the years in it.

    If a category with probability has no years, ``climatology`` weighs all
    years alike, ``renormalize`` shares its probability among the others and
    ``raise`` stops; the flag is 1.  An invalid forecast (flag 2) and a site
    without a classified year (flag 4) have weight 0; such a site without any
    row has one with a null year.
    """
    if empty_policy not in ("climatology", "renormalize", "raise"):
        raise ValueError("empty_policy is climatology, renormalize or raise")
    by_cat, by_site = Window.partitionBy("site_id", "cat"), Window.partitionBy("site_id")
    rows = categories.join(prob, "site_id", "full").withColumn("cat", F.coalesce("cat", F.lit(-1)))
    known = F.col("cat") >= 0
    p = F.when(F.col("cat") == 0, F.col("pb")).when(F.col("cat") == 1, F.col("pn")).when(F.col("cat") == 2, F.col("pa"))
    rows = rows.withColumns({"p": p, "n_cat": F.count(F.lit(1)).over(by_cat), "n": F.count_if(known).over(by_site)})
    rows = rows.withColumn("raw", F.when(known, F.col("p") / F.col("n_cat"))).withColumn("mass", F.sum("raw").over(by_site))
    invalid, none = F.col("pb").isNull(), F.col("n") == 0
    empty = ~invalid & ~none & F.coalesce(F.col("mass") < 1 - 1e-9, F.lit(False))
    alike = F.try_divide(F.lit(1.0), F.col("n"))
    if empty_policy == "climatology":
        filled = alike
    elif empty_policy == "renormalize":
        filled = F.coalesce(F.try_divide(F.col("raw"), F.col("mass")), alike)
    else:
        filled = F.raise_error(F.lit("a category with probability has no years")).cast("double")
    w = F.when(invalid | none | ~known, 0.0).when(empty, filled).otherwise(F.col("raw"))
    flag = lambda when, value: F.when(when, value).otherwise(0)
    return rows.select("site_id", "season_year", "cat", w.alias("w"), (flag(empty, EMPTY) + flag(invalid, INVALID) + flag(none, NO_HISTORY)).alias("flags"))


def pdf_ratio_weights(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` (keys, value, log_f, log_c) with w: the ratio of forecast to climatological density over all rows of a key.

    A null value or density weighs 0; a forecast density outside the climate's
    support raises; if ratios are infinite, those share all weight.
    """
    keys = keys or ("site_id",)
    inf = float("inf")
    there = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < inf)
    outside = there & (F.col("log_c") == -inf) & (F.abs("log_f") < inf)
    ok = there & (F.abs("log_c") < inf) & ~F.isnan("log_c") & (F.col("log_f") < inf) & ~F.isnan("log_f")
    ratio = F.when(outside, F.raise_error(F.lit("the forecast has density outside the climate's support")).cast("double")).when(ok, F.col("log_f") - F.col("log_c"))
    by = Window.partitionBy(*keys)
    out = rows.withColumn("ratio", ratio).withColumn("top", F.max("ratio").over(by))
    part = F.when(F.col("top") == inf, (F.col("ratio") == inf).cast("double")).when(F.col("top") > -inf, F.exp(F.col("ratio") - F.col("top"))).otherwise(0.0)
    out = out.withColumn("part", F.coalesce(part, F.lit(0.0))).withColumn("whole", F.sum("part").over(by))
    return out.withColumn("w", F.coalesce(F.try_divide("part", "whole"), F.lit(0.0))).drop("ratio", "top", "part", "whole")


def tercile_pdf_ratio_weights(scores: DataFrame, categories: DataFrame, prob: DataFrame, *, calibrate: bool = True, min_normal: float = 0.02, empty_policy: str = "renormalize") -> DataFrame:
    """(site_id, season_year, cat, w, flags): year weights by the density of the forecast's normal scores over that of the
    climate's; with ``calibrate`` the categories keep the masses of ``year_weights``, which also is the way out where
    no year has density."""
    base = year_weights(categories, prob, empty_policy)
    rows = base.join(scores, ["site_id", "season_year"], "left").join(tercile_normal(prob, min_normal), "site_id", "left")
    z = F.col("z")
    # The densities' common constant cancels.
    log_q = F.when(z.isNotNull() & (F.col("cat") >= 0), z * z / 2.0 - F.pow((z - F.col("mu")) / F.col("sigma"), 2.0) / 2.0 - F.ln("sigma"))
    by_site, by_cat = Window.partitionBy("site_id"), Window.partitionBy("site_id", "cat")
    rows = rows.withColumn("log_q", log_q).withColumn("q", F.coalesce(F.exp(F.col("log_q") - F.max("log_q").over(by_site)), F.lit(0.0)))
    if calibrate:
        shaped = F.coalesce(F.try_divide(F.col("q") * F.sum("w").over(by_cat), F.sum("q").over(by_cat)), F.col("w"))
        rows = rows.withColumn("shaped", F.when(F.col("cat") >= 0, shaped).otherwise(0.0))
    else:
        rows = rows.withColumn("shaped", F.col("q"))
    mass = F.sum("shaped").over(by_site)
    out = F.when(mass > 0, F.col("shaped") / mass).otherwise(F.col("w"))
    if empty_policy == "climatology":
        out = F.when(F.col("flags").bitwiseAND(EMPTY) != 0, F.col("w")).otherwise(out)
    out = F.when(F.col("flags").bitwiseAND(INVALID) != 0, 0.0).otherwise(out)
    return rows.select("site_id", "season_year", "cat", out.alias("w"), "flags")


def class_weights(weights: DataFrame) -> DataFrame:
    """(site_id, class, season_year, w, empty): for each category the weights of its years, adding up to 1.

    A category whose years weigh nothing shares alike among them; one without
    years takes the weights of all classified years.
    """
    rows = weights.where("season_year IS NOT NULL").withColumn("class", F.explode(F.array(*map(F.lit, range(3)))))
    of = Window.partitionBy("site_id", "class")
    inside, known = F.col("cat") == F.col("class"), F.col("cat") >= 0
    own = F.when(inside, F.greatest(F.col("w"), F.lit(0.0))).otherwise(0.0)
    all_ = F.when(known, F.col("w")).otherwise(0.0)
    rows = rows.withColumns({"n": F.count_if(inside).over(of), "mass": F.sum(own).over(of), "all": F.sum(all_).over(of)})
    w = F.when(F.col("n") == 0, F.coalesce(F.try_divide(all_, F.col("all")), F.lit(0.0))).when(F.col("mass") > 0, own / F.col("mass")).when(inside, 1.0 / F.col("n")).otherwise(0.0)
    return rows.select("site_id", "class", "season_year", w.alias("w"), (F.col("n") == 0).alias("empty"))


def effective_years(weights: DataFrame) -> DataFrame:
    """(site_id, n_eff, n_years): 1 over the sum of squared weights."""
    return weights.groupBy("site_id").agg((1.0 / F.sum(F.col("w") * F.col("w"))).alias("n_eff"), F.count(F.lit(1)).alias("n_years"))


def weighted_mean(values: DataFrame, weights: DataFrame, value: str = "total") -> DataFrame:
    """(site_id, mean): sum of weight times value over the sum of weights, null without mass."""
    return values.join(weights, ["site_id", "season_year"]).where(F.col(value).isNotNull()).groupBy("site_id").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("mean"))


def weighted_quantile(values: DataFrame, weights: DataFrame, p: float, value: str = "total") -> DataFrame:
    """(site_id, q): the least value at which the cumulated weight reaches the share p."""
    by = Window.partitionBy("site_id").orderBy(value, "season_year")
    rows = values.join(weights, ["site_id", "season_year"]).where(F.col(value).isNotNull() & (F.col("w") > 0))
    rows = rows.withColumns({"until": F.sum("w").over(by), "all": F.sum("w").over(Window.partitionBy("site_id"))})
    return rows.where(F.col("until") >= F.lit(p) * F.col("all") - 1e-12).groupBy("site_id").agg(F.min(value).alias("q"))


def normal_scores(totals: DataFrame, climatology: tuple[int, int] | None = None, method: str = "empirical") -> DataFrame:
    """(site_id, season_year, z): inverse normal of a total's place in the climate of the reference years.

    ``empirical``: (below + equal / 2 + 1/2) / (n + 1); ``gamma``: a
    zero-inflated Gamma distribution, where it can be fitted.  Null where the
    total is missing or negative, or fewer than three reference years are there.
    """
    if method not in ("empirical", "gamma"):
        raise ValueError("method is empirical or gamma")
    if method == "gamma":
        return _gamma_scores(totals, climatology)
    sample = reference(totals, climatology).groupBy("site_id").agg(F.collect_list("total").alias("sample"))  # one value a year
    x = F.when(F.col("total") >= 0, F.col("total"))
    count = lambda f: F.size(F.filter("sample", f)).cast("double")
    p = (count(lambda v: v < x) + count(lambda v: v == x) / 2.0 + 0.5) / (F.size("sample") + 1.0)
    z = F.when((F.size("sample") >= 3) & x.isNotNull(), inverse_normal(clip(p, 1e-6, 1 - 1e-6)))
    return totals.join(sample, "site_id", "left").select("site_id", "season_year", z.alias("z"))


def _gamma_scores(totals: DataFrame, climatology: tuple[int, int] | None) -> DataFrame:
    def score(group: pd.DataFrame) -> pd.DataFrame:
        x = group["total"].to_numpy(float)
        ok = np.isfinite(x) & (x >= 0)
        sample = x[ok & group["used"].to_numpy(bool)]
        z = np.full(len(x), np.nan)
        if len(sample) >= 3:
            if (found := _gamma_of(sample)) is not None:
                dry, shape, scale = found
                p = np.where(x[ok] > 0, dry + (1 - dry) * gammainc(shape, np.maximum(x[ok], 0) / scale), dry / 2)
            else:
                p = np.array([((sample < v).sum() + (sample == v).sum() / 2 + 0.5) / (len(sample) + 1) for v in x[ok]])
            z[ok] = ndtri(np.clip(p, 1e-6, 1 - 1e-6))
        return pd.DataFrame({"site_id": group["site_id"], "season_year": group["season_year"], "z": [None if np.isnan(v) else v for v in z]})

    used = F.lit(True) if climatology is None else F.col("season_year").between(*climatology)
    kinds = ", ".join(f"{k} {totals.schema[k].dataType.simpleString()}" for k in ("site_id", "season_year"))
    return totals.select("site_id", "season_year", "total", used.alias("used")).groupBy("site_id").applyInPandas(score, f"{kinds}, z double")


def tercile_normal(prob: DataFrame, min_normal: float = 0.02) -> DataFrame:
    """(site_id, mu, sigma): the normal distribution of scores whose tails beyond the terciles are pb and pa.

    Tails are at least 1e-4, and shrink together until the middle has
    ``min_normal``; null for an invalid forecast.
    """
    if not 0 < min_normal < 1:
        raise ValueError("min_normal lies between 0 and 1")
    pb, pa = clip(F.col("pb"), 1e-4, 1 - 1e-4), clip(F.col("pa"), 1e-4, 1 - 1e-4)
    shrink = F.least(F.lit(1.0), F.lit(1 - min_normal) / (pb + pa))
    a, b = inverse_normal(pb * shrink), inverse_normal(1 - pa * shrink)
    sigma = F.when(F.col("pb").isNotNull() & F.col("pa").isNotNull(), F.lit(2 * UPPER_TERCILE) / (b - a))
    return prob.select("site_id", (F.lit(-UPPER_TERCILE) - a * sigma).alias("mu"), sigma.alias("sigma"))


def rank_weights(index: DataFrame, target: float, strength: float = 1.0, selection: float = 1.0) -> DataFrame:
    """(season_year, w): years by the distance of their index, with the mass of their rank; ties share the mean."""
    n = index.where("value IS NOT NULL").count()  # one row a year
    upper = lambda i: F.pow(F.least(F.lit(selection) * i / F.lit(float(max(n, 1))), F.lit(1.0)), 1.0 / strength)
    by = Window.partitionBy(F.lit(0)).orderBy("distance", "season_year")
    rows = index.where("value IS NOT NULL").withColumn("distance", F.abs(F.col("value") - target)).withColumn("i", F.row_number().over(by))
    rows = rows.withColumn("mass", upper(F.col("i")) - upper(F.col("i") - 1)).withColumn("w", F.avg("mass").over(Window.partitionBy("distance")))
    return rows.select("season_year", F.try_divide("w", F.sum("w").over(Window.partitionBy(F.lit(0)))).alias("w"))


def draw_years(weights: DataFrame, members: int, seed: int) -> DataFrame:
    """(site_id, member, season_year): a donor year for each member by inverse cumulated weight, seeded by counters."""
    by = Window.partitionBy("site_id").orderBy("season_year")
    steps = weights.withColumn("until", F.sum("w").over(by)).withColumn("from", F.col("until") - F.col("w"))
    last = F.max("until").over(Window.partitionBy("site_id"))
    steps = steps.withColumn("until", F.when(F.col("until") >= last - 1e-12, F.lit(2.0)).otherwise(F.col("until")))
    drawn = weights.select("site_id").distinct().select("site_id", F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"))
    drawn = drawn.withColumn("u", uniform(F.lit(seed), F.lit("year"), F.col("site_id"), F.col("member")))
    both = drawn.join(steps, "site_id").where((F.col("u") >= F.col("from")) & (F.col("u") < F.col("until")) & (F.col("w") > 0))
    return both.groupBy("site_id", "member").agg(F.min("season_year").alias("season_year"))


def copy_seasons(donors: DataFrame, cube: DataFrame) -> DataFrame:
    """(site_id, member, season_year, day, PRCP): the donors' whole seasons."""
    return donors.join(cube.select("site_id", "season_year", "day", "PRCP"), ["site_id", "season_year"])


def schaake_shuffle(ensemble: DataFrame, template: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, member, value): the ensemble's values in the order of the template's ranks, ties by member."""
    by = lambda: Window.partitionBy(*keys).orderBy("value", "member")
    values = ensemble.select(*keys, "value", F.row_number().over(by()).alias("rank"))
    places = template.select(*keys, "member", F.row_number().over(by()).alias("rank"))
    return places.join(values, [*keys, "rank"]).select(*keys, "member", "value")


def stratified_quantiles(sample: DataFrame, m: int, key: str = "site_id") -> DataFrame:
    """(key, bin, value): means of m bins of equal probability, values at the edges in part."""
    rows = sample.withColumns({"i": F.row_number().over(Window.partitionBy(key).orderBy("value")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    rows = rows.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    low, high = F.col("bin") * F.col("n") / float(m), (F.col("bin") + 1) * F.col("n") / float(m)
    part = F.least(F.col("i") + 1.0, high) - F.greatest(F.col("i").cast("double"), low)
    rows = rows.withColumn("part", part).where("part > 0")
    return rows.groupBy(key, "bin").agg((F.sum(F.col("part") * F.col("value")) / F.sum("part")).alias("value"))


def crps(ensemble: DataFrame, observed: DataFrame, keys: list[str], fair: bool = False) -> DataFrame:
    """(keys, crps) from sorted members: mean distance to the observation less half the members' mean distance."""
    by = Window.partitionBy(*keys).orderBy("value")
    rows = ensemble.where("value IS NOT NULL").withColumns({"i": F.row_number().over(by), "m": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    rows = rows.join(observed.where("observed IS NOT NULL"), keys)
    pairs = F.col("m") * (F.col("m") - (1 if fair else 0))
    spread = F.try_divide((2 * F.col("i") - F.col("m") - 1) * F.col("value"), pairs.cast("double"))
    out = F.avg(F.abs(F.col("value") - F.col("observed"))) - F.sum(spread)
    return rows.groupBy(*keys).agg((F.when(F.max("m") > 1, out) if fair else out).alias("crps"))


def rps(prob: list[Column], observed: Column) -> Column:
    """Ranked probability score of three categories; null for an invalid category."""
    first, second = prob[0], prob[0] + prob[1]
    hit = lambda c: F.when(observed <= c, 1.0).otherwise(0.0)
    return F.when((observed >= 0) & (observed <= 2), F.pow(first - hit(0), 2.0) + F.pow(second - hit(1), 2.0))


def rank_histogram(ensemble: DataFrame, observed: DataFrame, keys: list[str], members: int, ties: str = "fractional", seed: int = 0) -> DataFrame:
    """(rank, share) for all ranks 0 to ``members``: where observations fall among the members of complete cases.

    Ties are spread evenly over the admissible ranks or, with ``random``, fall
    on one of them by a number that the case's key alone decides.
    """
    if ties not in ("fractional", "random"):
        raise ValueError("ties are fractional or random")
    v, o = F.col("value"), F.col("observed")
    rows = ensemble.join(observed.where(o.isNotNull()), keys).groupBy(*keys).agg(F.count("value").alias("m"), F.count_if(v < o).alias("below"), F.count_if(v == o).alias("equal")).where(F.col("m") == members)
    if ties == "random":
        at = F.col("below") + F.floor(uniform(F.lit(seed), F.lit("rank"), *[F.col(k) for k in keys]) * (F.col("equal") + 1))
        found = rows.groupBy(at.cast("int").alias("rank")).agg(F.count(F.lit(1)).cast("double").alias("share"))
    else:
        spread = rows.select(F.explode(F.sequence("below", F.col("below") + F.col("equal"))).alias("at"), (1.0 / (F.col("equal") + 1)).alias("part"))
        found = spread.groupBy(F.col("at").cast("int").alias("rank")).agg(F.sum("part").alias("share"))
    every = ensemble.sparkSession.range(members + 1).select(F.col("id").cast("int").alias("rank"))
    return every.join(found, "rank", "left").select("rank", F.coalesce("share", F.lit(0.0)).alias("share"))


def _checked(forecasts: DataFrame) -> DataFrame:
    """Pairs of a probability and an outcome; a missing one takes no part, one out of range raises."""
    p, o = F.col("prob"), F.col("outcome")
    rows = forecasts.where(p.isNotNull() & o.isNotNull() & ~F.isnan(p) & ~F.isnan(o))
    wrong = ~p.between(0, 1) | ~o.between(0, 1)
    return rows.withColumn("prob", F.when(wrong, F.raise_error(F.lit("probabilities and outcomes lie in 0 to 1")).cast("double")).otherwise(p))


def reliability(forecasts: DataFrame, bins: int | list[float] = 10) -> DataFrame:
    """(bin, mean_forecast, observed_frequency, n) of (prob, outcome); empty bins stay, the last holds 1 too.

    ``bins`` is a number of equal bins or their edges, ascending from 0 or less to 1 or more.
    """
    p = F.col("prob")
    if isinstance(bins, int):
        n, bin_ = bins, F.least(F.floor(p * bins + 1e-12), F.lit(bins - 1)).cast("int")
    else:
        if len(bins) < 2 or any(b <= a for a, b in zip(bins, bins[1:], strict=False)) or bins[0] > 0 or bins[-1] < 1:
            raise ValueError("edges ascend and cover 0 to 1")
        n, bin_ = len(bins) - 1, sum((F.when(p >= e, 1).otherwise(0) for e in bins[1:-1]), F.lit(0))
    found = _checked(forecasts).groupBy(bin_.alias("bin")).agg(F.avg("prob").alias("mean_forecast"), F.avg("outcome").alias("observed_frequency"), F.count(F.lit(1)).alias("n"))
    every = forecasts.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def brier_decomposition(forecasts: DataFrame, bins: list[float] | None = None) -> DataFrame:
    """One row: score, reliability, resolution, uncertainty, binning_residual, count, over groups of equal forecasts or,
    with edges, of bins; the residual is what bins leave unexplained."""
    p = F.col("prob")
    group = p if bins is None else sum((F.when(p >= e, 1).otherwise(0) for e in bins[1:-1]), F.lit(0))
    rows = _checked(forecasts)
    groups = rows.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg("outcome").alias("o"), F.avg("prob").alias("p"))
    base = rows.agg(F.avg("outcome").alias("base"), F.count(F.lit(1)).alias("all"), F.avg(F.pow(F.col("prob") - F.col("outcome"), 2.0)).alias("score"))
    share = F.col("n") / F.col("all")
    parts = base.crossJoin(groups).groupBy("base", "all", "score").agg(F.sum(share * F.pow(F.col("p") - F.col("o"), 2.0)).alias("reliability"), F.sum(share * F.pow(F.col("o") - F.col("base"), 2.0)).alias("resolution"))  # base is one row
    uncertainty = F.col("base") * (1 - F.col("base"))
    return parts.select("score", "reliability", "resolution", uncertainty.alias("uncertainty"), (F.col("score") - (F.col("reliability") - F.col("resolution") + uncertainty)).alias("binning_residual"), F.col("all").alias("count"))


def tercile_frequencies(members: DataFrame, limits: DataFrame) -> DataFrame:
    """(site_id, pb, pn, pa, n): shares of members' totals by category, ties to the lower one."""
    rows = members.join(limits, "site_id").withColumn("cat", classify(F.col("total"), F.col("q33"), F.col("q67"))).where("cat >= 0")
    return rows.groupBy("site_id").agg(*[F.avg(F.when(F.col("cat") == k, 1.0).otherwise(0.0)).alias(c) for k, c in enumerate(("pb", "pn", "pa"))], F.count(F.lit(1)).alias("n"))


def markov_fit(cube: DataFrame, wet: float = 1.0) -> DataFrame:
    """(site_id, month, p01, p11, pi, wet_mean, n): first-order wet-day chain from pairs within a month and season."""
    by = Window.partitionBy("site_id", "season_year").orderBy("day")
    rows = cube.select("site_id", "month", "PRCP", F.lag("PRCP").over(by).alias("before"), F.lag("month").over(by).alias("month_before"))
    is_wet = F.col("PRCP") >= wet
    pair = (F.col("month") == F.col("month_before")) & F.col("PRCP").isNotNull() & F.col("before").isNotNull()
    after_dry, after_wet = pair & (F.col("before") < wet), pair & (F.col("before") >= wet)
    return rows.groupBy("site_id", "month").agg(
        F.try_divide(F.count_if(after_dry & is_wet).cast("double"), F.count_if(after_dry)).alias("p01"), F.try_divide(F.count_if(after_wet & is_wet).cast("double"), F.count_if(after_wet)).alias("p11"),
        F.try_divide(F.count_if(is_wet).cast("double"), F.count("PRCP")).alias("pi"), F.avg(F.when(is_wet, F.col("PRCP"))).alias("wet_mean"), F.count("PRCP").alias("n"),
    )


def digamma(x: Column) -> Column:
    """Derivative of the logarithm of the gamma function for x > 0: eight steps of the recurrence, then its series."""
    y = x + 8.0
    z = 1.0 / (y * y)
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda a, i: a + 1.0 / (x + i))
    return F.ln(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - steps


def gamma_shape(sums: DataFrame) -> tuple[Column, Column]:
    """(shape, status) of Gamma distributions by maximum likelihood from the columns mean, log_mean and n.

    The shape solves ln k - digamma(k) = ln(mean) - mean(ln), whose left side
    falls in k: bisection of ln k between 1 / (2 gap) and 1 / gap, which hold
    for every gap.  Status 0: solved; 1: all amounts alike, shape 1e6; 2: none.
    """
    gap = F.greatest(F.ln("mean") - F.col("log_mean"), F.lit(0.0))
    lo, hi = -F.ln(2.0 * gap) - 0.01, -F.ln(gap) + 0.01
    halves = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.struct(lo.alias("lo"), hi.alias("hi")), lambda s, _: _halved(s, gap))
    some, apart = F.col("n") > 0, gap > 5e-7
    return F.when(some & apart, F.exp((halves["lo"] + halves["hi"]) / 2.0)).when(some, 1e6).otherwise(1.0), F.when(some & apart, 0).when(some, 1).otherwise(2)


def gamma_fit(cube: DataFrame, wet: float = 1.0) -> DataFrame:
    """(site_id, month, shape, scale, status): Gamma distribution of wet amounts above the threshold, as gamma_shape has it."""
    x = F.when(F.col("PRCP") > wet, F.col("PRCP") - wet)
    sums = cube.groupBy("site_id", "month").agg(F.avg(x).alias("mean"), F.avg(F.ln(x)).alias("log_mean"), F.count(x).alias("n"))
    shape, status = gamma_shape(sums)
    sums = sums.withColumns({"shape": shape, "status": status})
    return sums.select("site_id", "month", "shape", F.when(F.col("n") > 0, F.col("mean") / F.col("shape")).otherwise(1.0).alias("scale"), "status")


def _halved(s: Column, gap: Column) -> Column:
    middle = (s["lo"] + s["hi"]) / 2.0
    above = middle - digamma(F.exp(middle)) > gap
    return F.struct(F.when(above, middle).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(middle).alias("hi"))


EARTH_KM = 6371.0088


def kernel_correlation(distance_km: Column, kind: str, range_km: float, alpha: float = 1.0) -> Column:
    """Correlation at a chord distance in km: exponential, or a power of 1 + distance / range."""
    if kind not in ("exponential", "power") or not range_km > 0 or not alpha > 0:
        raise ValueError("the kernel is exponential or power, with a positive range and exponent")
    return F.exp(-distance_km / range_km) if kind == "exponential" else F.pow(1 + distance_km / range_km, -alpha)


def with_position(sites: DataFrame) -> DataFrame:
    """``sites`` with the place on the sphere in km: px, py, pz."""
    lat, lon = F.radians("y"), F.radians("x")
    return sites.withColumns({"px": EARTH_KM * F.cos(lat) * F.cos(lon), "py": EARTH_KM * F.cos(lat) * F.sin(lon), "pz": EARTH_KM * F.sin(lat)})


def site_distances(sites: DataFrame, most: int = 2500) -> DataFrame:
    """(a, b, km): straight chords between all sites of a fitted sample, of at most ``most`` sites."""
    if sites.select("site_id").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} sites; give a sample of them")
    place = with_position(sites)
    a, b = (place.select(F.col("site_id").alias(k), *[F.col(c).alias(c + k) for c in ("px", "py", "pz")]) for k in "ab")
    gap = sum((F.pow(F.col(c + "a") - F.col(c + "b"), 2.0) for c in ("px", "py", "pz")), F.lit(0.0))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.sqrt(gap).alias("km"))
