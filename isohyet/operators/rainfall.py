"""Daily rain as a chain of wet and dry days with random amounts: weighted fits and simulation.

Fits of the chain, of Gamma amounts, of traces and of run lengths are grouped
aggregates of DataFrame expressions: whatever the number of years, a task only
keeps sums.  Mixed exponential amounts need iterations over one site's and one
month's values, which is one group.  Simulation runs by site; its random numbers
depend on seed, stream, member and day alone (``fields``), so neither tiles nor
batches of members change a number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import gammaincinv, logsumexp, ndtr
from . import fields
from .conditioning import gamma_shape

TINY = float(np.finfo(float).eps)


def is_wet(x: Column, wet: float, strict: bool = False) -> Column:
    return x > wet if strict else x >= wet


def with_weights(cube: DataFrame, weights: DataFrame | None) -> DataFrame:
    """The cube with a weight w for each site and season, 1 without weights, 0 where a season has none."""
    if weights is None:
        return cube.withColumn("w", F.lit(1.0))
    return cube.join(weights.select("site_id", "season_year", "w"), ["site_id", "season_year"], "left").fillna(0.0, ["w"])


def fit_chain(cube: DataFrame, weights: DataFrame | None = None, *, wet: float = 1.0, strict: bool = False, persistence: str = "climatology") -> DataFrame:
    """(site_id, month, pi, p01, p11, d_raw, d, known_years, pairs): weighted wet share and first-order transitions.

    pi is the weighted mean of the years' wet shares.  Persistence p11 - p01
    comes from pairs of days within a month and season: of all years
    (``climatology``), by weight (``weighted``), as the weighted mean of yearly
    shares (``yearly``, which is kept as it is), or is 0 (``independent``); it is
    brought into the range in which both probabilities exist, so pi stays the
    chain's own wet share.  Without one of the two states it is 0.
    """
    if persistence not in ("climatology", "weighted", "yearly", "independent"):
        raise ValueError("persistence is climatology, weighted, yearly or independent")
    by = Window.partitionBy("site_id", "season_year").orderBy("day")
    rows = with_weights(cube.select("site_id", "season_year", "day", "month", "PRCP"), weights)
    before, adjacent = F.lag("PRCP").over(by), (F.lag("month").over(by) == F.col("month")) & (F.col("day") - F.lag("day").over(by) == 1)
    rows = rows.withColumn("before", F.when(adjacent, before))
    x = F.col("PRCP")
    w, w0 = is_wet(x, wet, strict), is_wet(F.col("before"), wet, strict)
    pair = x.isNotNull() & F.col("before").isNotNull()
    count = lambda c: F.count_if(c).cast("double")
    yearly = rows.groupBy("site_id", "season_year", "month").agg(F.max("w").alias("w"), F.count("PRCP").alias("n"), count(w).alias("wets"), count(pair & ~w0).alias("n0"), count(pair & w0).alias("n1"), count(pair & ~w0 & w).alias("n01"), count(pair & w0 & w).alias("n11"))
    k = F.col("w")
    seen = F.when(F.col("n") > 0, k)
    mean = lambda part, over: F.try_divide(F.sum(F.when(F.col(over) > 0, k * F.col(part) / F.col(over))), F.sum(F.when(F.col(over) > 0, k)))
    factor = k if persistence == "weighted" else F.lit(1.0)
    share = lambda part, over: F.try_divide(F.sum(factor * F.col(part)), F.sum(factor * F.col(over)))
    sums = yearly.groupBy("site_id", "month").agg(
        F.try_divide(F.sum(seen * F.col("wets") / F.col("n")), F.sum(seen)).alias("pi"), mean("n01", "n0").alias("y01"), mean("n11", "n1").alias("y11"),
        share("n01", "n0").alias("s01"), share("n11", "n1").alias("s11"), F.count_if((F.col("n") > 0) & (k > 0)).alias("known_years"), F.sum(F.col("n0") + F.col("n1")).cast("bigint").alias("pairs"),
    )
    if persistence == "yearly":
        out = sums.withColumns({"d_raw": F.coalesce("y11", F.lit(0.0)) - F.coalesce("y01", F.lit(0.0)), "p01": F.coalesce("y01", F.lit(0.0)), "p11": F.coalesce("y11", F.lit(0.0))}).withColumn("d", F.col("d_raw"))
    else:
        raw = F.lit(0.0) if persistence == "independent" else F.coalesce(F.col("s11") - F.col("s01"), F.lit(0.0))
        p = F.col("pi")
        least = F.greatest(F.coalesce(F.try_divide(p - 1, p), F.lit(-1e300)), F.coalesce(F.try_divide(-p, 1 - p), F.lit(-1e300)))
        d = F.when((p <= 0) | (p >= 1), 0.0).otherwise(F.greatest(least, F.least(F.col("d_raw"), F.lit(1.0))))
        unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
        out = sums.withColumn("d_raw", raw).withColumn("d", d).withColumns({"p01": unit(p * (1 - F.col("d"))), "p11": unit(p + (1 - p) * F.col("d"))})
    return out.select("site_id", "month", "pi", "p01", "p11", "d_raw", "d", "known_years", "pairs")


def fit_amounts(cube: DataFrame, weights: DataFrame | None = None, *, wet: float = 1.0, strict: bool = False, basis: str = "excess") -> DataFrame:
    """(site_id, month, shape, scale, atom, status, n_eff, trace_p, trace_m): weighted Gamma amounts by maximum likelihood.

    Amounts are what exceeds the threshold (``excess``; atom is the share of
    wet days exactly at it) or the whole (``raw``).  trace_p and trace_m are the
    share and mean of rain below the threshold on days that aren't wet.
    """
    if basis not in ("excess", "raw"):
        raise ValueError("basis is excess or raw")
    rows = with_weights(cube.select("site_id", "season_year", "month", "PRCP"), weights)
    x, w = F.col("PRCP"), F.col("w")
    rains = is_wet(x, wet, strict)
    amount = F.when(rains, x if basis == "raw" else x - wet)
    y, k = F.when((amount > 0) & (w > 0), amount), F.when((amount > 0) & (w > 0), w)
    trace = ~rains & (x > 0)
    sums = rows.groupBy("site_id", "month").agg(
        F.try_divide(F.sum(k * y), F.sum(k)).alias("mean"), F.try_divide(F.sum(k * F.ln(y)), F.sum(k)).alias("log_mean"), F.count(k).alias("n"), F.try_divide(F.pow(F.sum(k), 2.0), F.sum(k * k)).alias("n_eff"),
        F.coalesce(F.try_divide(F.sum(F.when(rains & (x == wet), w).otherwise(0.0)), F.sum(F.when(rains, w))), F.lit(1.0)).alias("atom"),
        F.coalesce(F.try_divide(F.sum(F.when(trace, w).otherwise(0.0)), F.sum(F.when(~rains, w))), F.lit(0.0)).alias("trace_p"), F.coalesce(F.try_divide(F.sum(F.when(trace, w * x)), F.sum(F.when(trace, w))), F.lit(0.0)).alias("trace_m"),
    )
    shape, status = gamma_shape(sums)
    out = sums.withColumns({"shape": shape, "status": status})
    scale = F.when(F.col("n") > 0, F.col("mean") / F.col("shape")).otherwise(1.0)
    return out.select("site_id", "month", "shape", scale.alias("scale"), (F.lit(0.0) if basis == "raw" else F.col("atom")).alias("atom"), "status", F.coalesce("n_eff", F.lit(0.0)).alias("n_eff"), "trace_p", "trace_m")


def mixed_exponential(x: np.ndarray, w: np.ndarray, alpha: float | None = None, steps: int = 500, tol: float = 1e-8) -> tuple[float, float, float, int]:
    """(alpha, beta1, beta2, status) of two exponentials by weighted EM; ``alpha`` given stays as it is.

    Status 0: converged; 2: no amounts; 4: one exponential (fewer than ten amounts, or two alike); 5: steps used up.
    """
    use = np.isfinite(x) & (x > 0) & (w > 0)
    x, w = x[use], w[use]
    if not len(x):
        return (1.0 if alpha is None else alpha), 1.0, 1.0, 2
    mean = float(w @ x / w.sum())
    a, b = (0.5 if alpha is None else alpha), np.maximum([0.4 * mean, 2.0 * mean], 1e-3)
    status = 5
    for _ in range(steps):
        with np.errstate(divide="ignore"):
            parts = np.log([a, 1 - a])[:, None] - np.log(b)[:, None] - x / b[:, None]
        r = w * np.exp(parts - logsumexp(parts, axis=0))
        mass = r.sum(axis=1)
        new = np.maximum(np.where(mass > 0, (r @ x) / np.maximum(mass, 1e-300), b), 1e-3)
        share = a if alpha is not None else float(np.clip(mass[0] / w.sum(), 1e-4, 1 - 1e-4))
        change = float((np.abs(new - b) / b).sum() + abs(share - a))
        a, b = share, new
        if change < tol:
            status = 0
            break
    if alpha is None and b[0] > b[1]:
        a, b = 1 - a, b[::-1]
    if len(x) < 10 or abs(b[0] - b[1]) < 1e-6 * mean:
        return (1.0 if alpha is None else alpha), mean, mean, 4
    return float(a), float(b[0]), float(b[1]), status


def mixed_exponential_quantile(u, alpha, beta1, beta2, steps: int = 60) -> np.ndarray:
    """Quantiles of the mixture, by bisection of its survival function."""
    u, alpha, beta1, beta2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (u, alpha, beta1, beta2)))
    target = np.maximum(1 - u, 1e-300)
    lo, hi = np.zeros(u.shape), -np.maximum(beta1, beta2) * np.log(target)
    for _ in range(steps):
        mid = (lo + hi) / 2
        right = alpha * np.exp(-mid / beta1) + (1 - alpha) * np.exp(-mid / beta2) > target
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
    return (lo + hi) / 2


def fit_mixed_exponential(cube: DataFrame, weights: DataFrame | None = None, *, wet: float = 1.0, strict: bool = False, basis: str = "excess", alphas: DataFrame | None = None) -> DataFrame:
    """(site_id, month, alpha, beta1, beta2, mix_status); ``alphas`` (site_id, month, alpha) stay as they are."""
    rows = with_weights(cube.select("site_id", "season_year", "month", "PRCP"), weights)
    amount = F.col("PRCP") if basis == "raw" else F.col("PRCP") - wet
    rows = rows.select("site_id", "month", F.when(is_wet(F.col("PRCP"), wet, strict), amount).alias("x"), "w")
    rows = rows.withColumn("alpha", F.lit(None).cast("double")) if alphas is None else rows.join(F.broadcast(alphas.select("site_id", "month", "alpha")), ["site_id", "month"], "left")  # one row a site and month

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        given = group["alpha"].iloc[0]
        a, b1, b2, status = mixed_exponential(group["x"].to_numpy(float), group["w"].to_numpy(float), None if pd.isna(given) else float(given))
        return pd.DataFrame({"site_id": [group["site_id"].iloc[0]], "month": [group["month"].iloc[0]], "alpha": [a], "beta1": [b1], "beta2": [b2], "mix_status": [status]})

    kinds = {k: cube.schema[k].dataType.simpleString() for k in ("site_id", "month")}
    return rows.groupBy("site_id", "month").applyInPandas(fit, f"site_id {kinds['site_id']}, month {kinds['month']}, alpha double, beta1 double, beta2 double, mix_status int")


def domain_alphas(cube: DataFrame, *, wet: float = 0.0, strict: bool = True, most: int = 5_000_000) -> DataFrame:
    """(month, alpha): the mixing weight of all sites' wet days together.

    Equal amounts are counted first, and counts are weights of the same fit, so a
    task holds a month's different amounts; more than ``most`` of them raise.
    """
    x = F.col("PRCP")
    counted = cube.where(is_wet(x, wet, strict)).groupBy("month", x.alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) > most:
            raise ValueError(f"more than {most} different amounts in a month; round them")
        group = group.sort_values("x")  # the same sums at every dealing of rows
        return pd.DataFrame({"month": [group["month"].iloc[0]], "alpha": [mixed_exponential(group["x"].to_numpy(float), group["n"].to_numpy())[0]]})

    return counted.groupBy("month").applyInPandas(fit, f"month {cube.schema['month'].dataType.simpleString()}, alpha double")


def forecast_plane(cube: DataFrame, categories: DataFrame, prob: DataFrame, *, wet: float = 0.0, strict: bool = True, resolution: int = 2, alphas: DataFrame | None = None) -> DataFrame:
    """(site_id, month, alpha, beta1, beta2, mix_status, plane1, plane2): means of two exponentials as planes over forecasts.

    For forecasts on a grid of the simplex the years' weights, and with them the
    means, are found; the plane [1, pb, pa] through them is read at the site's
    own forecast, not below 0.001.  The mixing weight is the domain's, or given
    by ``alphas`` (month, alpha).  A site without years of all three categories,
    without a valid forecast or with a month that has no plane is left out.
    """
    if not 2 <= resolution <= 8:
        raise ValueError("the grid has 2 to 8 steps a side")
    grid = np.array([(i, j, resolution - i - j) for i in range(resolution + 1) for j in range(resolution + 1 - i)]) / resolution
    base = np.column_stack([np.ones(len(grid)), grid[:, 0], grid[:, 2]])
    alphas = domain_alphas(cube.join(categories.where("cat >= 0"), ["site_id", "season_year"], "left_semi"), wet=wet, strict=strict) if alphas is None else alphas
    years = categories.where("cat >= 0").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("site_id", "cat"))).select("site_id", "season_year", "cat", "n")
    every = years.groupBy("site_id").agg(F.countDistinct("cat").alias("kinds")).where("kinds = 3").select("site_id")
    target = prob.where("pb + pn + pa > 0").select("site_id", (F.col("pb") / (F.col("pb") + F.col("pn") + F.col("pa"))).alias("pb"), (F.col("pa") / (F.col("pb") + F.col("pn") + F.col("pa"))).alias("pa")).join(every, "site_id", "left_semi")
    rows = cube.select("site_id", "season_year", "month", F.when(is_wet(F.col("PRCP"), wet, strict), F.col("PRCP")).alias("x")).join(years, ["site_id", "season_year"])
    rows = rows.join(target, "site_id").join(F.broadcast(alphas), "month", "left")  # twelve rows at most

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, cat, n = group["x"].to_numpy(float), group["cat"].to_numpy(int), group["n"].to_numpy(float)
        alpha = None if pd.isna(group["alpha"].iloc[0]) else float(group["alpha"].iloc[0])
        found = [mixed_exponential(x, q[cat] / n, alpha) for q in grid]
        means = np.array([(f[1], f[2]) if f[3] != 2 else (np.nan, np.nan) for f in found])
        known = np.isfinite(means[:, 0])
        if alpha is None or known.sum() < 3 or np.linalg.matrix_rank(base[known]) < 3:
            beta, planes = (None, None), (None, None)
        else:
            planes = np.linalg.lstsq(base[known], means[known], rcond=None)[0].T
            beta = np.maximum(planes @ [1.0, group["pb"].iloc[0], group["pa"].iloc[0]], 1e-3)
        status = max(f[3] for f in found)
        return pd.DataFrame({"site_id": [group["site_id"].iloc[0]], "month": [group["month"].iloc[0]], "alpha": [alpha], "beta1": [beta[0]], "beta2": [beta[1]], "mix_status": [status], "plane1": [planes[0]], "plane2": [planes[1]]})

    kinds = {k: cube.schema[k].dataType.simpleString() for k in ("site_id", "month")}
    out = rows.groupBy("site_id", "month").applyInPandas(fit, f"site_id {kinds['site_id']}, month {kinds['month']}, alpha double, beta1 double, beta2 double, mix_status int, plane1 array<double>, plane2 array<double>")
    whole = F.count_if(F.col("beta1").isNull()).over(Window.partitionBy("site_id")) == 0
    return out.withColumn("whole", whole).where("whole").drop("whole")


def runs_in_progress(cube: DataFrame, *, wet: float = 1.0, strict: bool = False) -> DataFrame:
    """The cube with the state of the day before (was_wet), the length of its run (run) and whether the run's start is known."""
    by = Window.partitionBy("site_id", "season_year").orderBy("day")
    x = F.col("PRCP")
    state = F.when(x.isNotNull(), is_wet(x, wet, strict).cast("int")).otherwise(-1)
    rows = cube.withColumn("state", state)
    new = F.coalesce((F.lag("state").over(by) != F.col("state")) | (F.col("day") - F.lag("day").over(by) != 1), F.lit(True))
    rows = rows.withColumn("run_no", F.sum(F.when(new, 1).otherwise(0)).over(by))
    inside = Window.partitionBy("site_id", "season_year", "run_no").orderBy("day")
    rows = rows.withColumn("length", F.row_number().over(inside)).withColumn("start", F.first("day").over(inside))
    # A run's start is known unless it is the first day, or what comes before it is a gap.
    rows = rows.withColumn("before_start", F.when(F.col("length") == 1, F.lag("state").over(by))).withColumn("before_start", F.first("before_start").over(inside))
    known = F.coalesce(F.col("before_start") >= 0, F.lit(False)) & (F.col("state") >= 0)
    rows = rows.withColumn("known_run", known)
    follows = F.col("day") - F.lag("day").over(by) == 1
    before = lambda c: F.when(follows & (F.lag("state").over(by) >= 0), F.lag(c).over(by))
    return rows.withColumns({"was_wet": before("state"), "run": before("length"), "run_known": F.coalesce(before("known_run"), F.lit(False))}).drop("run_no", "length", "start", "before_start", "known_run")


def fit_spells(cube: DataFrame, weights: DataFrame | None = None, *, wet: float = 1.0, strict: bool = False, most_dry: int = 40, most_wet: int = 15, prior: float = 3.0) -> DataFrame:
    """(site_id, month, was_wet, run, p): the chance of a wet day by month, state and length of the run before it.

    Lengths from ``most_dry`` and ``most_wet`` on share the last one.  Sparse
    lengths shrink to the month's transition from that state, with ``prior``
    days of pseudo observations in units of an average year's weight.
    """
    if most_dry < 1 or most_wet < 1 or prior < 0:
        raise ValueError("the longest runs are at least 1, the prior is not negative")
    rows = with_weights(runs_in_progress(cube.select("site_id", "season_year", "day", "month", "PRCP"), wet=wet, strict=strict), weights)
    mean_w = F.sum("w").over(Window.partitionBy("site_id")) / F.count(F.lit(1)).over(Window.partitionBy("site_id"))
    rows = rows.withColumn("w", F.coalesce(F.try_divide(F.col("w"), mean_w), F.lit(0.0))).where("state >= 0")
    rows = rows.withColumn("cap", F.when(F.col("was_wet") == 1, most_wet).otherwise(most_dry)).withColumn("run", F.least("run", "cap"))
    hit = F.col("w") * F.col("state")
    pooled = rows.groupBy("site_id", "month").agg(F.coalesce(F.try_divide(F.sum(hit), F.sum("w")), F.lit(0.5)).alias("pooled"))
    base = rows.where("was_wet IS NOT NULL").groupBy("site_id", "month", "was_wet").agg(F.try_divide(F.sum(hit), F.sum("w")).alias("base"))
    by_run = rows.where("run_known").groupBy("site_id", "month", "was_wet", "run").agg(F.sum("w").alias("risk"), F.sum(hit).alias("wets"))
    of = lambda state, most: F.array(*[F.struct(F.lit(state).alias("was_wet"), F.lit(i).alias("run")) for i in range(1, most + 1)])
    lengths = F.explode(F.concat(of(0, most_dry), of(1, most_wet)))
    grid = pooled.select("site_id", "month", "pooled", lengths.alias("k")).select("site_id", "month", "pooled", "k.was_wet", "k.run")
    out = grid.join(base, ["site_id", "month", "was_wet"], "left").join(by_run, ["site_id", "month", "was_wet", "run"], "left").fillna(0.0, ["risk", "wets"])
    markov = F.coalesce("base", "pooled")
    p = F.coalesce(F.try_divide(F.col("wets") + prior * markov, F.col("risk") + prior), markov)
    return out.select("site_id", "month", "was_wet", "run", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))


def fit_rainfall(cube: DataFrame, weights: DataFrame | None = None, *, wet: float = 1.0, strict: bool = False, persistence: str = "climatology", amounts: str = "gamma", basis: str = "excess", alphas: DataFrame | None = None) -> DataFrame:
    """One row a site and month with all parameters that ``simulate`` takes; a site with a month without weighted days has none."""
    if amounts not in ("gamma", "mixed_exponential"):
        raise ValueError("amounts are gamma or mixed_exponential")
    out = fit_chain(cube, weights, wet=wet, strict=strict, persistence=persistence).join(fit_amounts(cube, weights, wet=wet, strict=strict, basis=basis), ["site_id", "month"])
    if amounts == "mixed_exponential":
        out = out.join(fit_mixed_exponential(cube, weights, wet=wet, strict=strict, basis=basis, alphas=alphas), ["site_id", "month"])
    else:
        out = out.withColumns({"alpha": F.lit(None).cast("double"), "beta1": F.lit(None).cast("double"), "beta2": F.lit(None).cast("double"), "mix_status": F.lit(None).cast("int")})
    whole = F.count_if(F.col("known_years") == 0).over(Window.partitionBy("site_id")) == 0
    return out.withColumn("whole", whole).where("whole").drop("whole")


def amount_at(u: np.ndarray, m: dict, basis: str, wet: float) -> np.ndarray:
    """The wet day's rain at the quantile u of its month's distribution."""
    atom = m["atom"]
    v = np.clip((u - atom) / (1 - atom) if atom < 1 else np.zeros_like(u), TINY, 1 - TINY)
    if m["alpha"] is not None and not pd.isna(m["alpha"]):
        y = mixed_exponential_quantile(v, m["alpha"], m["beta1"], m["beta2"])
    else:
        y = m["scale"] * gammaincinv(m["shape"], v)
    return np.where(u <= atom, 0.0, y) + (0.0 if basis == "raw" else wet)


def chain(months: list[int], by_month: dict[int, dict], occurrence: np.ndarray, amount: np.ndarray, *, wet: float = 1.0, strict: bool = False, basis: str = "excess", reset: bool = False, by_amount: bool = False, traces: bool = False, hazards: dict | None = None, start: tuple[float, int] = (0.5, 1), start_u: np.ndarray | None = None) -> np.ndarray:
    """(member, day) of one site's rain from uniforms of the same shape.

    With ``hazards`` (month, state, length) to probability the chance of rain
    depends on the run in progress, which ``start`` (chance of a wet day before,
    dry run's length) begins.
    """
    n, days = occurrence.shape
    out = np.zeros((n, days))
    before, run = np.zeros(n, bool), np.ones(n, int)
    if hazards:
        before = (start_u if start_u is not None else np.full(n, 0.5)) < start[0]
        run = np.where(before, 1, start[1])
        caps = {s: max(k[2] for k in hazards if k[1] == s) for s in (0, 1)}
    # Amounts don't depend on the chain: all days of a month at once.
    rain, at = np.empty((n, days)), np.array(months)
    for month, m in by_month.items():
        if (of := at == month).any():
            rain[:, of] = amount_at(amount[:, of], m, basis, wet)
    for d, month in enumerate(months):
        m = by_month[month]
        if hazards:
            table = {s: np.array([hazards[month, s, k] for k in range(1, caps[s] + 1)]) for s in (0, 1)}
            p = np.where(before, table[1][np.minimum(run, caps[1]) - 1], table[0][np.minimum(run, caps[0]) - 1])
        elif d == 0 or (reset and month != months[d - 1]):
            p = np.full(n, m["pi"])
        else:
            p = np.where(before, m["p11"], m["p01"])
        now = occurrence[:, d] < p
        run = np.where(now == before, run + 1, 1)
        dry = np.zeros(n)
        if traces and m["trace_p"] > 0:
            mean, half = m["trace_m"], min(m["trace_m"], wet - m["trace_m"])
            dry = np.where(amount[:, d] < m["trace_p"], np.minimum(mean + half * (2 * amount[:, d] / m["trace_p"] - 1), np.nextafter(wet, 0)), 0.0)
        out[:, d] = np.where(now, rain[:, d], dry)
        before = ((out[:, d] > wet) if strict else (out[:, d] >= wet)) if by_amount else now
    return out


def simulate(params: DataFrame, sites: DataFrame, months: list[int], members: int, *, seed: int = 42, member_start: int = 0, field: fields.Field | dict[str, fields.Field] | None = None, spells: DataFrame | None = None, classes: DataFrame | None = None, **options) -> DataFrame:
    """(site_id, member, day, PRCP): seasons of the given months' days for each site and member.

    sites: (site_id, y, x); ``field`` says how draws hang together in space,
    for all streams or by stream; ``classes`` (site_id, member, class) picks a
    member's parameters among those of ``params`` (with a column class).
    """
    if members < 1 or member_start < 0:
        raise ValueError("members is at least 1, member_start not negative")
    months = [int(m) for m in months]
    need = sorted(set(months))
    of = field if isinstance(field, dict) else {"occurrence": field, "amount": field}
    keys = ["month", "pi", "p01", "p11", "shape", "scale", "atom", "trace_p", "trace_m", "alpha", "beta1", "beta2"]
    mixed = "class" in params.columns
    gathered = params.where(F.col("month").isin(need)).groupBy("site_id").agg(F.collect_list(F.struct(*keys, (F.col("class") if mixed else F.lit(0)).alias("class"))).alias("params"))  # a few rows a site
    rows = gathered.join(sites.select("site_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")), "site_id")
    if spells is not None:
        table = spells.where(F.col("month").isin(need)).groupBy("site_id").agg(F.collect_list(F.struct("month", "was_wet", "run", "p")).alias("hazards"))
        rows = rows.join(table, "site_id")
    if classes is not None:
        rows = rows.join(classes.groupBy("site_id").agg(F.sort_array(F.collect_list(F.struct("member", "class"))).alias("classes")), "site_id")

    with_runs, with_classes = spells is not None, classes is not None

    def run(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                site = (int(r["site_id"]), r["y"], r["x"])
                u = {k: np.clip(ndtr(fields.draws(of.get(k), site, members, len(months), seed, k, member_start)), TINY, 1 - TINY) for k in ("occurrence", "amount")}
                hazards = {(int(h["month"]), int(h["was_wet"]), int(h["run"])): h["p"] for h in r["hazards"]} if with_runs else None
                start_u = ndtr(fields.draws(of.get("occurrence"), site, members, 1, seed, "start", member_start))[:, 0]
                own = np.array([c["class"] for c in r["classes"]]) if with_classes else np.zeros(members, int)
                out = np.zeros((members, len(months)))
                for k in np.unique(own):
                    by_month = {int(p["month"]): dict(p) if not hasattr(p, "asDict") else p.asDict() for p in r["params"] if int(p["class"]) == k}
                    if set(need) - set(by_month):
                        out[own == k] = np.nan
                        continue
                    out[own == k] = chain(months, by_month, u["occurrence"][own == k], u["amount"][own == k], hazards=hazards, start_u=start_u[own == k], **options)
                values = out.ravel()
                yield pd.DataFrame({"site_id": site[0], "member": np.repeat(np.arange(member_start, member_start + members), len(months)), "day": np.tile(np.arange(len(months)), members), "PRCP": [None if np.isnan(v) else v for v in values] if np.isnan(values).any() else values})

    return rows.mapInPandas(run, "site_id bigint, member int, day int, PRCP double")


def total_moments(params: DataFrame, months: list[int], *, wet: float = 1.0, basis: str = "excess") -> DataFrame:
    """(site_id, mean, variance) of a season's total under the chain, exactly, by a recursion over its days.

    Given whether a day is wet, the total so far has a mean and a mean square;
    both go forward one day by the chain's probabilities.
    """
    months = [int(m) for m in months]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        p = {int(r["month"]): r for r in group.to_dict("records")}
        if set(months) - set(p):
            return pd.DataFrame({"site_id": [group["site_id"].iloc[0]], "mean": [None], "variance": [None]}).astype({"mean": float, "variance": float})
        chance, first, second = np.zeros(2), np.zeros(2), np.zeros(2)
        for d, month in enumerate(months):
            m = p[month]
            to_wet = np.array([m["p01"], m["p11"]])
            step = np.array([1 - to_wet, to_wet])  # step[state now, state before]
            if d == 0:
                chance, first, second = np.array([1 - m["pi"], m["pi"]]), np.zeros(2), np.zeros(2)
            else:
                chance, first, second = step @ chance, step @ first, step @ second
            if m["alpha"] is not None and not pd.isna(m["alpha"]):
                e1 = m["alpha"] * m["beta1"] + (1 - m["alpha"]) * m["beta2"]
                e2 = 2 * (m["alpha"] * m["beta1"] ** 2 + (1 - m["alpha"]) * m["beta2"] ** 2)
            else:
                e1, e2 = m["shape"] * m["scale"], m["shape"] * (m["shape"] + 1) * m["scale"] ** 2
            base, some = (0.0 if basis == "raw" else wet), 1 - m["atom"]
            mean = np.array([0.0, base + some * e1])
            square = np.array([0.0, base**2 + 2 * base * some * e1 + some * e2])
            second = second + 2 * first * mean + chance * square
            first = first + chance * mean
        mean, square = first.sum(), second.sum()
        return pd.DataFrame({"site_id": [group["site_id"].iloc[0]], "mean": [mean], "variance": [square - mean**2]})

    kind = params.schema["site_id"].dataType.simpleString()
    return params.groupBy("site_id").applyInPandas(run, f"site_id {kind}, mean double, variance double")
