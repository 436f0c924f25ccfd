"""Rain and its companions by generalised linear models of the season's score: fits by site, smoothing in space, simulation.

Predictors are expressions of the JVM; a fit sees one site's seasons.  Occurrence
is a probit of harmonics, the day before, the score and their product; amounts
are a Gamma law with a log link; companions are linear with a spread for wet and
one for dry days.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.special import bfgs, gammaincc, gammaincinv, gammaln, ndtr, ndtri, trigamma, weighted_gamma_mle
from . import conditioning as c
from . import fields
from .companions import latent_panel
from .rainfall import TINY, is_wet

TOP = 6.0


def gaps(eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance and density of a normal number at eta, kept off 0 and 1."""
    eta = np.clip(eta, -TOP, TOP)
    return np.clip(ndtr(eta), 1e-10, 1 - 1e-10), np.maximum(np.exp(-eta * eta / 2) / np.sqrt(2 * np.pi), 1e-12)


def fit_probit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, covariance) of a probit by Fisher scoring; the ridge keeps sites without variation solvable."""
    beta, lift = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    beta[0] = ndtri(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    for _ in range(steps + 1):
        p, density = gaps(x @ beta)
        weight = density**2 / (p * (1 - p))
        information = (x * weight[:, None]).T @ x + lift
        new = np.linalg.solve(information, x.T @ (weight * (np.clip(x @ beta, -TOP, TOP) + (y - p) / density)))
        done = np.abs(new - beta).max() < 1e-8
        beta = new
        if done:
            break
    return beta, np.linalg.inv(information)


def fit_gamma_log(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6, steps: int = 50) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(coefficients, covariance, shape, variance of the shape's logarithm) of a Gamma law with mean exp(x b)."""
    gram = x.T @ x + ridge * np.eye(x.shape[1])
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(max(y.mean() if len(y) else 1.0, 1e-3))
    for _ in range(steps):
        eta = np.clip(x @ beta, -10, 10)
        new = np.linalg.solve(gram, x.T @ (eta + y / np.exp(eta) - 1))
        done = np.abs(new - beta).max() < 1e-9
        beta = new
        if done:
            break
    ratio = y / np.exp(np.clip(x @ beta, -10, 10))
    shape = weighted_gamma_mle(ratio, np.ones(len(ratio)))[0]
    spread = max(len(y), 1) * (float(trigamma(shape)) - 1 / shape) * shape**2
    return beta, np.linalg.inv(gram) / shape, shape, 1 / max(spread, 1e-12)


def fit_gamma_truncated(x: np.ndarray, y: np.ndarray, threshold: float, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float, float]:
    """As ``fit_gamma_log`` for whole amounts that are only seen above the threshold; too few of them keep that fit."""
    if not 0 < threshold < np.inf:
        raise ValueError("the threshold is positive")
    beta, cov, shape, spread = fit_gamma_log(x, y, ridge)
    seen = y > threshold
    if seen.sum() < max(3, x.shape[1]):
        return beta, cov, shape, spread
    xs, ys = x[seen], y[seen]

    def loss(theta):
        k, eta = np.exp(np.clip(theta[-1], -7, 10)), xs @ theta[:-1]
        if np.abs(eta).max() > 50:
            return np.inf
        left = gammaincc(k, k * threshold * np.exp(-eta))
        if left.min() < 1e-12:  # so little is left above the threshold that its share is rounding
            return np.inf
        return -(k * (np.log(k) - eta) - gammaln(k) + (k - 1) * np.log(ys) - k * ys * np.exp(-eta) - np.log(left)).sum() + ridge * (theta[:-1] ** 2).sum() / 2

    start = np.append(beta, np.log(shape))
    if not np.isfinite(loss(start)):
        return beta, cov, shape, spread
    with np.errstate(invalid="ignore"):
        found = bfgs(lambda t: (loss(t) / len(ys), slope(loss, t) / len(ys)), start, tol=1e-7)[0]
    curvature = np.array([slope(lambda t, i=i: slope(loss, t)[i], found, 1e-3) for i in range(len(found))])
    inverse = np.linalg.pinv((curvature + curvature.T) / 2)
    return found[:-1], inverse[:-1, :-1], float(np.exp(found[-1])), float(inverse[-1, -1])


def slope(f, x: np.ndarray, step: float = 1e-5) -> np.ndarray:
    """Central differences."""
    eye = np.eye(len(x)) * step
    return np.array([(f(x + e) - f(x - e)) / (2 * step) for e in eye])


def fit_linear(x: np.ndarray, y: np.ndarray, wet: np.ndarray, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, covariance, spread on dry and wet days); a state without days takes the spread of all."""
    gram = x.T @ x + ridge * np.eye(x.shape[1])
    beta = np.linalg.solve(gram, x.T @ y)
    left = y - x @ beta
    pooled = np.sqrt(np.mean(left**2)) if len(left) else 1e-6
    sd = np.array([np.sqrt(np.mean(left[wet == s] ** 2)) if (wet == s).any() else pooled for s in (0, 1)])
    return beta, np.linalg.inv(gram) * pooled**2, np.maximum(sd, 1e-6)


def design(cube: DataFrame, scores: DataFrame, harmonics: int = 2, *, wet: float = 1.0, strict: bool = False) -> DataFrame:
    """The cube (with t, the date) with state, lag, z and the array h of an intercept and the date's harmonics.

    lag is the state of the day before in the same season; a season's first day
    has none and enters no fit, nor does a day after a missing one.
    """
    by = Window.partitionBy("site_id", "season_year").orderBy("day")
    state = is_wet(F.col("PRCP"), wet, strict).cast("int")
    rows = cube.withColumn("state", state)
    rows = rows.withColumn("lag", F.when(F.col("day") - F.lag("day").over(by) == 1, F.lag("state").over(by)))
    waves = [w for k in range(1, harmonics + 1) for w in scalar.harmonics(F.col("t"), k)]
    return rows.join(scores.select("site_id", "season_year", "z"), ["site_id", "season_year"]).withColumn("h", F.array(F.lit(1.0), *waves))


def fit_models(cube: DataFrame, scores: DataFrame, variables: tuple[str, ...] = (), *, harmonics: int = 2, interaction: bool = True, wet: float = 1.0, strict: bool = False, truncated: bool = False) -> DataFrame:
    """(site_id, model, coefficients, variances, extra, n): one row a site and model.

    Models are occurrence, amount and the variables; extra is the shape and its
    logarithm's variance for amounts, the spread on dry and wet days and the mean of
    first days for variables, the share of wet first days for occurrence.  A
    site needs three scored seasons; a model without days has no row.
    """
    rows = design(cube, scores, harmonics, wet=wet, strict=strict).where("z IS NOT NULL")
    if variables:
        keys = ["site_id", "season_year", "day"]
        latent = latent_panel(cube, variables, wet=wet, strict=strict).groupBy(*keys).agg(*[F.max(F.when(F.col("variable") == v, F.col("v"))).alias(v) for v in variables])
        rows = rows.drop(*variables).join(latent, keys)
    rows = rows.select("site_id", "season_year", "day", "PRCP", "state", "lag", "z", "h", *variables)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        site = g["site_id"].iloc[0]
        if g["season_year"].nunique() < 3:
            return pd.DataFrame(columns=["site_id", "model", "coefficients", "variances", "extra", "n"])
        g = g.sort_values(["season_year", "day"])
        h, z, lag, state, rain = np.stack(g["h"].to_numpy()), g["z"].to_numpy(float), g["lag"].to_numpy(float), g["state"].to_numpy(float), g["PRCP"].to_numpy(float)
        out, known = [], np.isfinite(lag) & np.isfinite(state)
        x = np.column_stack([h, lag, z, *([z * lag] if interaction else [])])
        if known.any():
            beta, cov = fit_probit(x[known], state[known])
            first = state[(g["day"] == 0).to_numpy() & np.isfinite(state)]
            out.append((site, "occurrence", beta, np.diag(cov), [first.mean() if len(first) else state[known].mean()], int(known.sum())))
        rainy = known & (state == 1) & (rain > wet if truncated else rain >= wet)
        # An amount of exactly the threshold has no logarithm above it; half a hundredth of a millimetre stands for it.
        amount = rain if truncated else np.maximum(rain - wet, 0.005)
        if rainy.any():
            of = np.column_stack([h, lag, z])[rainy]
            beta, cov, shape, spread = fit_gamma_truncated(of, amount[rainy], wet) if truncated else fit_gamma_log(of, amount[rainy])
            out.append((site, "amount", beta, np.diag(cov), [shape, spread], int(rainy.sum())))
        day = g["day"].to_numpy()
        follows = np.append(False, (g["season_year"].to_numpy()[1:] == g["season_year"].to_numpy()[:-1]) & (np.diff(day) == 1))
        for v in variables:
            y = g[v].to_numpy(float)
            before = np.where(follows, np.append(np.nan, y[:-1]), np.nan)
            use = np.isfinite(y) & np.isfinite(before) & np.isfinite(state)
            if use.any():
                beta, cov, sd = fit_linear(np.column_stack([h, state, before, z])[use], y[use], state[use])
                start = y[(day == 0) & np.isfinite(y)]
                out.append((site, v, beta, np.diag(cov), [*sd, start.mean() if len(start) else y[use].mean()], int(use.sum())))
        return pd.DataFrame(out, columns=["site_id", "model", "coefficients", "variances", "extra", "n"])

    kind = cube.schema["site_id"].dataType.simpleString()
    return rows.groupBy("site_id").applyInPandas(run, f"site_id {kind}, model string, coefficients array<double>, variances array<double>, extra array<double>, n int")


def smooth_coefficients(fits: DataFrame, sites: DataFrame, *, most: int = 400) -> DataFrame:
    """(site_id, model, at, mean, variance, level, tau2, rho): each coefficient as a Gaussian field observed with its
    estimate's variance, level, spread and range (chord km) by likelihood.

    Coefficients are smoothed one by one.  Where predictors are nearly dependent
    (several harmonics in a short season, a lag that hardly varies) their sum is
    well known and they are not, so smoothed ones can be far off as a whole.

    One task a model and coefficient; it holds the square of the number of sites,
    so more than ``most`` sites raise.
    """
    if sites.select("site_id").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} sites; smooth regions apart")
    one = fits.select("site_id", "model", F.posexplode(F.arrays_zip("coefficients", "variances")).alias("at", "c")).select("site_id", "model", "at", F.col("c.coefficients").alias("b"), F.col("c.variances").alias("v"))
    rows = one.join(sites.select("site_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).distinct(), "site_id")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("site_id")
        b, v, place = g["b"].to_numpy(), np.maximum(g["v"].to_numpy(), 1e-10), fields.position(g["y"], g["x"])
        km = np.linalg.norm(place[:, None] - place[None], axis=-1)
        spread, reach = max(float(np.var(b)), 1e-8), float(np.median(km[km > 0])) if (km > 0).any() else 100.0
        low, high = np.log([spread * 1e-4, 1.0]), np.log([spread * 10 + 1e-6, 2e4])

        def parts(theta):
            tau2, rho = np.exp(np.clip(theta, low, high))
            root = np.linalg.cholesky(tau2 * np.exp(-km / rho) + np.diag(v))
            ones, seen = np.linalg.solve(root, np.ones(len(b))), np.linalg.solve(root, b)
            level = ones @ seen / (ones @ ones)
            return tau2, rho, level, root, seen - level * ones

        def loss(theta):
            _, _, _, root, left = parts(theta)
            outside = theta - np.clip(theta, low, high)
            return left @ left / 2 + np.log(np.diag(root)).sum() + 1e3 * outside @ outside

        start = np.log([spread, np.clip(reach, 1.0, 2e4)])
        theta = bfgs(lambda t: (loss(t), slope(loss, t)), start, tol=1e-5)[0] if len(b) >= 3 else start
        tau2, rho, level, root, left = parts(theta)
        if len(b) < 3:
            level, left = float(b.mean()), np.linalg.solve(root, b - b.mean())
        across = np.linalg.solve(root, tau2 * np.exp(-km / rho))
        return pd.DataFrame({"site_id": g["site_id"], "model": g["model"], "at": g["at"], "mean": level + across.T @ left, "variance": np.maximum(tau2 - (across**2).sum(axis=0), 0), "level": level, "tau2": tau2, "rho": rho})

    kind = fits.schema["site_id"].dataType.simpleString()
    return rows.groupBy("model", "at").applyInPandas(run, f"site_id {kind}, model string, at int, mean double, variance double, level double, tau2 double, rho double")


def with_smoothed(fits: DataFrame, smoothed: DataFrame) -> DataFrame:
    """The fits with smoothed coefficients in place of their own."""
    packed = smoothed.groupBy("site_id", "model").agg(F.sort_array(F.collect_list(F.struct("at", "mean", "variance"))).alias("s"))  # a model's coefficients
    out = fits.drop("coefficients", "variances").join(packed, ["site_id", "model"])
    return out.select("site_id", "model", F.transform("s", lambda r: r["mean"]).alias("coefficients"), F.transform("s", lambda r: r["variance"]).alias("variances"), "extra", "n")


def season_scores(prob: DataFrame, sites: DataFrame, members: int, *, seed: int = 42, field: fields.Field | None = None) -> DataFrame:
    """(site_id, member, z): scores from the normal distribution that a forecast's terciles imply; climate's without one."""
    e = fields.sample(field, sites, members, 1, seed, "season").select("site_id", "member", F.col("z").alias("e"))
    found = e.join(c.tercile_normal(prob), "site_id", "left")
    return found.select("site_id", "member", (F.coalesce("mu", F.lit(0.0)) + F.coalesce("sigma", F.lit(1.0)) * F.col("e")).alias("z"))


def simulate_models(fits: DataFrame, scores: DataFrame, sites: DataFrame, dates: DataFrame, members: int, variables: tuple[str, ...] = (), *, harmonics: int = 2, interaction: bool = True, wet: float = 1.0, truncated: bool = False, seed: int = 42, field: fields.Field | dict | None = None) -> DataFrame:
    """(site_id, member, day, PRCP, variables): seasons over ``dates`` (day, t) for members 0 to ``members`` - 1.

    scores: (site_id, member, z).  The day before the season is wet with the
    share of wet first days.  A site without both rain models has no rows; a
    variable without a model is null.
    """
    calendar = dates.select("day", F.array(F.lit(1.0), *[w for k in range(1, harmonics + 1) for w in scalar.harmonics(F.col("t"), k)]).alias("h"))
    h = np.array([r["h"] for r in calendar.orderBy("day").collect()])  # a season's days
    packed = fits.groupBy("site_id").agg(F.collect_list(F.struct("model", "coefficients", "extra")).alias("fits"))  # a site's models
    drawn = scores.groupBy("site_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("member", "z"))), lambda s: s["z"]).alias("z"))  # members
    rows = packed.join(drawn, "site_id").join(sites.select("site_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")), "site_id")

    def run(batches):
        for batch in batches:
            for r in batch.to_dict("records"):
                own = {f["model"]: (np.asarray(f["coefficients"], float), np.asarray(f["extra"], float)) for f in r["fits"]}
                if not {"occurrence", "amount"} <= set(own):
                    continue
                site, z, n = (int(r["site_id"]), r["y"], r["x"]), np.asarray(r["z"], float)[:members], len(h)
                noise = lambda k, days=n: fields.draws(field.get(k) if isinstance(field, dict) else field, site, members, days, seed, k)  # noqa: E731, B023
                (b, start), (ba, shape), waves = own["occurrence"], own["amount"], h.shape[1]
                e, u = noise("occurrence"), np.clip(ndtr(noise("amount")), TINY, 1 - TINY)
                excess = None if truncated else gammaincinv(shape[0], u) / shape[0]
                lag = (ndtr(noise("start", 1)[:, 0]) < start[0]).astype(float)
                rain, states = np.zeros((members, n)), np.zeros((members, n))
                for d in range(n):
                    eta = h[d] @ b[:waves] + b[waves] * lag + b[waves + 1] * z + (b[waves + 2] * z * lag if interaction else 0)
                    now = (e[:, d] < eta).astype(float)
                    mean = np.exp(np.clip(h[d] @ ba[:waves] + ba[waves] * lag + ba[waves + 1] * z, -10, 10))
                    if truncated:
                        left = gammaincc(shape[0], shape[0] * wet / mean)
                        amount = np.array([float(gammaincinv(shape[0], 1 - s * (1 - q))) for s, q in zip(left, u[:, d], strict=True)]) * mean / shape[0]
                    else:
                        amount = wet + excess[:, d] * mean
                    rain[:, d], states[:, d], lag = now * amount, now, now
                out = {"site_id": site[0], "member": np.repeat(np.arange(members), n), "day": np.tile(np.arange(n), members), "PRCP": rain.ravel()}
                for v in variables:
                    path = np.full((members, n), np.nan)
                    if v in own:
                        (bv, extra), ev = own[v], noise(v)
                        before = np.full(members, extra[2])
                        for d in range(n):
                            mean = h[d] @ bv[:waves] + bv[waves] * states[:, d] + bv[waves + 1] * before + bv[waves + 2] * z
                            path[:, d] = before = mean + np.where(states[:, d] == 1, extra[1], extra[0]) * ev[:, d]
                    out[v] = pd.Series(path.ravel()).astype(object).where(~np.isnan(path.ravel()), None)
                yield pd.DataFrame(out)

    made = rows.mapInPandas(run, "site_id bigint, member int, day int, PRCP double" + "".join(f", {v} double" for v in variables))
    return made.withColumns({v: scalar.from_latent(v, F.col(v)) for v in variables}) if variables else made


def transmission(made: DataFrame, scores: DataFrame, reference: DataFrame) -> DataFrame:
    """(site_id, slope, intercept, correlation) of the generated seasons' scores, by the sites' totals of record, on the
    scores that they were made from."""
    sample = reference.where("total >= 0").groupBy("site_id").agg(F.collect_list("total").alias("sample"))  # one value a year
    totals = made.groupBy("site_id", "member").agg(F.sum("PRCP").alias("total")).join(sample, "site_id")
    count = lambda f: F.size(F.filter("sample", f)).cast("double")
    p = (count(lambda v: v < F.col("total")) + count(lambda v: v == F.col("total")) / 2 + 0.5) / (F.size("sample") + 1.0)
    rows = totals.select("site_id", "member", scalar.inverse_normal(p).alias("got")).join(scores, ["site_id", "member"])
    cov, vx, vy = F.covar_pop("z", "got"), F.var_pop("z"), F.var_pop("got")
    b = F.try_divide(cov, vx)
    return rows.groupBy("site_id").agg(b.alias("slope"), (F.avg("got") - b * F.avg("z")).alias("intercept"), F.try_divide(cov, F.sqrt(vx * vy)).alias("correlation"))
