"""Weights of historical seasons that meet the forecasts of several season attributes at once.

Weights stay as near to a prior as the forecasts allow, by relative entropy
(``mre``) or by squares (``croley``).  ``soft`` trades misses off against the
distance, each within its tolerance; ``exact`` meets every forecast or raises.
A site is one group: its years times its attributes, bounded by its record.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import logsumexp, nonnegative_least_squares, xlogy
from .conditioning import INVALID, NO_HISTORY, classify

MISSED, FEW_YEARS = 8, 16


@dataclass(frozen=True)
class SeasonalConstraint:
    """A forecast of one attribute: prob (site_id, pb, pn, pa), or None for the main forecast of totals; its tolerance; and
    fixed class limits where the product defines its classes itself."""

    name: str
    prob: DataFrame | None = None
    tolerance: float = 0.01
    limits: tuple[float, float] | None = None

    def __post_init__(self):
        if not (np.isfinite(self.tolerance) and self.tolerance > 0):
            raise ValueError("the tolerance is positive")


def fixed_limits(sites: DataFrame, low: float, high: float) -> DataFrame:
    """(site_id, q33, q67): class limits that the forecast product fixes, in place of terciles."""
    if not (np.isfinite([low, high]).all() and low <= high):
        raise ValueError("limits are finite and ascend")
    return sites.select("site_id", F.lit(float(low)).alias("q33"), F.lit(float(high)).alias("q67"))


def soft_entropy(g: np.ndarray, t: np.ndarray, w0: np.ndarray, tau: np.ndarray, steps: int = 200, tol: float = 1e-10) -> tuple[np.ndarray, bool]:
    """Weights proportional to w0 exp(g l), with l at the minimum of the concave dual's negative; damped Newton steps."""
    start = np.log(np.where(w0 > 0, w0, 1.0)) + np.where(w0 > 0, 0.0, -np.inf)
    ridge = np.diag(tau**2)

    def at(l):
        e = start + g @ l
        total = logsumexp(e)
        return float(total - l @ t + l @ ridge @ l / 2), np.exp(e - total)

    l = np.zeros(len(t))
    value, w = at(l)
    for _ in range(steps):
        mean = g.T @ w
        slope = mean - t + ridge @ l
        if np.abs(slope).max() < tol:
            return w, True
        curve = (g * w[:, None]).T @ g - np.outer(mean, mean) + ridge
        move = -np.linalg.lstsq(curve + 1e-13 * np.eye(len(t)), slope, rcond=None)[0]
        size = 1.0
        while size > 1e-10:
            new, v = at(l + size * move)
            if new <= value + 1e-4 * size * float(slope @ move) + 1e-15:
                break
            size /= 2
        l, value, w = l + size * move, new, v
    return w, bool(np.abs(g.T @ w - t + ridge @ l).max() < 1e-6)


def solve_site(g: np.ndarray, t: np.ndarray, prior: np.ndarray, tau: np.ndarray, method: str = "mre", mode: str = "soft") -> tuple[np.ndarray, bool]:
    """(weights, converged) of one site.  g: (year, feature), t: targets, prior: >= 0, tau: tolerances."""
    if method not in ("mre", "croley") or mode not in ("soft", "exact"):
        raise ValueError("method is mre or croley, mode soft or exact")
    if not (np.isfinite(g).all() and np.isfinite(t).all() and np.isfinite(prior).all() and (prior >= 0).all() and (tau > 0).all()):
        raise ValueError("features, targets and prior are finite, the prior not negative, tolerances positive")
    if prior.sum() <= 0:
        return np.zeros(len(prior)), True
    w0 = prior / prior.sum()
    n, has = len(w0), w0 > 0
    rows = np.vstack([np.ones(n), g.T])
    aim = np.concatenate([[1.0], t])
    if mode == "exact":
        some = nonnegative_least_squares(rows[:, has], aim)
        if np.abs(rows[:, has] @ some - aim).max() > 1e-7:
            raise ValueError("no weights of the prior's years meet the forecasts")
        if method == "mre":
            # A feature that must vanish takes its years' weights away; the others are met by a vanishing penalty.
            gone = (g[:, t <= 1e-12] > 0).any(axis=1)
            w, _ = soft_entropy(g, t, np.where(gone, 0.0, w0), np.full(len(t), 1e-6))
            return w, bool(np.abs(rows @ w - aim).max() < 1e-6)
        scale = np.full(len(aim), 1e7)
    else:
        if method == "mre":
            return soft_entropy(g, t, w0, tau)
        scale = np.concatenate([[1e6], 1 / tau])
    # Squares: n |w - w0|^2 + sum of ((g w - t) / tau)^2 over w >= 0 is one nonnegative least squares problem.
    a = np.vstack([np.sqrt(n) * np.eye(n)[:, has], rows[:, has] * scale[:, None]])
    x = np.zeros(n)
    x[has] = nonnegative_least_squares(a, np.concatenate([np.sqrt(n) * w0, aim * scale]), tol=1e-14)
    return x / x.sum(), True


def constrained_year_weights(values: DataFrame, prob: DataFrame, limits: DataFrame, *, prior: DataFrame | None = None, tolerances: dict[str, float] | None = None, method: str = "mre", mode: str = "soft", miss: float = 0.05, few: float = 5.0) -> DataFrame:
    """(site_id, season_year, w, flags, n_eff, kl, achieved) of historical seasons.

    values: (site_id, season_year, name, value) of the attributes; prob:
    (site_id, name, pb, pn, pa), null where invalid; limits: (site_id, name,
    q33, q67); prior: (season_year, w).  A year takes part if every attribute
    has a class.  achieved maps a name to its three probabilities.  Flags: 2 an
    invalid forecast, 4 no history, 8 a forecast missed by more than ``miss``,
    16 fewer than ``few`` effective years.
    """
    tolerances = tolerances or {}
    rows = values.join(limits, ["site_id", "name"], "left").withColumn("cat", classify(F.col("value"), F.col("q33"), F.col("q67")))
    rows = rows.join(prob, ["site_id", "name"], "left").select("site_id", "season_year", "name", "cat", "pb", "pn", "pa")
    rows = rows.withColumn("w0", F.lit(1.0)) if prior is None else rows.join(F.broadcast(prior.select("season_year", F.col("w").alias("w0"))), "season_year", "left").fillna(0.0, ["w0"])  # one row a year

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted(group["name"].unique())
        cats = group.pivot_table(index="season_year", columns="name", values="cat", aggfunc="first")[names].sort_index()
        prior_of = group.groupby("season_year")["w0"].first().sort_index().to_numpy(float)
        p = group.groupby("name")[["pb", "pn", "pa"]].first().loc[names].to_numpy(float)
        c = cats.to_numpy(float)
        bad = not np.isfinite(p).all()
        w0 = prior_of * (c >= 0).all(axis=1) * (not bad)
        flags, w, kl, n_eff = INVALID * bad, np.zeros(len(c)), np.nan, 0.0
        achieved = {k: [0.0, 0.0, 0.0] for k in names}
        if not bad and w0.sum() == 0:
            flags |= NO_HISTORY
        if w0.sum() > 0:
            g = np.concatenate([(c[:, [k]] == np.arange(3)).astype(float) for k in range(len(names))], axis=1)
            tau = np.repeat([tolerances.get(k, 0.01) for k in names], 3)
            w, _ = solve_site(g, p.ravel(), w0, tau, method, mode)
            got = (w @ g).reshape(-1, 3)
            achieved = {k: got[i].tolist() for i, k in enumerate(names)}
            n_eff, kl = float(1 / (w @ w)), float((xlogy(w, w) - xlogy(w, w0 / w0.sum())).sum())
            flags |= MISSED * bool(np.abs(got - p).max() > miss)
        if not bad:
            flags |= FEW_YEARS * bool(n_eff < few)
        return pd.DataFrame({"site_id": group["site_id"].iloc[0], "season_year": cats.index, "w": w, "flags": int(flags), "n_eff": n_eff, "kl": kl, "achieved": [achieved] * len(w)})

    kinds = {k: values.schema[k].dataType.simpleString() for k in ("site_id", "season_year")}
    return rows.groupBy("site_id").applyInPandas(solve, f"site_id {kinds['site_id']}, season_year {kinds['season_year']}, w double, flags int, n_eff double, kl double, achieved map<string, array<double>>")
