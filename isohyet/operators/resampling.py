"""Drawing, ordering and choosing: quantiles, couplings, templates, allocations, member selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from .conditioning import classify, stratified_quantiles
from .constraints import solve_site


def point_quantiles(sample: DataFrame, m: int, keys: list[str], convention: str = "midpoint") -> DataFrame:
    """(keys, rank, value): m quantiles of the finite values at (i - 1/2) / m, or with ``ecc`` at i / (m + 1), by linear
    interpolation of order statistics.  A key's sample is one ensemble."""
    if convention not in ("midpoint", "ecc") or m < 1:
        raise ValueError("convention is midpoint or ecc, m at least 1")
    ordered = sample.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("v"))
    i = F.col("rank")
    p = (i + 0.5) / F.lit(float(m)) if convention == "midpoint" else (i + 1.0) / F.lit(m + 1.0)
    rows = ordered.select("*", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("rank"))
    rows = rows.withColumn("at", p * (F.size("v") - 1)).withColumn("lo", F.floor("at").cast("int"))
    low, high = F.get("v", F.col("lo")), F.get("v", F.least(F.col("lo") + 1, F.size("v") - 1))
    return rows.select(*keys, "rank", (low + (high - low) * (F.col("at") - F.col("lo"))).alias("value"))


def ranks(rows: DataFrame, keys: list[str], seed: int, *tie: str) -> DataFrame:
    """``rows`` with rank from 0 by value; ties in an order that seed, key and ``tie`` columns alone decide."""
    chance = uniform(F.lit(seed), F.lit("tie"), *[F.col(k) for k in [*keys, *tie]])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("value", chance)) - 1)


def copula_coupling(raw: DataFrame, calibrated: DataFrame, keys: list[str], members: int, method: str = "Q", seed: int = 0) -> DataFrame:
    """(keys, member, value): the calibrated sample's quantiles in the order of the raw members.

    raw: (keys, member, value) with ``members`` members; calibrated: (keys,
    value).  ``Q``: quantiles at i / (m + 1); ``Q-midpoint``: at (i - 1/2) / m;
    ``Q-mean``: means of bins of equal probability; ``R``: random draws.  Ties
    of raw members are broken at random.
    """
    if method in ("Q", "Q-midpoint"):
        values = point_quantiles(calibrated, members, keys, "ecc" if method == "Q" else "midpoint")
    elif method == "Q-mean":
        one = calibrated.where("value IS NOT NULL").select(F.struct(*keys).alias("key"), "value")
        values = stratified_quantiles(one, members, "key").select("key.*", F.col("bin").alias("rank"), "value")
    elif method == "R":
        ordered = calibrated.where("value IS NOT NULL").groupBy(*keys).agg(F.sort_array(F.collect_list("value")).alias("v"))
        drawn = ordered.select("*", F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("i"))
        u = uniform(F.lit(seed), F.lit("draw"), *[F.col(k) for k in keys], F.col("i"))
        drawn = drawn.withColumn("value", F.get("v", F.floor(u * F.size("v")).cast("int")))
        values = drawn.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("value", "i")) - 1).select(*keys, "rank", "value")
    else:
        raise ValueError("method is Q, Q-midpoint, Q-mean or R")
    places = ranks(raw.where("value IS NOT NULL"), keys, seed, "member").select(*keys, "member", "rank")
    return places.join(values, [*keys, "rank"]).select(*keys, "member", "value")


def trajectories(cube: DataFrame, window: int, days: int) -> DataFrame:
    """(season_year, shift, site_id, day, value): the sequences of ``days`` days that begin up to ``window`` days before or
    after day 0.  cube: (site_id, season_year, day, PRCP) with days from -window on."""
    shifts = F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("shift")
    rows = cube.select("season_year", "site_id", "day", F.col("PRCP").alias("value"), shifts).withColumn("day", F.col("day") - F.col("shift"))
    return rows.where((F.col("day") >= 0) & (F.col("day") < days))


def preferential_dates(forecast: DataFrame, paths: DataFrame, n: int) -> DataFrame:
    """(place, season_year, shift, score) of the n historical sequences next to a forecast mean, in standardised anomalies.

    forecast: (site_id, day, value); paths as from ``trajectories``.  The best
    shift of each year comes first, then further shifts; if n exceeds all
    complete sequences, they repeat.
    """
    fields = forecast.where("value IS NOT NULL").select("site_id", "day", F.col("value").alias("f"))
    rows = paths.join(fields, ["site_id", "day"])
    of = Window.partitionBy("site_id", "day")
    spread = F.stddev_pop("value").over(of) + 1e-6
    rows = rows.withColumns({"d": F.pow((F.col("value") - F.col("f")) / spread, 2.0)})
    scores = rows.groupBy("season_year", "shift").agg(F.avg("d").alias("score"), F.count("d").alias("seen")).crossJoin(F.broadcast(fields.agg(F.count(F.lit(1)).alias("fields"))))  # one row
    scores = scores.where("seen = fields")
    best = F.row_number().over(Window.partitionBy("season_year").orderBy("score", "shift"))
    scores = scores.withColumn("later", (best > 1).cast("int")).withColumn("place", F.row_number().over(Window.orderBy("later", "score", "season_year", "shift")) - 1)  # years times shifts
    count = scores.agg(F.count(F.lit(1)).alias("k"))
    rounds = scores.crossJoin(F.broadcast(count)).withColumn("place", F.explode(F.expr(f"sequence(place, greatest(place, {n - 1}), greatest(k, 1))")))  # one row
    return rounds.where(F.col("place") < n).select("place", "season_year", "shift", "score")


def minimum_divergence(forecast: np.ndarray, candidates: np.ndarray, n: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(chosen, divergences): the n candidates left when, one by one, that one goes without which the candidates' marginal
    distributions are next to the forecast's, in the integral of squared differences summed over fields.

    The integral is E|H - Y| - E|H - H'| / 2 - E|Y - Y'| / 2, and each removal
    only updates sums.
    """
    y, h = forecast.reshape(len(forecast), -1), candidates.reshape(len(candidates), -1)
    w = np.ones(y.shape[1]) if weights is None else np.asarray(weights, float).ravel()
    active = np.isfinite(y).any(axis=0) & (w > 0)
    whole = np.flatnonzero(np.isfinite(h[:, active]).all(axis=1))
    if n < 1 or len(whole) < n or not active.any():
        raise ValueError("not enough complete candidates, or no finite forecast")
    y, h, w = y[:, active], h[whole][:, active], w[active]

    def mean_gap(a: np.ndarray, b: np.ndarray) -> float:
        return float(np.nanmean(np.abs(a - b[:, None])))

    to_forecast = np.array([float((w * np.nanmean(np.abs(y - x), axis=0)).sum()) for x in h])
    between = np.array([[float((w * np.abs(a - b)).sum()) for b in h] for a in h])
    own = sum(w[j] * mean_gap(c := y[np.isfinite(y[:, j]), j], c) for j in range(y.shape[1]))
    left = list(range(len(h)))
    cross, pair = to_forecast.sum(), between.sum()
    row = between.sum(axis=1)
    value = lambda c, p, k: max(0.0, c / k - p / (2 * k * k) - own / 2)
    found = [value(cross, pair, len(left))]
    while len(left) > n:
        k = len(left) - 1
        drop = min(left, key=lambda i: (cross - to_forecast[i]) / k - (pair - 2 * row[i]) / (2 * k * k))
        left.remove(drop)
        cross, pair = cross - to_forecast[drop], pair - 2 * row[drop]
        row = row - between[:, drop]
        found.append(value(cross, pair, k))
    return whole[left], np.array(found)


def minimum_divergence_dates(forecast: DataFrame, paths: DataFrame, n: int, most: int = 2_000_000) -> DataFrame:
    """(season_year, shift): the n historical sequences whose marginals are next to the ensemble's, for one region of at
    most ``most`` numbers on either side.  forecast: (member, site_id, day, value)."""

    def matrix(df: DataFrame, rows: list[str]) -> pd.DataFrame:
        if df.limit(most + 1).count() > most:
            raise ValueError(f"a region of more than {most} numbers")
        return df.toPandas().pivot_table(index=rows, columns=["site_id", "day"], values="value", dropna=False)

    ensemble, history = matrix(forecast, ["member"]), matrix(paths, ["season_year", "shift"])
    history = history.reindex(columns=ensemble.columns)
    chosen, _ = minimum_divergence(ensemble.to_numpy(float), history.to_numpy(float), n)
    rows = [(int(a), int(b)) for a, b in history.index[chosen]]
    return forecast.sparkSession.createDataFrame(rows, "season_year int, shift int")


def largest_remainder(shares: DataFrame, total: int, keys: list[str], item: str, share: str = "share") -> DataFrame:
    """``shares`` with n: whole numbers that add up to ``total`` in each key, floors first, then the largest remainders."""
    by = Window.partitionBy(*keys)
    raw = F.lit(float(total)) * F.col(share) / F.sum(share).over(by)
    rows = shares.withColumn("raw", raw).withColumn("n", F.floor("raw").cast("int"))
    rest = F.lit(total) - F.sum("n").over(by)
    place = F.row_number().over(by.orderBy(F.desc(F.round(F.col("raw") - F.col("n"), 12)), item))
    return rows.withColumn("rest", rest).withColumn("n", F.col("n") + F.when(place <= F.col("rest"), 1).otherwise(0)).drop("raw", "rest")


def systematic(weights: DataFrame, n: int, seed: int, keys: list[str], item: str) -> DataFrame:
    """(keys, draw, item): n draws at equal steps of the cumulated weight from one random start a key."""
    by = Window.partitionBy(*keys).orderBy(item)
    whole = F.sum("w").over(Window.partitionBy(*keys))
    rows = weights.where("w > 0").withColumn("hi", F.sum("w").over(by) / whole).withColumn("lo", F.col("hi") - F.col("w") / whole)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(item))) == 1
    u = uniform(F.lit(seed), F.lit("systematic"), *[F.col(k) for k in keys])
    # Draws i with lo <= (u + i) / n < hi; the last item takes what rounding leaves.
    first, until = F.ceil(F.col("lo") * n - u - 1e-12), F.when(last, F.lit(n)).otherwise(F.ceil(F.col("hi") * n - u - 1e-12))
    rows = rows.withColumns({"first": F.greatest(first, F.lit(0)).cast("int"), "until": until.cast("int")}).where("until > first")
    return rows.select(*keys, F.explode(F.sequence("first", F.col("until") - 1)).alias("draw"), item)


def nearest(candidates: DataFrame, keys: list[str], k: int, seed: int, item: str) -> DataFrame:
    """``candidates`` (keys, item, distance) with place and w: the k nearest, ties at random, with weight 1 / place."""
    chance = uniform(F.lit(seed), F.lit("near"), *[F.col(c) for c in keys], F.col(item))
    rows = candidates.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", chance))).where(F.col("place") <= k)
    raw = 1.0 / F.col("place")
    return rows.withColumn("w", raw / F.sum(raw).over(Window.partitionBy(*keys)))


def area_weights(sites: DataFrame) -> DataFrame:
    """(site_id, area) proportional to the cosine of latitude, adding up to 1."""
    raw = F.cos(F.radians("y"))
    return sites.select("site_id", raw.alias("a")).withColumn("area", F.col("a") / F.sum("a").over(Window.partitionBy(F.lit(0)))).drop("a")


def member_features(values: DataFrame, limits: DataFrame, prob: DataFrame, sites: DataFrame) -> DataFrame:
    """(name, member, below, above, whole, t_below, t_above): area-mean shares of each member's cells in the outer classes
    and their targets.  values: (site_id, member, name, value); a member with a missing cell is not whole."""
    rows = values.join(limits, ["site_id", "name"]).withColumn("cat", classify(F.col("value"), F.col("q33"), F.col("q67")))
    rows = rows.join(prob, ["site_id", "name"]).where("pb IS NOT NULL AND q33 IS NOT NULL").join(F.broadcast(area_weights(sites)), "site_id")  # one narrow row a site
    some = F.max("cat").over(Window.partitionBy("site_id", "name")) >= 0
    rows = rows.withColumn("some", some).where("some")
    share = lambda c: F.sum(F.when(c, F.col("area")).otherwise(0.0)) / F.sum("area")
    return rows.groupBy("name", "member").agg(share(F.col("cat") == 0).alias("below"), share(F.col("cat") == 2).alias("above"), (F.min("cat") >= 0).alias("whole"), (F.sum(F.col("pb") * F.col("area")) / F.sum("area")).alias("t_below"), (F.sum(F.col("pa") * F.col("area")) / F.sum("area")).alias("t_above"))


def select_members(values: DataFrame, limits: DataFrame, prob: DataFrame, sites: DataFrame, n: int, *, tolerance: float = 0.01, method: str = "mre", mode: str = "soft", seed: int = 0, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """((member, pool_member), (pool_member, w)): n whole members of a pool of at most ``most`` whose area means are next to
    the forecasts, by weights as for years and systematic draws in random order."""
    spark = values.sparkSession
    features = member_features(values, limits, prob, sites)
    got = features.limit(most + 1).toPandas()  # one narrow row a member and attribute
    if len(got) > most:
        raise ValueError(f"a pool of more than {most} members and attributes")
    names = sorted(got["name"].unique())
    members = np.array(sorted(got["member"].unique()))
    wide = {c: got.pivot(index="member", columns="name", values=c).loc[members, names] for c in ("below", "above", "whole")}
    eligible = wide["whole"].fillna(False).to_numpy(bool).all(axis=1)
    if not eligible.any():
        raise ValueError("no member of the pool has all attributes")
    g = np.concatenate([wide["below"].fillna(0).to_numpy(float), wide["above"].fillna(0).to_numpy(float)], axis=1)
    t = got.groupby("name")[["t_below", "t_above"]].mean().loc[names]
    w, _ = solve_site(g, np.concatenate([t["t_below"], t["t_above"]]), eligible.astype(float), np.full(2 * len(names), tolerance), method, mode)
    weights = spark.createDataFrame([(int(m), float(x)) for m, x in zip(members, w, strict=True)], "pool_member int, w double")
    drawn = systematic(weights.withColumn("pool", F.lit(0)), n, seed, ["pool"], "pool_member")
    order = Window.orderBy(uniform(F.lit(seed), F.lit("shuffle"), F.col("draw")))  # n rows
    return drawn.select((F.row_number().over(order) - 1).alias("member"), "pool_member"), weights


