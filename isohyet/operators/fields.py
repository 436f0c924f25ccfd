"""Standard normal draws that hang together in space, by counters.

A draw depends on seed, stream, member and day, and on the site's place or
identity, on nothing else: sites can be spread over any number of tasks, and
batches of members agree with one large run.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import inverse_normal
from ..functions.special import ndtr, ndtri, safe_cholesky
from .conditioning import EARTH_KM, kernel_correlation, site_distances


@dataclass(frozen=True)
class Field:
    """A stationary field on the sphere: ``exponential`` or ``power`` correlation in chord kilometres, made of
    ``features`` random waves; each site is exactly standard normal, and a pair's correlation is within about
    1 / sqrt(features) of the kernel."""

    kind: str = "exponential"
    range_km: float = 150.0
    alpha: float = 1.0
    features: int = 256

    def __post_init__(self):
        if self.kind not in ("exponential", "power") or not self.range_km > 0 or not self.alpha > 0 or self.features < 1:
            raise ValueError("the kernel is exponential or power, with a positive range and exponent, and some features")

    def correlation(self, km):
        return np.exp(-np.asarray(km) / self.range_km) if self.kind == "exponential" else (1 + np.asarray(km) / self.range_km) ** -self.alpha

    def waves(self, seed: int) -> np.ndarray:
        """Wave vectors.  exp(-rate d) is the characteristic function of a Cauchy vector: a normal one over a normal number;
        a rate from a Gamma distribution turns it into the power kernel."""
        rng = _generator(seed, "waves")
        v = rng.normal(size=(self.features, 3)) / np.maximum(np.abs(rng.normal(size=(self.features, 1))), 1e-12)
        rate = rng.gamma(self.alpha, 1 / self.range_km, size=(self.features, 1)) if self.kind == "power" else 1 / self.range_km
        return v * rate

    def at(self, y, x, seed: int) -> np.ndarray:
        """The features of places: cosines and sines, of unit length."""
        angle = position(y, x) @ self.waves(seed).T
        return np.concatenate([np.cos(angle), np.sin(angle)], axis=-1) / np.sqrt(self.features)


def position(y, x) -> np.ndarray:
    lat, lon = np.radians(np.asarray(y, float)), np.radians((np.asarray(x, float) + 180) % 360 - 180)
    return EARTH_KM * np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=-1)


def _generator(*key) -> np.random.Generator:
    digest = hashlib.blake2b("|".join(map(str, key)).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest, "little")))


def draws(field: Field | None, site: tuple[int, float, float], members: int, days: int, seed: int, stream: str, member_start: int = 0) -> np.ndarray:
    """(member, day) standard normal numbers of one site; without a field they are independent between sites."""
    out = np.empty((members, days))
    place = None if field is None else field.at(site[1], site[2], seed)
    for i in range(members):
        key = (seed, stream, member_start + i)
        if field is None:
            out[i] = _generator(*key, "site", site[0]).normal(size=days)
        else:
            out[i] = _generator(*key).normal(size=(days, 2 * field.features)) @ place
    return out


def sample(field: Field | None, sites: DataFrame, members: int, days: int, seed: int = 42, stream: str = "field") -> DataFrame:
    """(site_id, member, day, z) of a field."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                z = draws(field, (int(r.site_id), r.y, r.x), members, days, seed, stream)
                yield pd.DataFrame({"site_id": int(r.site_id), "member": np.repeat(np.arange(members), days), "day": np.tile(np.arange(days), members), "z": z.ravel()})

    return sites.select("site_id", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).mapInPandas(run, "site_id bigint, member int, day int, z double")


def dense_sample(field: Field, sites: DataFrame, members: int, days: int, seed: int = 42, stream: str = "dense", most: int = 512) -> DataFrame:
    """(site_id, member, day, z) with exactly the kernel's covariance, for at most ``most`` sites: members are dealt out,
    and each member's task holds the root of the covariance matrix."""
    places = sites.select("site_id", "y", "x").distinct().orderBy("site_id").limit(most + 1).toPandas()
    if len(places) > most:
        raise ValueError(f"more than {most} sites; use a field of features")
    xyz = position(places["y"], places["x"])
    root = safe_cholesky(field.correlation(np.linalg.norm(xyz[:, None] - xyz[None], axis=-1)))
    ids = places["site_id"].to_numpy()

    def run(batches):
        for batch in batches:
            for member in batch["id"]:
                z = np.stack([_generator(seed, stream, member, d).normal(size=len(ids)) @ root.T for d in range(days)])
                yield pd.DataFrame({"site_id": np.tile(ids, days), "member": int(member), "day": np.repeat(np.arange(days), len(ids)), "z": z.ravel()})

    return sites.sparkSession.range(members).mapInPandas(run, "site_id bigint, member int, day int, z double")


def bivariate_normal(a, b, r, nodes: int = 64) -> np.ndarray:
    """Chance that two standard normal numbers of correlation r lie below a and b, by Gauss-Legendre over r."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    a, b, r = (np.asarray(v, float)[..., None] for v in np.broadcast_arrays(a, b, r))
    t = r * (x + 1) / 2
    density = np.exp(-(a * a - 2 * t * a * b + b * b) / (2 * (1 - t * t))) / (2 * np.pi * np.sqrt(1 - t * t))
    return (ndtr(a) * ndtr(b))[..., 0] + (density * w).sum(-1) * r[..., 0] / 2


def latent_of_binary(p, q, both, steps: int = 50) -> np.ndarray:
    """The correlation of normal numbers whose excesses are two events of chances p, q and ``both`` together."""
    a, b = ndtri(np.clip(p, 1e-9, 1 - 1e-9)), ndtri(np.clip(q, 1e-9, 1 - 1e-9))
    lo, hi = np.full(np.shape(both), -0.999), np.full(np.shape(both), 0.999)
    for _ in range(steps):
        mid = (lo + hi) / 2
        low = bivariate_normal(a, b, mid) < both
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def pair_correlations(values: DataFrame, sites: DataFrame, *, transform: str = "gaussian", least: int = 30, pairs: int = 2000, seed: int = 42, most: int = 2500) -> DataFrame:
    """(a, b, km, n, physical, latent) of a sample of site pairs: half near neighbours, half any.

    values: (site_id, time, value).  ``gaussian`` turns a site's values into
    normal scores, ``binary`` reads 0 and 1 as events of latent normal numbers,
    ``none`` takes values as they are.
    """
    if transform not in ("gaussian", "binary", "none"):
        raise ValueError("transform is gaussian, binary or none")
    rows = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    usable = rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).where(f"n >= {least} AND hi > lo").select("site_id")
    near = site_distances(sites.join(usable, "site_id", "left_semi"), most)
    order = F.row_number().over
    chance = F.xxhash64("a", "b", F.lit(seed))
    near = near.withColumn("by_distance", order(Window.orderBy("km", chance))).withColumn("by_chance", order(Window.orderBy(chance)))  # at most most^2 / 2 narrow rows
    near = near.where((F.col("by_distance") <= pairs // 2) | (F.col("by_chance") <= pairs - pairs // 2)).select("a", "b", "km")
    if transform == "gaussian":
        of = Window.partitionBy("site_id")
        n = F.count(F.lit(1)).over(of)
        same = F.count(F.lit(1)).over(Window.partitionBy("site_id", "value"))
        rank = F.rank().over(of.orderBy("value")) + (same - 1) / 2.0
        rows = rows.withColumn("score", inverse_normal((rank - 0.5) / n))
    else:
        rows = rows.withColumn("score", F.col("value"))
    left, right = (rows.select(F.col("site_id").alias(k), "time", F.col("value").alias("v" + k), F.col("score").alias("s" + k)) for k in "ab")
    both = F.broadcast(near).join(left, "a").join(right, ["b", "time"])  # at most ``pairs`` pairs
    corr = lambda x, y: F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    out = both.groupBy("a", "b", "km").agg(F.count(F.lit(1)).alias("n"), corr("va", "vb").alias("physical"), corr("sa", "sb").alias("latent"), F.avg("va").alias("pa"), F.avg("vb").alias("pb"), F.avg(F.col("va") * F.col("vb")).alias("pab"))
    out = out.where((F.col("n") >= least) & F.col("physical").isNotNull())
    if transform == "binary":

        def invert(batches):
            for batch in batches:
                yield batch.assign(latent=latent_of_binary(batch["pa"], batch["pb"], batch["pab"]) if len(batch) else batch["latent"])

        out = out.mapInPandas(invert, out.schema)
    return out.select("a", "b", "km", "n", "physical", "latent")


def fit_field(correlations: DataFrame, kind: str = "exponential", features: int = 256, most: int = 100_000) -> tuple[Field, dict]:
    """The kernel next to sampled correlations (at most ``most`` pairs), robustly, with diagnostics; 150 km without any pair.

    The range, and for a power kernel the exponent, are searched on a grid of
    logarithms that is refined around its best point.
    """
    got = correlations.limit(most).toPandas()
    if got.empty:
        return Field(kind, features=features), {"status": "no usable pairs", "pairs": 0}
    km, latent = got["km"].to_numpy(float), got["latent"].to_numpy(float)
    weight = np.sqrt(np.maximum(got["n"].to_numpy(float) - 3, 1))
    weight /= np.median(weight)

    def loss(range_km, alpha):
        r = (Field(kind, float(range_km), float(alpha), features).correlation(km) - latent) * weight / 0.1
        return float((np.sqrt(1 + r * r) - 1).sum())

    centre, width = np.array([np.log(150.0), 0.0]), np.array([np.log(1e4), np.log(20.0) if kind == "power" else 0.0])
    for _ in range(24):
        grid = [(a, b) for a in np.linspace(centre[0] - width[0], centre[0] + width[0], 9) for b in (np.linspace(centre[1] - width[1], centre[1] + width[1], 9) if width[1] else [0.0])]
        grid = [(float(np.clip(a, np.log(0.01), np.log(1e6))), float(np.clip(b, np.log(0.05), np.log(20.0)))) for a, b in grid]
        centre = np.array(min(grid, key=lambda g: loss(np.exp(g[0]), np.exp(g[1]))))
        width = width * 0.55
    field = Field(kind, float(np.exp(centre[0])), float(np.exp(centre[1])) if kind == "power" else 1.0, features)
    error = field.correlation(km) - latent
    return field, {"status": "fit", "pairs": len(got), "latent_rmse": float(np.sqrt(np.mean(error**2))), "negative_share": float((latent < 0).mean()), "physical_latent_gap": float(np.abs(got["physical"] - latent).mean())}


def feature_error(field: Field, sites: DataFrame, seed: int = 42, most: int = 2500) -> DataFrame:
    """One row (pairs, rmse, largest): how far the waves' correlation is from the kernel over all pairs of a sample of sites."""
    pairs = site_distances(sites, most).select("a", "b", "km", kernel_correlation(F.col("km"), field.kind, field.range_km, field.alpha).alias("exact"))
    place = sites.select(F.col("site_id").alias("s"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    for k in "ab":
        pairs = pairs.join(place.withColumnsRenamed({"s": k, "y": "y" + k, "x": "x" + k}), k)

    def run(batches):
        for batch in batches:
            made = (field.at(batch["ya"], batch["xa"], seed) * field.at(batch["yb"], batch["xb"], seed)).sum(-1) if len(batch) else batch["exact"]
            yield pd.DataFrame({"error": made - batch["exact"]})

    return pairs.mapInPandas(run, "error double").agg(F.count(F.lit(1)).alias("pairs"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.max(F.abs("error")).alias("largest"))
