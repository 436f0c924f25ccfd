"""Scores of ensembles against training totals and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import inverse_normal


def rps_ensemble(members: DataFrame, keys: list[str], fair: bool = False) -> DataFrame:
    """(keys, rps): ranked probability score of the members' classes (cat) against the observed class (seen); the fair
    one takes off what a finite ensemble adds, and needs two members."""
    below = [F.avg((F.col("cat") <= k).cast("double")).alias(f"f{k}") for k in (0, 1)]
    rows = members.where("cat BETWEEN 0 AND 2 AND seen BETWEEN 0 AND 2").groupBy(*keys).agg(*below, F.max("seen").alias("seen"), F.count(F.lit(1)).alias("n"))
    score: Column = sum((F.pow(F.col(f"f{k}") - (F.col("seen") <= k).cast("double"), 2) for k in (0, 1)), F.lit(0.0))
    if fair:
        extra = sum((F.col(f"f{k}") * (1 - F.col(f"f{k}")) for k in (0, 1)), F.lit(0.0))
        score = F.when(F.col("n") > 1, score - F.try_divide(extra, F.col("n") - 1))
    return rows.select(*keys, score.alias("rps"))


def brier_ensemble(p: Column, outcome: Column, n: Column) -> Column:
    """The fair Brier score of a share p of n members; null below two members or outside 0 to 1."""
    return F.when((p >= 0) & (p <= 1) & (n > 1), F.pow(p - outcome, 2) - F.try_divide(p * (1 - p), n - 1))


def ensemble_positions(target: DataFrame, train: DataFrame, key: str = "site_id") -> DataFrame:
    """``target`` (key, ..., total) with position, (below + equal / 2 + 1) / (n + 2) among the pooled training totals of
    its site, and score, the normal quantile there.

    One ordered pass over both, so no target meets every training total.
    """
    both = target.select("*", F.lit(1).alias("asked")).unionByName(train.select(key, "total", F.lit(0).alias("asked")), allowMissingColumns=True).where("total IS NOT NULL")
    given = 1 - F.col("asked")
    until = F.sum(given).over(Window.partitionBy(key).orderBy("total"))
    equal = F.sum(given).over(Window.partitionBy(key, "total"))
    n = F.sum(given).over(Window.partitionBy(key))
    place = (until - equal + 0.5 * equal + 1) / (n + 2)
    out = both.withColumn("position", F.when(n > 0, place.cast("double"))).where("asked = 1").drop("asked")
    return out.withColumn("score", inverse_normal(F.col("position")))


def model_tercile_probabilities(target: DataFrame, train: DataFrame, keys: list[str], key: str = "site_id") -> DataFrame:
    """(keys, pb, pn, pa): shares of the target's members in the terciles of the pooled training totals; ties go to
    the lower class."""
    limits = train.groupBy(key).agg(F.percentile("total", 1 / 3).alias("lo"), F.percentile("total", 2 / 3).alias("hi"))
    rows = target.where("total IS NOT NULL").join(limits, key)
    low, mid = F.col("total") <= F.col("lo"), F.col("total") <= F.col("hi")
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(*keys).agg(share(low).alias("pb"), share(mid & ~low).alias("pn"), share(~mid).alias("pa"))
