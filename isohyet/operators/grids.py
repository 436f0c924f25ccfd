"""Operators on grid cells: block means, bilinear regridding along axes, nearest cells, area weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def block_mean(cells: DataFrame, factor: int, keys: list[str], value: str = "PRCP") -> DataFrame:
    """(keys, iy, ix, mean): means over blocks of factor by factor cells; missing cells are left out, blocks at the
    edge have fewer cells, a block without any is null."""
    block = lambda axis: F.floor(F.col(axis) / factor).cast("bigint").alias(axis)
    return cells.groupBy(*keys, block("iy"), block("ix")).agg(F.avg(value).alias("mean"))


def brackets(targets: DataFrame, axis: DataFrame, name: str) -> DataFrame:
    """(target, lo, hi, share): the axis values on both sides of each target, and the share of the upper one.

    Targets outside the axis are left out.  Both are axes, so their sides are short.
    """
    rows = targets.select(F.col(name).cast("double").alias("target")).distinct()
    source = axis.select(F.col(name).cast("double").alias("s")).distinct()
    n = source.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if n > 100_000:
        raise ValueError(f"the axis {name} has {n} values")
    found = rows.crossJoin(F.broadcast(source)).groupBy("target").agg(F.max(F.when(F.col("s") <= F.col("target"), F.col("s"))).alias("lo"), F.min(F.when(F.col("s") >= F.col("target"), F.col("s"))).alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("target") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return found.where("lo IS NOT NULL AND hi IS NOT NULL").withColumn("share", share)


def bilinear(cells: DataFrame, targets: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, y, x, value) at the targets (y, x), for each field of the keys: bilinear between the four cells around; null outside the grid or next to
    a missing cell."""
    keys = keys or []
    ys, xs = brackets(targets, cells, "y"), brackets(targets, cells, "x")
    asked = targets.select(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).distinct()
    four = asked.join(F.broadcast(ys.select(F.col("target").alias("y"), F.explode(F.array(F.struct(F.col("lo").alias("sy"), (1 - F.col("share")).alias("wy")), F.struct(F.col("hi").alias("sy"), F.col("share").alias("wy")))).alias("a"))), "y")
    four = four.join(F.broadcast(xs.select(F.col("target").alias("x"), F.explode(F.array(F.struct(F.col("lo").alias("sx"), (1 - F.col("share")).alias("wx")), F.struct(F.col("hi").alias("sx"), F.col("share").alias("wx")))).alias("b"))), "x")
    four = four.select("y", "x", F.col("a.sy").alias("sy"), F.col("b.sx").alias("sx"), (F.col("a.wy") * F.col("b.wx")).alias("w")).where("w > 0")
    if keys:
        fields = cells.select(*keys).distinct()
        asked, four = asked.crossJoin(fields), four.crossJoin(fields)
    given = cells.select(*keys, F.col("y").cast("double").alias("sy"), F.col("x").cast("double").alias("sx"), F.col(value).alias("v"))
    met = four.join(given, [*keys, "sy", "sx"], "left").groupBy(*keys, "y", "x").agg(F.when(F.count("v") == F.count(F.lit(1)), F.sum(F.col("w") * F.col("v"))).alias(value))
    return asked.join(met, [*keys, "y", "x"], "left")


def latitude_weights(cells: DataFrame) -> DataFrame:
    """(y, weight): the share of the sphere between the midpoints around each latitude; the outer edges lie half a
    step beyond, at most at the poles; weights add up to 1."""
    axis = cells.select(F.col("y").cast("double").alias("y")).distinct()
    by = Window.partitionBy(F.lit(0)).orderBy("y")  # an axis: a few thousand values at most
    before, after = F.lag("y").over(by), F.lead("y").over(by)
    step_down, step_up = F.coalesce(F.col("y") - before, after - F.col("y"), F.lit(1.0)), F.coalesce(after - F.col("y"), F.col("y") - before, F.lit(1.0))
    low, high = F.greatest(F.lit(-90.0), F.col("y") - step_down / 2), F.least(F.lit(90.0), F.col("y") + step_up / 2)
    area = axis.select("y", (F.sin(F.radians(high)) - F.sin(F.radians(low))).alias("area"))
    return area.select("y", (F.col("area") / F.sum("area").over(Window.partitionBy(F.lit(0)))).alias("weight"))
