"""Sources: daily observations, forecasts and ensembles as long panels, with their checks."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names of the daily variables.
VARIABLES = ("PRCP", "TMIN", "TMAX", "HUMIN", "HUMAX", "WIND", "SOLAR")
#: Names that forecasts use for the three categories.
CATEGORY_NAMES = {
    "pb": ("PB", "BN", "BELOW", "EARLY", "SHORT", "LOW", "PRECOCE"),
    "pn": ("PN", "NN", "NORMAL", "NEAR", "NORMALE"),
    "pa": ("PA", "AN", "ABOVE", "LATE", "LONG", "HIGH", "TARDIVE", "LONGUE"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplied_days(spark: SparkSession, sf_dir: str, span: tuple[str, str] | None = None) -> DataFrame:
    """Line items with their day and their supplier's nation as site; only the columns that are used are read, and with
    ``span`` (first day, last day) only row groups that can hold such days."""
    items = table(spark, sf_dir, "lineitem")
    if span is not None:
        after = (datetime.date.fromisoformat(span[1]) + datetime.timedelta(1)).isoformat()
        items = items.where((F.col("l_shipdate") >= F.lit(span[0]).cast("timestamp")) & (F.col("l_shipdate") < F.lit(after).cast("timestamp")))
    items = items.select("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.to_date("l_shipdate").alias("t"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("site_id"))
    return items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"])


def record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t): the days of the record, from the first item's to the last's."""
    span = table(spark, sf_dir, "lineitem").agg(F.to_date(F.min("l_shipdate")).alias("d0"), F.to_date(F.max("l_shipdate")).alias("d1"))
    return span.select(F.explode(F.sequence("d0", "d1")).alias("t"))


def observations(spark: SparkSession, sf_dir: str, days: DataFrame | None = None, span: tuple[str, str] | None = None) -> DataFrame:
    """(t, site_id, y, x, variables): one row for each day of the record and site; days without items are dry.

    ``days`` (t) and the ``span`` that holds them ask for some days only, and the scan reads no others.
    """
    rows = supplied_days(spark, sf_dir, span)
    daily = rows.groupBy("site_id", "t").agg(
        F.sum("l_quantity").alias("PRCP"), (F.min("l_extendedprice") / 1000).alias("TMIN"), (F.max("l_extendedprice") / 1000).alias("TMAX"),
        (F.min("l_discount") * 1000).alias("HUMIN"), (F.max("l_discount") * 1000).alias("HUMAX"), (F.avg("l_tax") * 100).alias("WIND"), (F.avg("l_extendedprice") / 2000).alias("SOLAR"),
    )
    days = record(spark, sf_dir) if days is None else days
    sites = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site_id")).distinct()
    grid = sites.crossJoin(F.broadcast(days))  # a calendar for each site, which the panel consists of
    out = grid.join(daily, ["site_id", "t"], "left").withColumn("PRCP", F.coalesce("PRCP", F.lit(0.0)))
    return out.select("t", "site_id", F.expr("site_id div 5").alias("y"), (F.col("site_id") % 5).alias("x"), *VARIABLES)


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def canonicalize(obs: DataFrame) -> DataFrame:
    """Impossible values as null: negative amounts, humidity over 100, and both ends of an inverted range."""
    out = obs
    for v in VARIABLES:
        if v in obs.columns:
            x = finite(F.col(v))
            if v in ("PRCP", "WIND", "SOLAR", "HUMIN", "HUMAX"):
                x = F.when(x >= 0, x)
            if v in ("HUMIN", "HUMAX"):
                x = F.when(x <= 100, x)
            out = out.withColumn(v, x)
    for low, high in (("TMIN", "TMAX"), ("HUMIN", "HUMAX")):
        if {low, high} <= set(obs.columns):
            inverted = F.coalesce(F.col(low) > F.col(high), F.lit(False))
            out = out.withColumns({low: F.when(~inverted, F.col(low)), high: F.when(~inverted, F.col(high))})
    return out


def validate_grid(obs: DataFrame) -> DataFrame:
    """One row: rows, distinct keys, null keys, latitudes out of range; a valid grid has rows = keys and 0, 0."""
    return obs.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("site_id", "t").alias("n_keys"), F.count_if(F.col("t").isNull() | F.col("site_id").isNull()).alias("n_null_keys"), F.count_if(F.abs("y") > 90).alias("n_bad_latitude"))


def exact_align(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two panels that must have the same keys; a key of one side only raises."""
    both = left.withColumn("__l", F.lit(1)).join(right.withColumn("__r", F.lit(1)), keys, "full")
    checked = both.withColumn("__ok", F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.lit("the panels have different keys")).cast("boolean")))
    return checked.where("__ok").drop("__l", "__r", "__ok")


def prepare_probabilities(prob: DataFrame) -> DataFrame:
    """(site_id, pb, pn, pa) as fractions that add up to 1; a triple that is partial, negative, or more than 2 % off
    1 or 100 is null as a whole."""
    total = F.col("pb") + F.col("pn") + F.col("pa")
    ok = (F.least("pb", "pn", "pa") >= 0) & F.col("pb").isNotNull() & F.col("pn").isNotNull() & F.col("pa").isNotNull() & ((F.abs(total - 1) <= 0.02 + 1e-12) | (F.abs(total - 100) <= 2 + 1e-9))
    return prob.select("site_id", *[F.when(ok, F.col(c) / total).alias(c) for c in ("pb", "pn", "pa")])


def relabel(labels: Column) -> Column:
    """The category pb, pn or pa that a label names; an unknown label raises."""
    key, out = F.upper(F.trim(labels)), None
    for name, known in CATEGORY_NAMES.items():
        hit = key.isin(*known)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(labels, F.lit("none")))).cast("string"))


def nearest_axis(targets: DataFrame, sources: DataFrame, axis: str) -> DataFrame:
    """(target, source): for each target coordinate the nearest source coordinate, null outside their range.

    Axes are one-dimensional and short; the cells are joined on them by equality afterwards.
    """
    s = sources.select(F.col(axis).cast("double").alias("source")).distinct()
    t = targets.select(F.col(axis).cast("double").alias("target")).distinct()
    inside = t.crossJoin(F.broadcast(s.agg(F.min("source").alias("lo"), F.max("source").alias("hi"))))  # one row
    axis_values = s.agg(F.sort_array(F.collect_set("source")).alias("axis"))  # an axis, not the cells
    near = F.array_min(F.transform("axis", lambda a: F.struct(F.abs(a - F.col("target")).alias("d"), a.alias("s"))))["s"]
    return inside.crossJoin(F.broadcast(axis_values)).select("target", F.when(F.col("target").between(F.col("lo"), F.col("hi")), near).alias("source"))
