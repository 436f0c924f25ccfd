"""A daily rain simulator: a first-order wet-day chain by month, with exponential amounts above the threshold.

The draws are numbers of (seed, stream, day, member, site), so a member's days
are the same in any layout.  A season is a fold over its days within one row,
so nothing moves but the parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import uniform

OCCURRENCE, AMOUNT, START = 0, 1, -3


def simulate_rain(fit: DataFrame, months: list[int], members: int, seed: int, wet: float = 1.0) -> DataFrame:
    """(site_id, member, day, PRCP) for a season whose day i lies in months[i].

    ``fit`` has site_id, month, p01, p11, pi, wet_mean.  A chance that was not
    seen is the month's share of wet days; a wet mean that was not seen gives
    amounts at the threshold; a site that lacks a month is left out.
    """
    wanted = sorted(set(months))
    one = F.struct(F.coalesce("p01", "pi").alias("p01"), F.coalesce("p11", "pi").alias("p11"), "pi", F.coalesce("wet_mean", F.lit(wet)).alias("mean"))
    sites = fit.where(F.col("month").isin(wanted) & F.col("pi").isNotNull()).groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("month", one.alias("p")))).alias("by"))
    rows = sites.where(F.size("by") == len(wanted)).select("site_id", "by", F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"))
    calendar = F.array(*map(F.lit, months))
    draw = lambda stream, day: uniform(F.lit(seed), F.lit(stream), day, F.col("member"), F.col("site_id"))

    def step(past: Column, day: Column) -> Column:
        p = F.col("by")[F.get(calendar, day)]
        chance = F.when(F.element_at(past, -1) == 1, p["p11"]).otherwise(p["p01"])
        return F.concat(past, F.array((draw(OCCURRENCE, day) < chance).cast("int")))

    start = F.array((draw(OCCURRENCE, F.lit(START)) < F.col("by")[F.lit(months[0])]["pi"]).cast("int"))
    days = F.sequence(F.lit(0), F.lit(len(months) - 1))
    chain = rows.withColumn("wet", F.aggregate(days, start, step))
    out = chain.select("site_id", "member", "by", F.posexplode(F.slice("wet", 2, len(months))).alias("day", "is_wet"))
    excess = F.col("by")[F.get(calendar, F.col("day"))]["mean"] - wet
    return out.select("site_id", "member", "day", F.when(F.col("is_wet") == 1, wet - excess * F.ln(1 - draw(AMOUNT, F.col("day")))).otherwise(0.0).alias("PRCP"))
