"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

The weight of a source is configuration, so the sources are known to the
driver: one narrow row each, at most MAX_SOURCES of them.  A source whose share
of the budget exceeds ``max_epochs`` times its size is clamped there and its
excess goes to the others in proportion to their weights, until none is above.

A target of e epochs takes every document floor(e) times whole.  The rest, less
than one epoch, goes to documents in the order of a seeded hash: all before the
point where the rest is used up, and of the one document at that point the
words that are still missing, so a source's words meet its target to the word.
That point is found from sums over hash buckets, whose number follows the
largest source, and an order within one bucket only.

Cases: a null text has size 0; null is a source of its own, after all others;
a source without words has target 0; ties of the hash go to the smaller id;
repeated rows are documents of their own, equal in all columns or not; an empty
table gives an empty result; other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch

MAX_SOURCES = 1_000_000
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the largest source in the bucket that has to be put in order, about.
IN_ORDER = 4096


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sizes: list[int], weights: list[float], budget: float, max_epochs: float) -> list[float]:
    """Targets in proportion to the weights, none above ``max_epochs`` times its size."""
    caps = [max_epochs * s for s in sizes]
    open_, targets, left = set(range(len(sizes))), [0.0] * len(sizes), float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        for i in open_:
            targets[i] = left * weights[i] / total
        above = {i for i in open_ if targets[i] > caps[i]}
        if not above:
            break
        for i in above:
            targets[i] = caps[i]
        open_ -= above
        left = float(budget) - sum(caps[i] for i in range(len(sizes)) if i not in open_)
    return targets


def plan(docs: DataFrame, *, budget_share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 0, scratch: Scratch | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken (words, repeats counted), whole."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    sized = scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.shiftrightunsigned(order, 1).alias("at")), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # Python compares code points
    sizes = [r["source_size"] for r in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], budget_share * sum(sizes), max_epochs)
    bits = max(8, math.ceil(math.log2(max(1, *(r["n"] for r in found), 1) / IN_ORDER + 1)))
    rows = []
    for r, t in zip(found, targets, strict=True):
        whole = min(math.floor(t / r["source_size"]), math.floor(max_epochs)) if r["source_size"] else 0
        rows.append((r["source"], r["source_size"], float(t), whole, round(t - whole * r["source_size"])))
    kinds = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())])
    goals = F.broadcast(spark.createDataFrame(rows, kinds))  # at most MAX_SOURCES narrow rows
    # Where the rest of each source is used up: sums by hash bucket, then a running sum over a source's buckets.
    bucket = F.shiftright(F.col("at"), 63 - bits)
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    until = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    ends = sums.withColumn("until", until).alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).where((F.col("until") >= F.col("rest")) & (F.col("rest") > 0)).groupBy(F.col("s.source").alias("source")).agg(F.min(F.struct("bucket", (F.col("until") - F.col("words")).alias("before"))).alias("end"))
    ends = scratch.write(ends.select("source", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before")), "ends")
    goals = goals.alias("g").join(ends.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").select(F.col("g.source").alias("goal_source"), "source_size", "target", "whole", "rest", "end_bucket", "before")
    joined = sized.join(F.broadcast(goals), sized["source"].eqNullSafe(F.col("goal_source"))).drop("goal_source").withColumn("bucket", bucket)
    at_end = F.col("bucket") == F.col("end_bucket")
    earlier = Window.partitionBy("source").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = joined.where(at_end).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    outside = joined.where(F.coalesce(~at_end, F.lit(True)))
    before_end = F.coalesce(F.col("bucket") < F.col("end_bucket"), F.lit(False))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    taken = lambda extra: (F.col("whole") * F.col("size") + extra).cast("bigint").alias("taken")
    return outside.select(*columns, taken(F.when(before_end, F.col("size")).otherwise(0)), "whole").unionByName(inside.select(*columns, taken(part), "whole"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: the columns of ``docs``, each row as many times as it is taken.

    The one document of a source that is taken in part has its first words in
    that repetition.  Rows alike in id, source and text size may stand for each
    other, so their plans are dealt out as (taken, how often) and each row takes
    one, and their sum is the plan's.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    chosen = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    kinds = chosen.groupBy(F.col("doc_id").alias("id"), "source", "size", "taken").agg(F.count(F.lit(1)).alias("n"))
    # A key's rows differ in what they take only where a source's rest is used up, so at most one key a source does.
    kinds = kinds.groupBy("id", "source", "size").agg(F.sort_array(F.collect_list(F.struct("taken", "n")), False).alias("kinds"))
    kinds = scratch.write(kinds.where(F.col("kinds")[0]["taken"] > 0), "kinds")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("own_id"), F.col(source_col).cast("string").alias("own_source"), words(F.col(text_col)).alias("own_size"))
    alike = F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size"))
    several = kinds.where(F.size("kinds") > 1)
    taking = rows.join(kinds.where(F.size("kinds") == 1), alike).select("row", "size", F.col("kinds")[0]["taken"].alias("taken"))
    if several.limit(1).count():
        nth = F.row_number().over(Window.partitionBy("own_id", "own_source", "own_size").orderBy(F.xxhash64("row"))).alias("nth")
        dealt = several.select("id", "source", "size", F.explode(F.transform("kinds", lambda x, i: F.struct(x["taken"].alias("taken"), F.aggregate(F.slice("kinds", 1, i), F.lit(0).cast("bigint"), lambda a, y: a + y["n"]).alias("after"), x["n"].alias("n")))).alias("k"))
        picked = rows.join(F.broadcast(several.select("id", "source", "size")), alike).select("*", nth)  # at most one row a source
        picked = picked.drop("id", "source", "size").join(F.broadcast(dealt), alike & (F.col("nth") > F.col("k.after")) & (F.col("nth") <= F.col("k.after") + F.col("k.n")))
        taking = taking.unionByName(picked.select("row", "size", F.col("k.taken").alias("taken")))
    rows = taking.where("taken > 0")
    # Repetition k holds the words from k * size on: all of them, or those of the last, partial one.
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    held = F.least(F.col("size"), F.col("taken") - F.col("k") * F.col("size"))
    text = F.col("row").getField(text_col)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), held.cast("int")), " ")
    out = F.col("row").withField(f"`{text_col}`", F.when(held < F.col("size"), cut).otherwise(text))
    return rows.select(out.alias("row")).select("row.*")
