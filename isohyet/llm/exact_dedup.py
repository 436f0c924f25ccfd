"""Exact deduplication with a minimal perfect hash over historical distinct digests.

The index has two tables.  Digests fall into partitions of about KEYS_A_PART
keys and, within one, into buckets of about KEYS_A_BUCKET keys; ``pilots``
holds for each bucket the number that sends its keys to free slots, and
``slots`` holds at each slot the full digest and the locator (length, id) of
the row that wins among the historical copies.  A partition of n digests has
exactly n slots.  A lookup is two equi-joins on small integers, then the slot's
digest is compared byte by byte: equal means a repeat of historical content;
all others are nonmembers and are grouped by digest on their own.

Cases: a null text is an empty one, and all empty or white texts are one group;
ties go to the smallest id; repeated rows count each, and all rows with the
winner's id and text are kept; a row without an id takes part and loses ties to
rows with one; an empty table or an empty history is fine; only the id and the
text are read.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, without_white_space

KEYS_A_PART = 2048
KEYS_A_BUCKET = 4
BUCKETS = KEYS_A_PART // KEYS_A_BUCKET
#: Which seeds deal digests to partitions and buckets; pilots are 0 and more.
PART_SEED, BUCKET_SEED = -1, -2
SLOT = "part int, bucket int, pilot int, part_size int, slot int, digest binary, n_chars int, doc_id bigint"


@dataclass
class Index:
    pilots: DataFrame
    slots: DataFrame
    parts: int


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points of the original text), digest (SHA-256 of the text without white space)."""
    return with_digest(docs, id_col, text_col).drop("row")


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digests`` with the whole row of ``docs`` as the struct ``row``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.length(text).alias("n_chars"), F.unhex(F.sha2(without_white_space(text), 256)).alias("digest"))


def _best() -> Column:
    return F.max(F.struct(F.col("n_chars"), F.bitwise_not("doc_id").alias("neg_id"))).alias("best")


def winners(rows: DataFrame, *keys: str) -> DataFrame:
    """For each key its winner (most code points, then smallest id) and its number of rows; combined on the map side."""
    return rows.groupBy(*keys).agg(_best(), F.count(F.lit(1)).alias("group_size"))


def _hash(seed: int, number: int) -> int:
    """Spark's xxhash64(digest, number) from the hash of the digest, as an unsigned integer."""
    return xxhash.xxh64_intdigest(struct.pack("<i", number), seed=seed)


def place(keys: list[bytes], buckets: int) -> tuple[list[int], list[int], list[int]]:
    """For each key its bucket, its bucket's pilot and its slot; slots are 0 to len(keys) - 1, each used once.

    Large buckets come first; a pilot is the first number that sends all keys
    of the bucket to different free slots.  A bucket of one key may be sent
    straight to a free slot: the pilot is then -1 - slot.
    """
    n = len(keys)
    seeds = [xxhash.xxh64_intdigest(k, seed=42) for k in keys]
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    bucket = [signed(_hash(s, BUCKET_SEED)) % buckets for s in seeds]
    members: dict[int, list[int]] = {}
    for i, b in enumerate(bucket):
        members.setdefault(b, []).append(i)
    pilots, slot, free = [0] * n, [0] * n, [True] * n
    singles = []
    for _, own in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
        if len(own) == 1:
            singles.append(own[0])
            continue
        pilot = 0
        while True:
            at = {signed(_hash(seeds[i], pilot)) % n for i in own}
            if len(at) == len(own) and all(free[a] for a in at):
                break
            pilot += 1
        for i in own:
            pilots[i], slot[i] = pilot, signed(_hash(seeds[i], pilot)) % n
            free[slot[i]] = False
    for i, a in zip(singles, [a for a in range(n) if free[a]], strict=True):
        pilots[i], slot[i] = -1 - a, a
    return bucket, pilots, slot


def build_index(history: DataFrame, scratch: Scratch) -> Index:
    """The index of ``history``, a frame from ``digests``; its digests may repeat, only distinct ones are stored."""
    distinct = scratch.write(winners(history, "digest"), "history")
    parts = max(1, -(-distinct.count() // KEYS_A_PART))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("digest")
        bucket, pilot, slot = place(list(map(bytes, group["digest"])), BUCKETS)
        return group[["part", "digest", "n_chars", "doc_id"]].assign(bucket=bucket, pilot=pilot, slot=slot, part_size=len(group))[[c.split()[0] for c in SLOT.split(", ")]]

    keyed = distinct.select(F.pmod(F.xxhash64("digest", F.lit(PART_SEED)), F.lit(parts)).cast("int").alias("part"), "digest", F.col("best.n_chars").alias("n_chars"), F.bitwise_not("best.neg_id").alias("doc_id"))
    slots = scratch.write(keyed.groupBy("part").applyInPandas(build, SLOT), "slots")
    pilots = slots.select("part", "bucket", "pilot", "part_size").distinct()
    return Index(pilots, slots.select("part", "slot", F.col("digest").alias("slot_digest"), F.col("n_chars").alias("slot_chars"), F.col("doc_id").alias("slot_doc")), parts)


def look_up(rows: DataFrame, index: Index) -> DataFrame:
    """``rows`` of ``digests`` with part, slot, slot_chars, slot_doc: null where the digest is no member."""
    keyed = rows.withColumns({"part": F.pmod(F.xxhash64("digest", F.lit(PART_SEED)), F.lit(index.parts)).cast("int"), "bucket": F.pmod(F.xxhash64("digest", F.lit(BUCKET_SEED)), F.lit(BUCKETS)).cast("int")})
    hashed = F.pmod(F.xxhash64("digest", F.col("pilot")), F.col("part_size")).cast("int")
    found = keyed.join(index.pilots, ["part", "bucket"], "left").withColumn("slot", F.when(F.col("pilot") < 0, -1 - F.col("pilot")).otherwise(hashed))
    found = found.join(index.slots, ["part", "slot"], "left")
    same = F.col("digest") == F.col("slot_digest")
    return found.select("doc_id", "n_chars", "digest", *[F.when(same, F.col(c)).alias(c) for c in ("part", "slot", "slot_chars", "slot_doc")])


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal without white space; the row with the most code
    points stays, then the smallest id.  ``history`` holds earlier documents:
    with it, groups and winners span both tables and a row of ``docs`` is kept
    only if no historical copy beats it.  Without it the rows of ``docs`` whose
    hashed id is even count as the earlier load, so one table is looked up in
    the index of its first half.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = digests(docs, id_col, text_col)
    if history is None:
        rows = scratch.write(rows, "digests")
        index = build_index(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), scratch)
        everything = rows
    else:
        rows = scratch.write(rows.withColumn("new", F.lit(True)).unionByName(digests(history, id_col, text_col).withColumn("new", F.lit(False))), "digests")
        index = build_index(rows.where(~F.col("new")).drop("new"), scratch)
        everything = rows.drop("new")
    found = scratch.write(look_up(everything, index), "found")
    # Each branch is one group-by of narrow rows; the joins back are on its result, one row a group.
    members = winners(found.where(F.col("slot").isNotNull()), "part", "slot")
    others = winners(found.where(F.col("slot").isNull()), "digest")
    asked = found if history is None else scratch.write(look_up(rows.where("new").drop("new"), index), "asked")
    out = asked.where(F.col("slot").isNotNull()).join(members, ["part", "slot"]).select("doc_id", "n_chars", "digest", "best", "group_size")
    out = out.unionByName(asked.where(F.col("slot").isNull()).join(others, "digest").select("doc_id", "n_chars", "digest", "best", "group_size"))
    keep = F.bitwise_not("best.neg_id")
    return out.select("doc_id", keep.alias("keep_id"), "group_size", (F.col("doc_id").eqNullSafe(keep) & (F.col("n_chars") == F.col("best.n_chars"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
