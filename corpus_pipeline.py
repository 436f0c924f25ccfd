"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, BPE, each on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a frame that is written and read again as the next one's docs.  All but
the last return the columns of documents.

Cases: a row without an id, and rows that share one, are documents of their own
in every stage, told apart by their texts; rows alike in id and text are copies
of each other, of which exact dedup leaves one; a null or empty text is no near
copy of anything; an empty table passes through all stages; other columns, of
any name, pass untouched through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from isohyet.llm._common import Scratch
from isohyet.llm.queries import table, vocabulary

#: No SQL expresses the models, the similarity or the merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=True)


LAST = 2**63 - 1


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id; rows without an id come last."""
    own = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    kept = exact_dedup.exact_dedup(docs).where("kept").select(own.alias("own_id"), F.unhex("text_sha256").alias("own_digest")).distinct()
    rows = exact_dedup.with_digest(docs).select("row", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("own_id"), F.col("digest").alias("own_digest"), "n_chars")
    rows = rows.join(kept.hint("merge"), ["own_id", "own_digest"], "left_semi")
    # Rows of one id and digest are in one place already; of those alike one stays.
    nth = F.row_number().over(Window.partitionBy("own_id", "own_digest").orderBy(F.desc("n_chars"), F.xxhash64("row")))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Ids that are missing or not unique are replaced, for the comparison only, by a hash of id and text.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("bigint").alias("near_id"), "text")
    unclear = docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id")
    if unclear.limit(1).count():
        marked = unclear.select(F.coalesce("doc_id", F.lit(LAST)).alias("asked"), F.lit(True).alias("unclear"))
        rows = rows.join(marked, F.coalesce("near_id", F.lit(LAST)) == F.col("asked"), "left")
        rows = rows.select("row", F.when(F.col("unclear"), F.xxhash64("near_id", "text")).otherwise(F.col("near_id")).alias("near_id"), "text")
    kept = near_dedup.near_dedup(rows, id_col="near_id").where("kept").select(F.col("doc_id").alias("near_id")).distinct()
    return rows.join(kept.hint("merge"), "near_id", "left_semi").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's target asks."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every repetition."""
    return bpe.encode_documents(docs, vocabulary(), full=False)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
