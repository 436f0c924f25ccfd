"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

DataFrame functions only.  A document's set is its distinct shingles of WORDS
words (A-Z lower-cased; fewer words: the whole sequence).  Each shingle is
hashed once: the top bits of the hash name its bin, and the least hash of a bin
is the bin's value.  An empty bin borrows from the non-empty bin that comes
first in a random order of its own, the same for all documents.  Of each value
the low BITS bits are packed into hexadecimal digits.  Two fingerprints that
agree in a share m of the bins have the similarity (m - c) / (1 - c) with
c = 2^-BITS, the chance that different values agree, clamped to 0..1.

Cases: a null text is an empty one; texts without words have the fingerprint of
the empty set, which is alike with itself and no other; very long texts are
taken whole; equal texts have equal fingerprints; rows that repeat an id are
ordered by a hash of the text; rows without an id come after all others; ids
may lie anywhere in their range; an empty table gives an empty result; a table
of one document has itself as the next; of the input only the id and the text
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch

WORDS = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8
DIGITS = BITS // 4
#: Documents that one ordered group holds, about, until there are MAX_GROUPS; the next document is found within a
#: group or in the next one.  Bounds between groups are quantiles of a sample of SAMPLE ids a group.
GROUP, MAX_GROUPS, SAMPLE = 256, 1 << 14, 16
LAST = 2**63 - 1


def _with(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once even if ``f`` uses it in a lambda."""
    return F.transform(F.array(value), f)[0]


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles of a text, repeats included; empty for a text without words."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = F.transform(F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def roll(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))
        one = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
        return F.when(n >= WORDS, many).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))

    return _with(each, roll)


def bin_values(hashes: Column) -> Column:
    """The least hash of each non-empty bin, in the order of the bins."""
    # Sorted as signed numbers, the hashes of one bin are together and ascend, so a bin's first is its least.
    bin_of = lambda h: F.shiftright(h, 64 - BIN_BITS)
    return _with(F.sort_array(hashes), lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))))


def densified(values: Column) -> Column:
    """One value for each bin, an empty bin's from the non-empty bin that its own order has first; null for no bins."""
    bin_of = lambda h: (F.shiftright(h, 64 - BIN_BITS) + BINS // 2).cast("int")

    def fill(v: Column) -> Column:
        places = F.transform(v, bin_of)

        def of(bins: Column) -> Column:
            def one(b: Column) -> Column:
                # The order of a bin: its donors by the hash of both numbers.
                donor = lambda: F.array_min(F.transform(v, lambda h: F.struct(F.xxhash64(b, bin_of(h)).alias("o"), h.alias("h"))))["h"]
                at = F.array_position(bins, b)
                return F.when(at > 0, F.get(v, (at - 1).cast("int"))).otherwise(donor())

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), one)

        return _with(places, of)

    return _with(values, lambda v: F.when(F.size(v) == BINS, v).when(F.size(v) > 0, fill(v)))


def fingerprint(text: Column) -> Column:
    """The packed fingerprint, BINS * DIGITS hexadecimal digits; "" for a text without words."""
    # The low bits are taken from the middle of the hash: the top ones name the bin.
    low = lambda v: F.lpad(F.lower(F.hex(F.shiftright(v, 8).bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")))), DIGITS, "0")
    return F.coalesce(F.array_join(F.transform(densified(bin_values(shingle_hashes(text))), low), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Similarity of two fingerprints with bias correction; two empty sets are alike."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda n, i: n + F.when(F.substr(a, i * DIGITS + 1, F.lit(DIGITS)) == F.substr(b, i * DIGITS + 1, F.lit(DIGITS)), 1).otherwise(0))
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same.cast("double") / BINS - chance) / (1 - chance)))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(corrected)


def group_bounds(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row: the ascending ids (at most MAX_GROUPS - 1) at which groups of about equal size begin."""
    n = docs.count()
    groups = max(1, min(MAX_GROUPS, n // GROUP))
    chance = 1.0 if n <= SAMPLE * groups else SAMPLE * groups / n
    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(chance * (1 << 30))).agg(F.sort_array(F.collect_list("id")).alias("ids"))  # about SAMPLE * MAX_GROUPS ids
    # From about 11,600 groups on, the product is beyond 32 bits.
    cut = F.transform(F.sequence(F.lit(1), F.lit(groups - 1)), lambda i: F.get("ids", F.floor(i.cast("bigint") * F.size("ids") / groups).cast("int")))
    return scratch.write(sample.select((cut if groups > 1 else F.array().cast("array<bigint>")).alias("bounds")), "bounds")


def group_of(docs: DataFrame, bounds: DataFrame) -> DataFrame:
    """``docs`` with group: how many bounds are at most the id, by bisection."""
    steps = F.sequence(F.lit(MAX_GROUPS.bit_length() - 2), F.lit(0), F.lit(-1))

    def step(at: Column, k: Column) -> Column:
        further = at + F.pow(F.lit(2), k).cast("int")
        return F.when(F.get("bounds", further - 1) <= F.col("id"), further).otherwise(at)

    return docs.crossJoin(F.broadcast(bounds)).withColumn("group", F.aggregate(steps, F.lit(0), step)).drop("bounds")  # one row


def with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """id, rid, text, next_id, next_rid, next_text: the next document in ascending order, after the last the first.

    Order is made within groups of neighbouring ids, and a group's last document
    takes the first of the next group.  The texts move once, and the first text
    of each group once more.
    """
    grouped = group_of(docs, group_bounds(docs.select("id"), scratch))
    order = Window.partitionBy("group").orderBy("id", "rid")
    rows = grouped.withColumns({"next_id": F.lead("id").over(order), "next_rid": F.lead("rid").over(order), "next_text": F.lead("text").over(order)})
    firsts = grouped.groupBy("group").agg(F.min(F.struct("id", "rid")).alias("f"))
    # At most MAX_GROUPS rows from here on.
    circle = Window.orderBy("group")
    heads = firsts.select("group", "f", F.lead("f").over(circle).alias("after"), F.first("f").over(circle).alias("least"))
    heads = scratch.write(heads.select("group", F.coalesce("after", "least").alias("h")).select("group", F.col("h.id").alias("head_id"), F.col("h.rid").alias("head_rid")), "heads")
    texts = docs.join(F.broadcast(heads.select(F.col("head_id").alias("id"), F.col("head_rid").alias("rid")).distinct()), ["id", "rid"]).groupBy(F.col("id").alias("head_id"), F.col("rid").alias("head_rid")).agg(F.first("text").alias("head_text"))
    heads = scratch.write(heads.join(texts, ["head_id", "head_rid"]), "head-texts")
    last = F.col("next_id").isNull()
    return rows.join(heads, "group").select("doc_id", "id", "rid", "text", F.coalesce("next_id", "head_id").alias("next_id"), F.coalesce("next_rid", "head_rid").alias("next_rid"), F.when(last, F.col("head_text")).otherwise(F.col("next_text")).alias("next_text"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by as
    many of the first of the next document's, or all if it has fewer.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("rid")), scratch)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    made = rows.select("doc_id", "id", "rid", "next_id", "next_rid", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    made = made.select("doc_id", "id", "rid", "next_id", "next_rid", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    made = scratch.write(made, "made")
    following = made.groupBy(F.col("id").alias("next_id"), F.col("rid").alias("next_rid")).agg(F.first("fingerprint").alias("next_fingerprint"))
    out = made.join(following, ["next_id", "next_rid"])
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
