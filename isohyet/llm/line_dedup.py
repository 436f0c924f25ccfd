"""Line dedup by a deletion-neighbourhood join, edit bound 1.

DataFrame functions only.  Lines are what line feeds separate, without white
space at their ends; distinct lines carry the place (document, line number) of
their first occurrence.  A line's neighbourhood is the line itself and every
variant with one character deleted, as hashed keys:

* a substitution at position i: both lines give the same variant when i is
  deleted, so the key is (variant, i);
* an insertion: the longer line gives the shorter one as a variant, so the
  keys are (variant, longer) and (line, shorter).

Equal keys are joined through their earliest line, a star and never a pair of
any two: if a key's earliest line comes before a line, the two are verified by
edit distance, and the later one goes.  The earliest occurrence of a line
stays unless a line within the edit bound occurs earlier; all other occurrences
go.

Every line takes part, short ones as well.  What keeps that affordable is that
a variant whose deletion lies where no other line differs can meet nobody:

* two lines within one edit agree on their first or their last characters, of a
  number that follows from the length (``ends_of``); a grouping by those finds
  the lines that can have a partner at all;
* these are narrowed: a piece of more than PIECE characters is cut in eight, and
  of two lines within one edit the seven parts without the edit agree, those
  before it counted from the front and those after it from the back.  Only
  parts for which another line has the same seven others go on;
* what is left, pieces of at most PIECE characters, emits its variants, keyed
  with all that was cut away.

So a line costs its length a round, however long it is, and the number of keys
does not grow with it.

Cases: null and empty texts have no lines (n_lines 0, empty kept text); empty
lines stay where they are; very long lines take part like all others; rows
alike in id and text are one document and get equal results, rows that share
the id alone are documents of their own, in the order of a hash of the text; a
row without an id comes after all others; an empty table gives an empty result;
of the input only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WS_CHARS, Scratch, Sieve

#: Characters of a piece that emits its variants; longer ones are cut in PARTS.
PIECE, PARTS = 64, 8
SAME, SELF, LONGER = 0, 1, 2
LAST = 2**63 - 1
LINE = ["h1", "h2"]


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and (id, rid): a key of rows that are alike in id and text; rows without an id are last."""
    out = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return out.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("text").alias("rid"))


def lines_of(rows: DataFrame) -> DataFrame:
    """id, rid, line_no, line, h1 of all lines that aren't empty."""
    out = rows.select("id", "rid", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "raw"))
    return out.select("id", "rid", "line_no", F.trim(F.col("raw"), F.lit(WS_CHARS)).alias("line")).where("line <> ''").withColumn("h1", F.xxhash64("line"))


def second_hash(line: Column) -> Column:
    """With h1 the 128 bits that name a line."""
    return F.xxhash64(F.lit(7), line)


def ends_of(line: Column) -> Column:
    """Keys of which two lines within one edit share at least one: about half of a line from the front, and from the back."""
    n = F.length(line)
    half = lambda m: F.floor(m / 16).cast("int") * 8
    ends = lambda q: [F.xxhash64(F.substr(line, F.lit(1), q), q, F.lit(0)), F.xxhash64(F.substr(line, n - q + 1, q), q, F.lit(1))]
    own = F.array(*ends(half(n)))
    return F.when(half(n) == half(n - 1), own).otherwise(F.concat(own, F.array(*ends(half(n - 1)))))


def narrowed(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """The pieces of (h1, h2, line) that can hold an edit: h1, h2, class (the shorter line's length), longer, context, n, piece.

    A line of n characters takes part in the class n as the shorter one and in
    the class n - 1 as the longer one; n is the shorter one's part of a piece.
    """
    kinds = F.explode(F.array(F.struct(F.length("line").alias("n"), F.lit(False).alias("longer")), F.struct((F.length("line") - 1).alias("n"), F.lit(True).alias("longer"))))
    state = lines.select(*LINE, "line", kinds.alias("k")).select(*LINE, "k.longer", "k.n", F.xxhash64("k.n").alias("context"), F.col("line").alias("piece")).where("n > 0")
    state, done, turn = scratch.write(state, "pieces-0"), [], 0
    while True:
        done.append(state.where(F.col("n") <= PIECE))
        if not state.where(F.col("n") > PIECE).limit(1).count():
            break
        turn += 1
        width = F.floor(F.col("n") / PARTS).cast("int")

        def part(j: Column) -> Column:
            have = F.length("piece")
            before = j * width
            after = F.when(j < PARTS - 1, F.col("n") - before - width).otherwise(0)
            context = F.xxhash64("context", j, F.substr("piece", F.lit(1), before), F.substr("piece", have - after + 1, after))
            return F.struct((F.col("n") - before - after).cast("int").alias("n"), context.alias("context"), F.substr("piece", before + 1, have - before - after).alias("piece"))

        cut = state.where(F.col("n") > PIECE).select(*LINE, "longer", F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), part)).alias("p")).select(*LINE, "longer", "p.*")
        shared = cut.groupBy("context").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("longer")).alias("short")).where("rows > 1 AND short > 0").select("context")
        state = scratch.write(cut.join(shared, "context", "left_semi"), f"pieces-{turn}")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def neighbourhood(piece: Column, longer: Column, context: Column) -> Column:
    """The keys of a piece: structs (key, kind), kind SAME for substitutions, SELF or LONGER for insertions."""
    at = F.sequence(F.lit(0), F.length(piece) - 1)
    without = lambda i: F.concat(F.substr(piece, F.lit(1), i), F.substr(piece, i + 2, F.length(piece)))
    one = lambda key, kind: F.struct(key.alias("key"), F.lit(kind).alias("kind"))
    own = F.array(one(F.xxhash64(context, piece), SELF))
    changed = F.transform(at, lambda i: one(F.xxhash64(context, without(i), i), SAME))
    shorter = F.array_distinct(F.transform(at, lambda i: one(F.xxhash64(context, without(i)), LONGER)))
    return F.when(longer, shorter).otherwise(F.concat(own, changed))


def near_lines(lines: DataFrame, places: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2, near): the distinct lines that have an earlier line within one edit."""
    ends = places.select(*LINE, F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("end")
    able = scratch.write(ends.join(shared, "end", "left_semi").select(*LINE).distinct(), "able")
    sieve = Sieve(able, F.col("h1"), able.count(), scratch, "sieve")
    texts = sieve.passed(lines, F.col("h1")).select("h1", second_hash(F.col("line")).alias("h2"), "line").groupBy(*LINE).agg(F.first("line").alias("line"))
    texts = scratch.write(texts.join(able, LINE, "left_semi").join(distinct.select(*LINE, "first"), LINE), "texts")
    pieces = narrowed(texts.select(*LINE, "line"), scratch)
    keys = pieces.select(*LINE, F.explode(neighbourhood(F.col("piece"), F.col("longer"), F.col("context"))).alias("k")).select(*LINE, "k.key", "k.kind")
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key")
    keys = scratch.write(keys.join(many, "key", "left_semi").join(texts.select(*LINE, "first"), LINE), "keys")
    # The earliest line of each key, by side: for an insertion the two sides look at each other.
    side = F.when(F.col("kind") == SELF, LONGER).when(F.col("kind") == LONGER, SELF).otherwise(SAME)
    earliest = keys.groupBy("key", "kind").agg(F.min(F.struct("first", *LINE)).alias("e")).select("key", side.alias("kind"), "e")
    asked = keys.join(earliest, ["key", "kind"]).where(F.col("e.first") < F.col("first")).select(*LINE, F.col("e.h1").alias("o1"), F.col("e.h2").alias("o2")).distinct()
    both = asked.join(texts.select(*LINE, "line"), LINE).join(texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other")), ["o1", "o2"])
    return scratch.write(both.where(F.levenshtein("line", "other", 1) >= 0).select(*LINE).distinct().withColumn("near", F.lit(True)), "near")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines (not empty ones), n_kept, text (what is left, lines as they were)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    rows = rows_of(docs, id_col, text_col)
    lines = lines_of(rows)
    places = lines.select("id", "rid", "line_no", "h1", second_hash(F.col("line")).alias("h2"), ends_of(F.col("line")).alias("ends"))
    places = scratch.write(places, "places")
    place = F.struct("id", "rid", "line_no")
    distinct = scratch.write(places.groupBy(*LINE).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")), "distinct")
    near = near_lines(lines, places, distinct, scratch)
    # Only lines that occur twice or have a near one lose an occurrence.
    known = distinct.join(near, LINE, "left").where("times > 1 OR near").select(*LINE, "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = places.drop("ends").join(known, LINE).where((F.col("first") != place) | F.col("near"))
    gone = gone.groupBy(F.col("id").alias("gone_id"), F.col("rid").alias("gone_rid")).agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    gone = scratch.write(gone, "gone")
    # One plan at every size: texts and lists of lines meet by a sort-merge join.
    out = rows.join(gone.hint("merge"), (F.col("id") == F.col("gone_id")) & (F.col("rid") == F.col("gone_rid")), "left")
    parts = F.split(F.col("text"), "\n")
    filled = F.size(F.filter(parts, lambda x: F.trim(x, F.lit(WS_CHARS)) != ""))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    n_gone = F.coalesce(F.size("gone"), F.lit(0))
    return out.select("doc_id", filled.cast("bigint").alias("n_lines"), (filled - n_gone).cast("bigint").alias("n_kept"), left.alias("text"))
