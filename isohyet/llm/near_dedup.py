"""Near duplicates: one-permutation hashing, optimal densification, bands, star-shaped candidates.

1. Each document's set is its distinct shingles of five words (A-Z lower-cased;
   fewer words: the whole sequence), as 64-bit hashes.  One hash a shingle
   deals it to a bin and is its value there; an empty bin borrows from the
   first non-empty bin of a random order of its own.  BANDS bands of ROWS bins.
2. Documents with equal sets form a class; from here on only class
   representatives (smallest id) go on, and membership is joined back at the end.
3. Representatives that agree on a band meet in a bucket.  A bucket's candidate
   edges are a star: its centre, the member that meets most others, to each
   other member.  All stars of one centre make its galaxy; every edge is
   confirmed on full sets, and components follow.
4. What a star can't tell is whether two members of a galaxy that are not in one
   component are linked with each other.  Each member is written as its
   difference d from the centre (what it lacks and what it adds).  Two sets u, v
   have |u xor v| = |du| + |dv| - 2 |du & dv|, and they are linked if that is at
   most L (|u| + |v|) with L = (100 - percent) / (100 + percent).  One of two
   members of different components is not linked with the centre, so links need
   at least (1 - L) / 2 |dv| common differences, where dv is the smaller one;
   hence v shares one of its rarest |dv| - needed + 1 differences with u.  Only
   members that do are compared, again on full sets.  This loses nothing, and
   what a galaxy has in common with its centre costs nothing.
5. Components are the least id reachable over confirmed links.

At 85 of 100, a pair is missed by all bands with a probability of 3e-7 or less.
Texts never move: the sets of bucket members are made where their texts are
read, behind a Bloom filter of the members whose size is bounded (FILTER_BITS);
what it lets through wrongly finds no partner in the joins that follow.

Cases: null texts and texts without words have empty sets, link with nothing
and are kept; very long texts are taken whole; equal sets of any number cost
one representative; rows that repeat an id are one document, with the set of the
first of them by (size, digests), and have equal rows in the result; a row
without an id is left out; an empty table gives an empty result; of the input
only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, bounded_batches, worker_memory
from .bpe import as_texts

WORDS = 5
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
#: Bytes of text that are hashed at once.
AT_ONCE = 500_000
#: Bits of the filter of bucket members, at most; it has 16 for each member below that.
FILTER_BITS = 1 << 27
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


#: The published SplitMix64 finaliser's shifts and multipliers.
FINALISER = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    for shift, factor in FINALISER:
        x = x ^ (x >> U(shift))
        if factor > 1:
            x = x * U(factor)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(1, n), U)
    have = 1
    while have < n:
        step = U(pow(base, have, 2**64))
        out[have : 2 * have] = out[: min(have, n - have)] * step
        have *= 2
    return out


def power_table(base: int, n: int) -> np.ndarray:
    known = worker_memory("shingles")
    if base not in known or len(known[base]) < n:
        known[base] = powers(base, max(n, 2 * AT_ONCE))
    return known[base][:n]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of all shingles of the texts, distinct by text, in the order of owner and hash.

    A word's hash is a polynomial of its bytes, taken from running sums over
    the whole batch, so no step runs by word.
    """
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    sums = np.concatenate([np.zeros(1, U), np.cumsum((raw.astype(U) + U(1)) * power_table(BASE, len(raw)), dtype=U)])
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = mix((sums[end] - sums[start]) * power_table(INVERSE, len(raw))[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(start, begins)  # index of each text's first word
    n_words = np.diff(first)
    many = n_words >= WORDS
    owner_of_word = np.repeat(np.arange(len(texts)), n_words)
    full = np.flatnonzero(np.arange(len(word)) <= np.repeat(first[1:] - WORDS, n_words))
    h = np.zeros(len(full), U)
    for k in range(WORDS):
        h = mix(h + word[full + k] + U(k + 1))
    owner = owner_of_word[full]
    few = np.flatnonzero((n_words > 0) & ~many)
    if len(few):
        g = n_words[few].astype(U)
        for k in range(WORDS - 1):
            has = n_words[few] > k
            g[has] = mix(g[has] + word[first[few[has]] + k] + U(k + 101))
        owner, h = np.concatenate([owner, few]), np.concatenate([h, g])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        owner, h = owner[new], h[new]
    return owner, h


def donor_orders(bins: int, seed: int = 7) -> np.ndarray:
    """For each bin (row) a random order of all bins, the same for every document."""
    return np.argsort(mix(np.arange(bins * bins, dtype=U).reshape(bins, bins) + U(seed << 32)), axis=1)


ORDERS = donor_orders(BINS)


def signatures(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation signature of each of n sets (rows), densified; and which sets have elements."""
    spread = mix(h ^ U(0xA5A5A5A55A5A5A5A))
    bin_ = ((spread >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    value = np.zeros((n, BINS), U)
    full = np.zeros((n, BINS), bool)
    order = np.lexsort((spread, owner))  # within a set the bins ascend with the hash, so the first of a bin is least
    o, b, s = owner[order], bin_[order], spread[order]
    if len(o):
        first = np.concatenate([[True], (o[1:] != o[:-1]) | (b[1:] != b[:-1])])
        value[o[first], b[first]] = s[first]
        full[o[first], b[first]] = True
    some = full.any(axis=1)
    row, col = np.nonzero(~full & some[:, None])
    for k in range(BINS):
        if not len(row):
            break
        donor = ORDERS[col, k]
        hit = full[row, donor]
        value[row[hit], col[hit]] = value[row[hit], donor[hit]]
        row, col = row[~hit], col[~hit]
    return value, some


def digests(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each of n sets."""
    ends = np.searchsorted(owner, np.arange(n + 1))
    total = lambda x: np.diff(np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])[ends])
    return total(mix(h + U(1))).view(np.int64), total(mix(h ^ U(0x123456789ABCDEF))).view(np.int64)


def describe(texts: list[bytes]) -> tuple[list, list, list, list]:
    """For each text: set size, two 64-bit digests of the set, and its band hashes (null for empty sets)."""
    owner, h = shingles(texts)
    n = len(texts)
    size = np.bincount(owner, minlength=n)
    one, two = digests(owner, h, n)
    value, some = signatures(owner, h, n)
    band = np.zeros((n, BANDS), U)
    for r in range(ROWS):
        band = mix(band + value[:, r::ROWS] + U(r + 1))
    band = mix(band + np.arange(BANDS, dtype=U)).view(np.int64)
    return size.tolist(), one.tolist(), two.tolist(), [b.tolist() if s else None for b, s in zip(band, some, strict=True)]


def by_bytes(texts: list[bytes]):
    """Ranges of texts that together have about AT_ONCE bytes."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= AT_ONCE):
            n += len(texts[j]) + 1
            j += 1
        yield i, j
        i = j


def _described(batches):
    names = ["doc_id", "n_shingles", "one", "two", "bands"]
    for batch in batches:
        texts = as_texts(batch.column(1))
        for i, j in by_bytes(texts):
            size, one, two, bands = describe(texts[i:j])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names)


def member_filter(nodes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits of a Bloom filter with one hash of the ids in ``nodes``, their remainder, and its modulus (2^k - 1)."""
    bits = 1 << 15
    while bits < min(16 * n, FILTER_BITS):
        bits <<= 1
    place = F.pmod(F.col("node"), F.lit(bits - 1)) + 1
    found = nodes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()  # at most FILTER_BITS bits
    out = np.zeros((bits // (1 << 15), 1 << 12), np.uint8)
    for r in found:
        out[r["b"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel(), bits - 1


def sets_of(texts: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(node, one, items) of the texts whose id is one of ``members`` (node), and of a few more."""
    passes, modulus = member_filter(members, n)
    shared = texts.sparkSession.sparkContext.broadcast(passes)  # at most FILTER_BITS / 8 bytes

    def run(batches):
        known = shared.value
        for batch in batches:
            at = np.mod(batch.column(0).to_numpy(zero_copy_only=False), modulus)
            batch = batch.filter(pa.array((known[at >> 3] >> (at & 7)) & 1 == 1))
            raw = as_texts(batch.column(1))
            for i, j in by_bytes(raw):
                owner, h = shingles(raw[i:j])
                ends = np.searchsorted(owner, np.arange(j - i + 1))
                one = digests(owner, h, j - i)[0]
                items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(one), items], ["node", "one", "items"])

    return texts.mapInArrow(run, "node bigint, one bigint, items array<bigint>").groupBy("node", "one").agg(F.first("items").alias("items"))


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root): the least node reachable, for all nodes of ``edges`` (a, b).

    Each step sends every node to the least root among its neighbours' roots
    and then to its root's root; steps end when nothing changes.  Grouping is
    combined on the map side, so a node of very many edges costs no more.
    """
    both = scratch.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    roots = scratch.write(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        hooked = roots.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # What a node learns holds for its old root as well, and then everybody jumps to the root's root.
        told = hooked.groupBy(F.col("old").alias("r")).agg(F.min("root").alias("to"))
        jumped = hooked.join(told, F.col("root") == F.col("r"), "left").select("node", "old", F.least("root", F.coalesce("to", "root")).alias("root"))
        new = scratch.write(jumped, f"{name}-{step}")
        changed = new.where(F.col("old") != F.col("root")).limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        roots = new.select("node", "root")
        if not changed:
            return roots


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, a_one, b, b_one, ...) with the shingles that a alone and b alone have, as ``a_only`` and ``b_only``."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("one").alias("a_one"), F.col("items").alias("a_items")), ["a", "a_one"])
    two = one.join(sets.select(F.col("node").alias("b"), F.col("one").alias("b_one"), F.col("items").alias("b_items")), ["b", "b_one"])
    return two.withColumns({"a_size": F.size("a_items"), "b_size": F.size("b_items"), "a_only": F.array_except("a_items", "b_items"), "b_only": F.array_except("b_items", "a_items")}).drop("a_items", "b_items")


def linked(a_size: str, b_size: str, apart: Column, percent: int) -> Column:
    """True if sets that differ in ``apart`` shingles have 100 * intersection >= percent * union."""
    return (100 + percent) * apart <= (100 - percent) * (F.col(a_size) + F.col(b_size))


def candidates(galaxies: DataFrame, percent: int) -> DataFrame:
    """(a, a_one, b, b_one): the pairs of step 4.  galaxies: centre, centre_size, node, one, size, root, d."""
    share = (100 - percent) / (100 + percent)
    rows = galaxies.select("centre", "centre_size", "node", "one", "size", "root", F.size("d").alias("n"), F.explode("d").alias("item"))
    common = rows.groupBy("centre", "item").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    rows = rows.join(common, ["centre", "item"])  # a difference of one member alone is shared with nobody
    rarest = Window.partitionBy("centre", "node").orderBy("times", "item")
    whole = Window.partitionBy("centre", "node")
    rows = rows.withColumns({"held": F.count(F.lit(1)).over(whole), "place": F.row_number().over(rarest)})
    n = F.col("n")
    needed = F.greatest(F.lit(1), F.ceil((1 - share) * n / 2 - 1e-6), F.ceil(((2 - share) * n - share * (F.col("centre_size") + F.col("size"))) / 2 - 1e-6))
    # Differences of its own come first in a member's order, so the place of a common one is after them.
    smaller = rows.where((n - F.col("held") + F.col("place") <= n - needed + 1) & (F.col("held") >= needed))
    few = smaller.select("centre", "item", F.col("node").alias("a"), F.col("one").alias("a_one"), F.col("size").alias("a_size"), F.col("root").alias("a_root"), F.col("n").alias("a_n"), F.col("held").alias("a_held"))
    many = rows.select("centre", "item", F.col("node").alias("b"), F.col("one").alias("b_one"), F.col("size").alias("b_size"), F.col("root").alias("b_root"), F.col("n").alias("b_n"), F.col("held").alias("b_held"))
    able = 2 * F.least("a_held", "b_held") + 1e-6 >= F.col("a_n") + F.col("b_n") - share * (F.col("a_size") + F.col("b_size"))
    met = few.join(many, ["centre", "item"]).where((F.col("a_root") != F.col("b_root")) & able & ((F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))))
    return met.select("a", "a_one", "b", "b_one").distinct()


def link(nodes: DataFrame, texts: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(node, root) of all nodes in components of two or more.  nodes: node, one, bands; texts: node, text."""
    buckets = nodes.select("node", "one", F.posexplode("bands").alias("band", "key"))
    crowded = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.write(buckets.join(crowded, ["band", "key"]), "members")
    meets = scratch.write(members.groupBy("node").agg(F.sum("n").alias("meets")), "meets")
    sets = scratch.write(sets_of(texts, meets.select("node"), meets.count()), "sets")
    ranked = members.join(meets, "node")
    centre = ranked.groupBy("band", "key").agg(F.min(F.struct((-F.col("meets")).alias("rank"), "node", "one")).alias("c"))
    spokes = members.join(centre.select("band", "key", F.col("c.node").alias("b"), F.col("c.one").alias("b_one")), ["band", "key"]).where("node <> b").select(F.col("node").alias("a"), F.col("one").alias("a_one"), "b", "b_one").distinct()
    d = F.concat("a_only", "b_only")
    stars = confirmed(spokes, sets).select(F.col("b").alias("centre"), F.col("b_size").alias("centre_size"), F.col("a").alias("node"), F.col("a_one").alias("one"), F.col("a_size").alias("size"), d.alias("d"), linked("a_size", "b_size", F.size("a_only") + F.size("b_only"), percent).alias("linked"))
    stars = scratch.write(stars, "stars")
    scratch.drop("members")
    links = stars.where("linked").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    roots = connected_components(links, scratch, "first")
    # Galaxies of two components at least; the centre is a member of its own component.
    rooted = stars.select("centre", "node").join(roots, "node", "left").select("centre", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("centre").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_ = scratch.write(open_.where("lo <> hi").select("centre"), "open")
    galaxies = stars.join(open_, "centre", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    pairs = scratch.write(candidates(galaxies, percent), "pairs")
    more = confirmed(pairs, sets).where(linked("a_size", "b_size", F.size("a_only") + F.size("b_only"), percent)).select("a", "b")
    more = scratch.write(more, "links")
    if not more.limit(1).count():
        return roots
    # Components of components: the new links join roots.
    by = roots.select(F.col("node").alias("n"), "root")
    joins = more.join(by, F.col("a") == F.col("n"), "left").select(F.coalesce("root", "a").alias("a"), "b")
    joins = scratch.write(joins.join(by, F.col("b") == F.col("n"), "left").select("a", F.coalesce("root", "b").alias("b")), "joins")
    final = connected_components(joins, scratch, "second").withColumnsRenamed({"node": "old", "root": "new"})
    every = roots.unionByName(joins.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").withColumn("root", F.col("node")))
    return every.join(final, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))


def near_dedup(docs: DataFrame, *, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with an id: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents are linked if 100 * intersection >= percent * union of their shingle sets.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-dedup")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    rows = scratch.write(texts.mapInArrow(_described, "doc_id bigint, n_shingles bigint, one bigint, two bigint, bands array<bigint>"), "rows")
    known = scratch.write(rows.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "one", "two")).alias("s"), F.count(F.lit(1)).alias("times")).select("doc_id", "times", "s.*"), "documents")
    classes = scratch.write(known.where("n_shingles > 0").groupBy("one", "two", "n_shingles").agg(F.min("doc_id").alias("node")), "classes")
    nodes = rows.join(classes.select(F.col("node").alias("doc_id"), "one", "two", "n_shingles"), ["doc_id", "one", "two", "n_shingles"]).groupBy(F.col("doc_id").alias("node"), "one").agg(F.first("bands").alias("bands"))
    nodes = scratch.write(nodes, "nodes")
    roots = link(nodes, texts.withColumnRenamed("doc_id", "node"), scratch, percent)
    named = scratch.write(classes.join(roots, "node", "left").select("one", "two", "n_shingles", F.coalesce("root", "node").alias("component_id")), "named")
    out = known.join(named, ["one", "two", "n_shingles"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), F.explode(F.sequence(F.lit(1), "times")).alias("row")).drop("row")
