"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Two models of order ORDER, one of toxic and one of ordinary labelled texts,
interpolate into the same lower orders: continuation counts over both classes.
An expression that neither class has shown differs by nothing but the mass its
context gives away.  A word's evidence is the difference of its two
log-likelihoods over its length; a text's evidence is that of its strongest
words and of its words on average.  A logistic curve, fitted on labelled rows
that the counts behind it have not seen, turns evidence into a score.

The curve is fitted on about MAX_FIT rows of one remainder, measured by a model
of the others.  The model that scores then counts all labelled rows that may be
learned from, and every letter sequence they show is kept.  A model of up to
MAX_GRAMS sequences goes to the executors whole; a larger one stays a
distributed table, and words are scored by joining their sequences with it.

Cases: a null or empty text has no evidence and gets the curve's score for
none; very long texts are scored whole; repeated rows get equal scores; without
usable labels of both classes every score is the share of toxic labels (0 if
none); labels that repeat an id count once, as toxic if any is; of the input
only id and text, and of the labels only id and label are read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, bounded_batches, slices, small, worker_memory
from .bpe import Remembered, as_texts

ORDER = 4
DISCOUNT = 0.75
#: A model of more letter sequences is never collected or broadcast, but joined.
MAX_GRAMS = 400_000
MAX_FIT = 20_000
#: Words whose evidence a worker remembers, in each of two generations.
REMEMBERED = 60_000
#: Letters that every word counts more in the mean, so that short words are weak evidence.
EXTRA = 3
N_FEATURES = 4
#: Log-likelihood difference from which a word speaks for itself.
CLEAR = 2.0


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def word_of(chunk: bytes) -> str:
    """A chunk in lower case without what isn't a letter or digit at its ends."""
    w = chunk.decode("utf-8", "replace").lower()
    if w.isalnum():
        return w
    i, j = 0, len(w)
    while i < j and not w[i].isalnum():
        i += 1
    while j > i and not w[j - 1].isalnum():
        j -= 1
    return w[i:j]


def grams(word: str) -> list[str]:
    """The sequences of ORDER letters that end at each letter and at the word's end."""
    padded = "^" * (ORDER - 1) + word + "$"
    return [padded[i : i + ORDER] for i in range(len(padded) - ORDER + 1)]


class Model:
    """The difference of the two models' log-likelihoods, by letter sequence and, for unseen ones, by context."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        totals = (defaultdict(float), defaultdict(float))
        types = (defaultdict(int), defaultdict(int))
        for g, toxic, ordinary in counts:
            for k, n in enumerate((toxic, ordinary)):
                if n:
                    totals[k][g[:-1]] += n
                    types[k][g[:-1]] += 1
        lower = self._shared({g for g, _, _ in counts})
        gives = lambda k, h: DISCOUNT * types[k][h] / totals[k][h] if h in totals[k] else 1.0
        self.context = {h: math.log(gives(0, h) / gives(1, h)) for h in {*totals[0], *totals[1]}}
        self.gram = {}
        for g, *n in counts:
            h, back = g[:-1], lower(g[1:])
            p = [(max(n[k] - DISCOUNT, 0) / totals[k][h] if n[k] else 0.0) + gives(k, h) * back for k in (0, 1)]
            self.gram[g] = math.log(p[0] / p[1])

    @staticmethod
    def _shared(highest: set[str]):
        """Interpolated probability of a sequence's last letter, from continuation counts over both classes."""
        orders = []
        seen = highest
        while len(next(iter(seen), "")) > 1:
            count = Counter(g[1:] for g in seen)
            sums, kinds = defaultdict(int), defaultdict(int)
            for g, n in count.items():
                sums[g[:-1]] += n
                kinds[g[:-1]] += 1
            orders.append((count, sums, kinds))
            seen = set(count)
        letters = max(2, len(seen))
        known: dict[str, float] = {}

        def probability(g: str) -> float:
            if not g:
                return 1.0 / letters
            if g in known:
                return known[g]
            count, sums, kinds = orders[ORDER - 1 - len(g)]
            h = g[:-1]
            p = probability(g[1:])
            if h in sums:
                p = max(count.get(g, 0) - DISCOUNT, 0) / sums[h] + DISCOUNT * kinds[h] / sums[h] * p
            known[g] = p
            return p

        return probability

    def evidence(self, word: str) -> tuple[float, int]:
        """Sum over the word's letters and its end, and how many those are."""
        gram, context = self.gram, self.context
        found = [gram[g] if g in gram else context.get(g[:-1], 0.0) for g in grams(word)]
        return sum(found), len(found)


def features(model: Model, memory: Remembered, texts: list[bytes]) -> np.ndarray:
    """For each text: its strongest word, the mean of its three strongest, the mean over all letters, and the
    evidence of all words that have more than CLEAR, on a log scale."""
    cut = [t.lower().split() for t in texts]
    for c in memory.missing(cut):
        memory[c] = complex(*model.evidence(word_of(c)))  # the smallest object that holds two numbers
    out = np.zeros((len(texts), N_FEATURES))
    for i, x in enumerate(cut):
        if x:
            found = np.array(list(map(memory.__getitem__, x)))
            total, n = found.real, found.imag
            share = total / (n + EXTRA)
            best = np.sort(np.partition(share, len(share) - 3)[-3:] if len(share) > 3 else share)
            out[i] = best[-1], best.sum() / 3, total.sum() / n.sum(), math.log1p(float(np.maximum(total - CLEAR, 0.0).sum()))
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([*[ridge] * x.shape[1], 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _head(gram: str) -> Column:
    return F.expr(f"substring({gram}, 1, length({gram}) - 1)")


def _tail(gram: str) -> Column:
    return F.expr(f"substring({gram}, 2)")


class Tables:
    """What Model holds, as distributed tables: (gram, value) and (head, value)."""

    def __init__(self, counted: DataFrame, scratch: Scratch, name: str):
        contexts = counted.groupBy(_head("gram").alias("head")).agg(*(f(k) for k in ("toxic", "ordinary") for f in (lambda k: F.sum(k).alias(f"{k}_total"), lambda k: F.count_if(F.col(k) > 0).alias(f"{k}_types"))))
        gives = lambda k: F.when(F.col(f"{k}_total") > 0, DISCOUNT * F.col(f"{k}_types") / F.col(f"{k}_total")).otherwise(1.0)
        contexts = scratch.write(contexts.select("head", "toxic_total", "ordinary_total", gives("toxic").alias("toxic_gives"), gives("ordinary").alias("ordinary_gives")), f"{name}-contexts")
        own = lambda k: F.when(F.col(k) > 0, F.greatest(F.col(k) - DISCOUNT, F.lit(0.0)) / F.col(f"{k}_total")).otherwise(0.0)
        p = lambda k: own(k) + F.col(f"{k}_gives") * F.col("p")
        rows = counted.select("*", _head("gram").alias("head"), _tail("gram").alias("tail")).join(contexts, "head")
        rows = rows.join(self._shared(counted, scratch, name).withColumnRenamed("gram", "tail"), "tail")
        self.grams = scratch.write(rows.select("gram", F.log(p("toxic") / p("ordinary")).alias("value")), f"{name}-values")
        self.contexts = contexts.select("head", F.log(F.col("toxic_gives") / F.col("ordinary_gives")).alias("value"))

    @staticmethod
    def _shared(counted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """(gram, p) of the sequences one letter shorter, as Model._shared has them."""
        orders, seen = [], counted
        for k in range(ORDER - 1):
            seen = scratch.write(seen.groupBy(_tail("gram").alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"{name}-order-{k}")
            orders.append(seen)
        known, letters = None, max(2, seen.count())
        for order in reversed(orders):
            heads = order.groupBy(_head("gram").alias("head")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
            rows = order.select("gram", "n", _head("gram").alias("head"), _tail("gram").alias("tail")).join(heads, "head")
            rows = rows.withColumn("back", F.lit(1.0 / letters)) if known is None else rows.join(known.select(F.col("gram").alias("tail"), F.col("p").alias("back")), "tail")
            known = rows.select("gram", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * F.col("back")).alias("p"))
        return known

    def words(self, words: DataFrame) -> DataFrame:
        """(word, total, n) of distinct words: sum over the word's letters and its end, and how many those are."""
        cut = words.mapInArrow(_word_grams, "word string, gram string, times int")
        # Values are looked up once per distinct sequence: all words share the context of the first letter.
        asked = cut.select("gram").distinct().withColumn("head", _head("gram"))
        found = asked.join(self.grams, "gram", "left").join(self.contexts.select("head", F.col("value").alias("other")), "head", "left")
        values = found.select("gram", F.coalesce("value", "other", F.lit(0.0)).alias("value"))
        return cut.join(values, "gram").groupBy("word").agg(F.sum(F.col("value") * F.col("times")).alias("total"), F.sum("times").alias("n"))

    def features(self, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """(digest, f0, f1, ...) of (digest, text), as features() has them; texts without words have no row."""
        cut = texts.mapInArrow(_text_words, "digest binary, word string, times int").dropDuplicates(["digest", "word"])
        cut = scratch.write(cut, f"{name}-words")
        known = self.words(cut.select("word").distinct())
        value = F.col("total") / (F.col("n") + EXTRA)
        rows = cut.join(known, "word").withColumn("best", F.array_repeat(value, F.least("times", F.lit(3))))
        best = F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, 3)
        clear = F.sum(F.col("times") * F.greatest(F.col("total") - CLEAR, F.lit(0.0)))
        rows = rows.groupBy("digest").agg(best.alias("best"), (F.sum(F.col("times") * F.col("total")) / F.sum(F.col("times") * F.col("n"))).alias("f2"), F.log1p(clear).alias("f3"))
        return rows.select("digest", F.col("best")[0].alias("f0"), (F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / 3).alias("f1"), "f2", "f3")


def digest_of(text: Column) -> Column:
    """128 bits of SHA-256 of a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("binary"), F.lit("").cast("binary")), 256), 1, 32))


def _word_grams(batches):
    for batch in batches:
        for i, j in slices(batch.num_rows, 10_000):
            rows = [(w, g, n) for w in batch.column(0).slice(i, j - i).to_pylist() for g, n in Counter(grams(w)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], ["word", "gram", "times"])


def _text_words(batches):
    for batch in batches:
        for digest, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), strict=True):
            words = Counter(map(word_of, text.lower().split()))
            for i, j in slices(len(words), 100_000):
                part = list(words.items())[i:j]
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(part), pa.binary()), pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int32())], ["digest", "word", "times"])


def _remembered(key: str) -> Remembered:
    """A worker's words under one model; those of an earlier model go."""
    memory = worker_memory("toxicity")
    if key not in memory:
        memory.clear()
    return memory.setdefault(key, Remembered(REMEMBERED))


def _count_words(batches):
    for batch in batches:
        counts: dict[str, list[int]] = {}
        texts, toxic = as_texts(batch.column(0)), batch.column(1).to_pylist()
        by_class = (Counter(), Counter())
        for t, y in zip(texts, toxic, strict=True):
            by_class[0 if y else 1].update(t.lower().split())
        for k in (0, 1):
            for c, n in by_class[k].items():
                counts.setdefault(word_of(c), [0, 0])[k] += n
        counts.pop("", None)
        for i, j in slices(len(counts), 100_000):
            part = list(counts.items())[i:j]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n[0] for _, n in part], pa.int64()), pa.array([n[1] for _, n in part], pa.int64())], ["word", "toxic", "ordinary"])


def _count_grams(batches):
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for w, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for g in grams(w):
                n = counts.setdefault(g, [0, 0])
                n[0] += a
                n[1] += b
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([n[0] for n in counts.values()], pa.int64()), pa.array([n[1] for n in counts.values()], pa.int64())], ["gram", "toxic", "ordinary"])


def _model(counted: DataFrame, scratch: Scratch, name: str) -> Model | Tables:
    if counted.count() > MAX_GRAMS:
        return Tables(counted, scratch, name)
    return Model([(r[0], r[1], r[2]) for r in counted.toPandas().itertuples(index=False)])


def _curve(got) -> np.ndarray:
    """The curve's weights from measured rows (toxic, f0, f1, ...)."""
    if got["toxic"].nunique() < 2:
        return np.array([1.0, *[0.0] * (N_FEATURES - 1), -2.0])
    return fit_curve(got[[f"f{k}" for k in range(N_FEATURES)]].to_numpy(), got["toxic"].to_numpy(float))


def _score_joined(docs: DataFrame, tables: Tables, weights: np.ndarray, scratch: Scratch, text_col: str) -> DataFrame:
    """(row, score): each row of ``docs`` as a struct, and its score, by joins alone."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), digest_of(F.col(text_col)).alias("digest"))
    found = tables.features(docs.select(digest_of(F.col(text_col)).alias("digest"), F.col(text_col).alias("text")), scratch, "docs")
    z = sum((F.coalesce(F.col(f"f{k}"), F.lit(0.0)) * float(weights[k]) for k in range(N_FEATURES)), F.lit(float(weights[-1])))
    return rows.join(found, "digest", "left").select("row", (1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))).alias("score"))


def _fit(model: Model | Tables, sample: DataFrame, scratch: Scratch) -> np.ndarray:
    """The curve's weights from a sample (text, toxic) that the model hasn't counted."""
    names = [f"f{k}" for k in range(N_FEATURES)]
    if isinstance(model, Tables):
        rows = sample.select("toxic", "text", digest_of(F.col("text")).alias("digest"))
        found = model.features(rows.select("digest", "text"), scratch, "sample")
        return _curve(rows.select("digest", "toxic").join(found, "digest", "left").select("toxic", *names).fillna(0.0).toPandas())
    shared = sample.sparkSession.sparkContext.broadcast(model)  # at most MAX_GRAMS sequences
    key = f"{scratch.base}/fit"

    def measure(batches):
        memory = _remembered(key)
        for batch in batches:
            for i, j in slices(batch.num_rows, 256):
                part = batch.slice(i, j - i)
                f = features(shared.value, memory, as_texts(part.column(0)))
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(f[:, k]) for k in range(N_FEATURES))], ["toxic", *names])

    got = sample.mapInArrow(measure, "toxic int, " + ", ".join(f"{k} double" for k in names)).toPandas()
    shared.unpersist()
    return _curve(got)


def _scorer(shared, key: str, weights: np.ndarray):
    """The score as a function of a text column; only the text goes to Python and only the score comes back."""

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory = _remembered(key)
        for texts in batches:
            out = np.zeros(len(texts))
            for i, j in slices(len(texts), 256):
                f = features(shared.value, memory, as_texts(texts.slice(i, j - i)))
                out[i:j] = 1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.array(out)

    return F.arrow_udf(score, "double")


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model | Tables | None, np.ndarray, float]:
    """The model, the curve's weights and the share of toxic labels, from rows outside the held-out remainder."""
    spark = docs.sparkSession
    usable = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL")
    usable = usable.where(remainder(F.col("id"), folds) != held_out).groupBy("id").agg(F.max("toxic").alias("toxic"))
    usable = scratch.write(usable, "labels")
    n = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    share = n.get(1, 0) / total if total else 0.0
    if len(n) < 2:
        return None, np.zeros(N_FEATURES + 1), share
    fit_fold = (held_out + 1) % folds
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    of = lambda rows: text.join(small(rows, total), "id").select("text", "toxic")
    in_fit = remainder(F.col("id"), folds) == fit_fold
    sums = [F.sum(k).alias(k) for k in ("toxic", "ordinary")]

    def counted(rows: DataFrame, name: str) -> DataFrame:
        words = of(rows).mapInArrow(_count_words, "word string, toxic bigint, ordinary bigint").groupBy("word").agg(*sums)
        return scratch.write(words.mapInArrow(_count_grams, "gram string, toxic bigint, ordinary bigint").groupBy("gram").agg(*sums), name)

    first = counted(usable.where(~in_fit), "grams")
    every = scratch.write(first.union(counted(usable.where(in_fit), "fit-grams")).groupBy("gram").agg(*sums), "all-grams")
    model = _model(every, scratch, "model")
    keep = min(1.0, MAX_FIT / max(1, total / (folds - 1)))
    sample = of(usable.where(in_fit & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(keep * (1 << 20)))))
    weights = _fit(_model(first, scratch, "first"), sample, scratch)
    return model, weights, share


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    With ``keep`` the columns of ``docs`` come back instead, without the rows that are predicted toxic.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    model, weights, share = train(docs, labels, scratch, folds=folds, held_out=held_out, id_col=id_col, text_col=text_col)
    flags = lambda: ((remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    if isinstance(model, Tables):
        scored = _score_joined(docs, model, weights, scratch, text_col)
        if keep:
            return scored.where(F.col("score") < threshold).select("row.*")
        return scored.select(F.col(f"row.{id_col}").alias("doc_id"), "score").select("doc_id", *flags())
    if model is None:
        score = F.lit(share)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_GRAMS sequences
        score = _scorer(shared, scratch.base, weights)(F.col(text_col))
    if keep:
        return docs.where(score < threshold)
    return docs.select(F.col(id_col).alias("doc_id"), score.alias("score")).select("doc_id", *flags())
