"""Language identification by hierarchical discrimination.

First the language family, then within it the language: at either level linear
support vector machines stand one against one and vote.  The features of a text
are the shares of hashed letter sequences of length 1 to 3 within words.  The
machines are linear in those shares, so a word contributes a fixed vector that
a worker computes once and remembers.

Learning uses about SAMPLE texts of each language, chosen by a hash of the id;
everything else runs over all rows.  A language without a known family is a
family of its own.  More than MAX_LANGUAGES languages raise an error: duels grow
with their square.

Cases: a null text or one without letters is ``und`` with score 0; ties of
votes go to the larger sum of margins, then to the first by name; very long
texts are read whole; repeated rows get equal answers; without any usable label
all rows are ``und``; with one language all rows with letters are that one; of
the input only id, text and, to learn from, lang are read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, slices, worker_memory
from .bpe import Remembered, as_texts
from .near_dedup import mix
from .toxicity import remainder, word_of

DIMENSIONS = 4096
SAMPLE = 500
MAX_LANGUAGES = 1000
REMEMBERED = 150_000
#: Families by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt uz",
    "semitic": "am ar he mt",
    "indo-iranian": "bn fa gu hi mr ne pa ps si ur",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"of {lang}")


def sequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed sequences of 1 to 3 letters of all words with their borders, word after word for each length; where each
    word's begin in each of the three parts (rows of the second result); and how many each word has.  No word is empty."""
    text = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    last = np.cumsum(length)  # behind each word
    parts, starts, base = [], [], 0
    for n in (1, 2, 3):
        code = text[: len(text) - n + 1].copy()
        for k in range(1, n):
            code |= text[k : len(text) - n + 1 + k] << np.uint64(21 * k)
        crossing = np.zeros(len(code), bool)
        for k in range(1, n):
            crossing[last[:-1] - k] = True  # would run into the next word
        parts.append((mix(code + np.uint64(n << 58)) % np.uint64(DIMENSIONS)).astype(np.int64)[~crossing])
        starts.append(base + np.cumsum(length - n + 1) - (length - n + 1))
        base += len(parts[-1])
    return np.concatenate(parts), np.array(starts), 3 * length - 3


def shares(texts: list[bytes]) -> np.ndarray:
    """One row a text: the share of each hashed sequence, times 100."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        if words := [w for c in t.lower().split() if (w := word_of(c))]:
            found = sequences(words)[0]
            out[i] = np.bincount(found, minlength=DIMENSIONS) * (100.0 / len(found))
    return out


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """Linear support vector machine (squared hinge) by dual coordinate descent; the last weight is the constant."""
    a = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    diagonal = (a * a).sum(1) + 0.5 / cost
    alpha, w = np.zeros(len(a)), np.zeros(a.shape[1])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(a)):
            g = y[i] * (a[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - g / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * a[i]
                most = max(most, abs(new - alpha[i]) * diagonal[i])
                alpha[i] = new
        if most < 1e-3:
            break
    return w


class Hierarchy:
    """Machines of both levels; all weights are columns of one matrix."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(c) for c in self.langs})
        lang, fam = np.array(langs), np.array([family_of(c) for c in langs])
        self.duels: list[tuple[str, str, str]] = []  # level or family, first, second
        columns = []
        for a, b in itertools.combinations(self.families, 2):
            columns.append(self._duel(x, fam, a, b))
            self.duels.append(("", a, b))
        for f in self.families:
            for a, b in itertools.combinations([c for c in self.langs if family_of(c) == f], 2):
                columns.append(self._duel(x, lang, a, b))
                self.duels.append((f, a, b))
        self.weights = np.array(columns).T if columns else np.zeros((DIMENSIONS + 1, 0))

    @staticmethod
    def _duel(x: np.ndarray, names: np.ndarray, a: str, b: str) -> np.ndarray:
        of = (names == a) | (names == b)
        return svm(x[of], np.where(names[of] == a, 1.0, -1.0))

    def vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the winner's index among names, and a confidence from its closest duel."""
        n = len(margins)
        votes, sums, closest = np.zeros((n, len(names))), np.zeros((n, len(names))), np.full((n, len(names)), 30.0)
        for k, (at, a, b) in enumerate(self.duels):
            if at == level:
                for name, m in ((a, margins[:, k]), (b, -margins[:, k])):
                    i = names.index(name)
                    votes[:, i] += m > 0
                    sums[:, i] += m
                    closest[:, i] = np.minimum(closest[:, i], m)
        best = np.argmax(votes + np.tanh(sums / 1e3) * 0.49, axis=1)
        return best, 1 / (1 + np.exp(-np.clip(2 * closest[np.arange(n), best], -30, 30)))

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        top, score = self.vote("", self.families, margins)
        out = [""] * len(margins)
        for f, family in enumerate(self.families):
            rows = np.flatnonzero(top == f)
            names = [c for c in self.langs if family_of(c) == family]
            best, inner = self.vote(family, names, margins[rows])
            score[rows] *= inner
            for r, b in zip(rows, best, strict=True):
                out[r] = names[b]
        return out, score


class Words:
    """Vectors of words: the duels' weights summed over a word's sequences, how many those are, and if it has a letter;
    remembered as bytes, because joining those costs less than stacking arrays."""

    def __init__(self, model: Hierarchy):
        self.model, self.at = model, Remembered(REMEMBERED)

    def margins(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        cut = [t.lower().split() for t in texts]
        w = self.model.weights
        if new := self.at.missing(cut):
            words = [word_of(c) for c in new]
            some = np.flatnonzero(np.fromiter(map(bool, words), bool, len(words)))
            vector = np.zeros((len(new), w.shape[1] + 2))
            if len(some):
                words = [words[i] for i in some]
                found, starts, n = sequences(words)
                vector[some, :-2] = np.add.reduceat(w[found], starts.ravel(), axis=0).reshape(3, len(some), -1).sum(axis=0)
                vector[some, -2] = n
                vector[some, -1] = [x.isalpha() or any(map(str.isalpha, x)) for x in words]
            raw, step = vector.tobytes(), vector.itemsize * vector.shape[1]
            self.at.update({c: raw[i * step : (i + 1) * step] for i, c in enumerate(new)})
        total = np.zeros((len(texts), w.shape[1] + 2))
        for i, x in enumerate(cut):
            if x:
                total[i] = np.frombuffer(b"".join(map(self.at.__getitem__, x))).reshape(len(x), -1).sum(axis=0)
        n = np.maximum(total[:, -2:-1], 1)
        return total[:, :-2] / n * 100.0 + w[-1], total[:, -1] > 0


def language_id(docs: DataFrame, *, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1)."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    usable = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn from")
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    chosen = F.lit(False)
    for r in counts:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (chance < min(1 << 30, (SAMPLE << 30) // r["n"])))

    def describe(batches):
        for batch in batches:
            for i, j in slices(batch.num_rows, 64):
                part = batch.slice(i, j - i)
                x = shares(as_texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], ["lang", "x"])

    got = usable.where(chosen).select("lang", "text").mapInArrow(describe, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    held = (remainder(F.col("doc_id"), folds) == held_out).alias("held_out")
    if got.empty:
        return rows.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = spark.sparkContext.broadcast(Hierarchy(np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32), got["lang"].tolist()))
    key = f"{spark.sparkContext.applicationId}-{model.id if hasattr(model, 'id') else id(model)}-{np.abs(model.value.weights).sum()}"

    def predict(batches):
        memory = worker_memory("language")
        if key not in memory:
            memory[key] = Words(model.value)
        words = memory[key]
        for batch in batches:
            for i, j in slices(batch.num_rows, 256):
                part = batch.slice(i, j - i)
                margins, letters = words.margins(as_texts(part.column(1)))
                names, score = words.model.predict(margins)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n if a else "und" for n, a in zip(names, letters, strict=True)], pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held, "lang_pred", "score")
