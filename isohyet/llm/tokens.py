"""Token counts with a digest cache.

The cache is a table (tokenizer, content, n_tokens): the SHA-256 of the
tokenizer's file and of the normalised text, and the stored count.  A run joins
its documents to it by both digests, encodes one document of each text that
the cache lacks, appends those counts, and joins again.

Cases: a null text counts as an empty one; very long texts are encoded whole;
equal texts share one entry, so repeated rows give repeated results; a row
without an id is counted like any other; an empty table gives an empty result; of the input only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WS_CLASS, Scratch, bounded_batches, path_exists, slices, worker_memory
from .bpe import Remembered, as_texts, chunks_of

#: Chunks whose count a worker remembers, in each of two generations.
REMEMBERED = 600_000
#: Bytes of unknown chunks that go to the library in one call.
CALL_BYTES = 200_000
CACHE_SCHEMA = "tokenizer string, content binary, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def drops_white_space(path: str) -> bool:
    """True for a tokenizers file whose white space only separates words: runs of it are replaced by one space
    and the split keeps none of it.  Then texts that differ in runs of white space have equal counts, and a
    count is the sum over the parts between white space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return any(s.get("pattern") == {"Regex": r"\s+"} for s in steps) and split.get("behavior") == "Removed" and bool(split.get("invert"))


def content_digest(text: Column, collapse: bool) -> Column:
    """SHA-256 of the normalised text: null as empty and, with ``collapse``, runs of white space as one space."""
    text = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.regexp_replace(text, WS_CLASS + "+", " ") if collapse else text, 256))


_libraries: dict[str, object] = {}


def library(path: str):
    if path not in _libraries:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        if path.endswith(".model"):
            import sentencepiece

            _libraries[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _libraries[path] = Tokenizer.from_file(path)
            _libraries[path].no_truncation()
            _libraries[path].no_padding()
    return _libraries[path]


class ChunkCounter:
    """Counts of chunks between white space, by a tokenizers library that drops white space.

    A chunk that the normaliser leaves as it is falls into words at the split pattern; words are encoded once,
    many in one call.  Any other chunk goes to the library as it is.
    """

    def __init__(self, path: str):
        self.tokenizer = library(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.special = tuple(t["content"][0] for t in spec["added_tokens"])
        self.chunks, self.known = Remembered(REMEMBERED), Remembered(REMEMBERED // 2)

    def split(self, chunk: str) -> list[str] | None:
        if chunk.isascii():
            if chunk.isprintable() and chunk[:-1].isalpha() and chunk.islower() and chunk[-1] not in self.special:
                return [chunk] if chunk.isalpha() else [chunk[:-1], chunk[-1]]
            if not chunk.isprintable() or chunk != chunk.lower():
                return None
        elif chunk != chunk.lower() or "\u03c2" in chunk or not unicodedata.is_normalized("NFC", chunk) or not chunk.isprintable():
            return None
        if any(s in chunk for s in self.special):
            return None
        return self.words(chunk)

    def by_call(self, parts: list[str]) -> list[int]:
        """Tokens of each part, by encoding many at once and dealing the tokens out by where they begin."""
        out: list[int] = []
        i = 0
        while i < len(parts):
            begins, j, at = [], i, 0
            while j < len(parts) and (j == i or at < CALL_BYTES):
                begins.append(at)
                at += len(parts[j]) + 1
                j += 1
            found = self.tokenizer.encode(" ".join(parts[i:j]), add_special_tokens=False)
            starts = np.array([a for a, _ in found.offsets], np.int64)
            out += np.bincount(np.searchsorted(begins, starts, "right") - 1, minlength=j - i).tolist()
            i = j
        return out

    def learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        cut = [self.split(t) for t in texts]
        words = self.known.missing([c for c in cut if c is not None])
        other = [k for k, c in enumerate(cut) if c is None]
        self.known.update(zip(words, self.by_call(words), strict=True))
        n = self.known
        self.chunks.update([(x, n[c[0]] if len(c) == 1 else sum([n[w] for w in c])) for x, c in zip(chunks, cut, strict=True) if c is not None])
        self.chunks.update((chunks[k], n) for k, n in zip(other, self.by_call([texts[k] for k in other]), strict=True))

    def count(self, texts: list[bytes]) -> list[int]:
        cut = [chunks_of(t) for t in texts]
        if new := self.chunks.missing(cut):
            self.learn(new)
        return [sum(map(self.chunks.__getitem__, x)) for x in cut]


def count_batch(path: str, texts: list[bytes], by_chunk: bool) -> list[int]:
    if by_chunk:
        memory = worker_memory("tokens")
        if path not in memory:
            memory[path] = ChunkCounter(path)
        return memory[path].count(texts)
    tokenizer = library(path)
    whole = [t.decode() for t in texts]
    if path.endswith(".model"):
        return [len(x) for x in tokenizer.encode(whole, num_threads=1)]
    return [len(x) for x in tokenizer.encode_batch_fast(whole, add_special_tokens=False)]


def count_tokens(docs: DataFrame, path: str, *, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``cache`` is the path of the cache table; it is made if absent and grows by
    this run's distinct misses.  Without it the run has a cache of its own in
    the shared folder.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    cache = cache or f"{scratch.base}/cache"
    version, by_chunk = tokenizer_digest(path), drops_white_space(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), content_digest(F.col(text_col), by_chunk).alias("content"))
    known = scratch.write(rows, "digests")

    def stored() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    firsts = known.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    if path_exists(spark, cache):
        firsts = firsts.join(stored(), "content", "left_anti")
    # One plan at every size: texts meet the chosen ids by a sort-merge join.
    chosen = firsts.select(F.col("doc_id").alias("chosen")).distinct().hint("merge")

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.num_rows, 256):
                part = batch.slice(i, j - i)
                got = count_batch(path, as_texts(part.column(1)), by_chunk)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.int64())], ["content", "n_tokens"])

    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen")), "left_semi")
    misses = texts.select(content_digest(F.col("text"), by_chunk).alias("content"), "text").mapInArrow(run, "content binary, n_tokens bigint")
    misses = misses.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # rows may repeat an id
    scratch.append(misses.select(F.lit(version).alias("tokenizer"), "content", "n_tokens"), cache)
    return known.join(stored(), "content", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
