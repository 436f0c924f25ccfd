"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word.  A sequence of tokens is
the BPE result exactly if every token encodes to itself and no merge crosses
any boundary of two neighbours, so all adjacent pairs of a batch are tested at
once with NumPy; only words with a failing pair go through exact merging.

Cases: a null text is an empty one (no ids, empty decoded text); texts of any
length are encoded whole; repeated rows give repeated results; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import bounded_batches, slices, worker_memory

NEVER = 2**62
#: Stands for the end-of-word mark inside proposals; no byte maps to it.
END = ""
#: Chunks of text (between ASCII white space) whose result a worker remembers, in each of two generations.
REMEMBERED = 150_000
#: The same for words, to their ids.
REMEMBERED_WORDS = 50_000
TEXTS_AT_ONCE = 256


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A BPE with end-of-word marks, read from a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError(f"{path}: only a BPE with an end-of-word suffix and without prefixes is read here")
        self._refuse(path, spec, model)
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.token = [""] * self.size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.byte_of = dict(enumerate(byte_chars()))
        self._merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        mark = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        self.atom = {mark(t): i for t, i in self.vocab.items() if len(mark(t).rstrip(END)) == 1}
        self.greedy = {mark(t): i for t, i in self.vocab.items() if self.sound[i]}
        self.reach: dict[str, int] = {}  # length of the longest token by its first three characters
        for t in self.greedy:
            if len(t) > 2:
                self.reach[t[:3]] = max(self.reach.get(t[:3], 2), len(t))
        self.known = Remembered(REMEMBERED_WORDS)

    def _merges(self, merges: list[tuple[str, str]]) -> None:
        v = self.vocab
        left = np.full(self.size, -1, np.int64)
        right, formed = left.copy(), left.copy()
        a = np.array([v[x] for x, _ in merges], np.int64)
        b = np.array([v[y] for _, y in merges], np.int64)
        made = np.array([v[x + y] for x, y in merges], np.int64)
        rank = np.arange(len(merges))
        first = np.unique(made, return_index=True)[1]
        left[made[first]], right[made[first]], formed[made[first]] = a[first], b[first], rank[first]
        self.left, self.right, self.formed = left, right, formed
        order = np.argsort(a * self.size + b, kind="stable")
        self.pair_key, self.pair_rank = (a * self.size + b)[order], rank[order]
        self.rank_of = {(int(x), int(y)): (int(r), int(m)) for x, y, r, m in zip(a, b, rank, made, strict=True)}
        # A token is sound if it encodes to itself: nothing merges across its own middle before its own merge.
        whole = np.flatnonzero(formed >= 0)
        inside = np.ones(self.size, bool)
        inside[whole] = self.compatible(left[whole], right[whole], formed[whole])
        for i in whole[np.argsort(formed[whole])]:
            inside[i] &= inside[left[i]] and inside[right[i]]
        self.sound = inside
        late = np.maximum(formed[a], formed[b]) >= rank
        if late.any():
            raise ValueError("a merge comes before the merges that form its parts; this vocabulary needs exact merging")

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens side by side: True if no merge before ``until`` crosses their boundary.

        Runs time backwards.  ``x`` is what touches the boundary from the left
        and is used up at ``x_end``, likewise ``y``; of two ranks alike the
        merge further left is first.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_end = np.full(len(x), NEVER) if until is None else until.astype(np.int64).copy()
        y_end = x_end.copy()
        if until is not None:
            y_end -= 1
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        while live.size:
            r = self._rank(x[live], y[live])
            crossed = (r < x_end[live]) & (r <= y_end[live])
            good[live[crossed]] = False
            live = live[~crossed]
            fx, fy = self.formed[x[live]], self.formed[y[live]]
            more = (fx >= 0) | (fy >= 0)
            live, fx, fy = live[more], fx[more], fy[more]
            undo_x = fx > fy
            i, j = live[undo_x], live[~undo_x]
            x_end[i], x[i] = fx[undo_x], self.right[x[i]]
            y_end[j], y[j] = fy[~undo_x], self.left[y[j]]
        return good

    @staticmethod
    def _refuse(path: str, spec: dict, model: dict) -> None:
        """Raises for a file whose steps aren't those that ``pieces`` and ``decode`` take."""
        normal = spec.get("normalizer") or {}
        steps = [(s["type"], s.get("pattern"), s.get("content")) for s in normal.get("normalizers", [normal] if normal else [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = [(p.get("behavior"), p.get("invert")) for p in before if p["type"] == "Split"]
        level = [(p.get("add_prefix_space"), p.get("use_regex", True)) for p in before if p["type"] == "ByteLevel"]
        if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)] or split != [("Removed", True)] or level != [(False, False)] or len(before) != 2:
            raise ValueError(f"{path}: only NFC, white space as one space, lower case, a split that keeps its matches and byte letters are done here")
        if spec.get("decoder") or model.get("dropout") or model.get("ignore_merges") or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(t["content"][:1] != "<" for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only plain special tokens that begin with <, and neither dropout nor a decoder")

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; ``word`` ends in END, which never stands alone."""
        out, i, n, get, reach = [], 0, len(word), self.greedy.get, self.reach.get
        while i < n:
            j = min(n, i + reach(word[i : i + 3], 2))
            while True:
                if j != n - 1 and (t := get(word[i:j])) is not None:
                    break
                j -= 1
            out.append(t)
            i = j
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: always the pair of least rank, of several the leftmost."""
        ids = [self.atom[c] for c in (*word[:-2], word[-2:])]
        if len(ids) > 64:
            return self._merge_long(ids)
        rank_of, none = self.rank_of, (NEVER, -1)
        found = [rank_of.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = rank_of.get((ids[k - 1], ids[k]), none)
            if k < len(found):
                found[k] = rank_of.get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, so that very long words stay cheap."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.rank_of.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank_of[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.rank_of.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words, each mapped to byte characters and ending in END."""
        found = [self.propose(w) for w in words]
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(found)), n)
        inner = owner[1:] == owner[:-1]
        key = (flat[:-1] * self.size + flat[1:])[inner]
        pairs, where = np.unique(key, return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        for k in np.unique(owner[1:][inner][~good[where]]):
            found[k] = self.merge(words[k])
        return found

    def pieces(self, chunk: str) -> list[str | int]:
        """Normalised words of a chunk, and ids of special tokens."""
        if chunk.isascii() and "<" not in chunk:
            s = chunk.lower()
            if s.isalpha():
                return [s]
            return [s[:-1], s[-1]] if s[:-1].isalpha() else self.words(s)
        out: list[str | int] = []
        for k, part in enumerate(self.find_special.split(chunk)) if self.find_special and "<" in chunk else ((0, chunk),):
            if k % 2:
                out.append(self.special[part])
            else:
                s = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [s] if s.isalpha() else self.words(s)
        return out

    def spell(self, word: str) -> str:
        """The byte characters of a word, then END."""
        return (word if word.isascii() and word.isprintable() else "".join([self.byte_of[b] for b in word.encode()])) + END

    def encode_chunks(self, chunks: Iterable[str]) -> list[tuple[str, str]]:
        """For each chunk its ids in decimal and its decoded text, both joined by one space."""
        cut = [self.pieces(c) for c in chunks]
        known = self.known
        if words := known.missing(cut):
            special = [w for w in words if isinstance(w, int)]
            words = [w for w in words if isinstance(w, str)]
            for w, ids in zip([*words, *special], [*self.encode_words([self.spell(w) for w in words]), *([i] for i in special)], strict=True):
                known[w] = (" ".join(map(str, ids)), self.decode(ids))
        return [known[c[0]] if len(c) == 1 else (" ".join([known[w][0] for w in c]), " ".join([known[w][1] for w in c])) for c in cut]

    def encode(self, text: str | None) -> list[int]:
        return [int(t) for ids, _ in self.encode_chunks([c.decode() for c in chunks_of((text or "").encode())]) for t in ids.split()]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.token[i] for i in ids])


def load(path: str) -> WordBpe:
    memory = worker_memory("bpe")
    if path not in memory:
        memory[path] = WordBpe(path)
    return memory[path]


def chunks_of(text: bytes) -> list[bytes]:
    """The parts between ASCII white space; A-Z in lower case, unless a special token's string might arise or a
    combining mark (U+0300 to U+036F) follows, which composes with some letters in one case only."""
    return (text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()).split()


class Remembered(dict):
    """Results by chunk, in two generations: when the younger is full it becomes the elder."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.elder = most, {}

    def missing(self, lists: Iterable[list]) -> list:
        """What occurs in the lists and isn't remembered."""
        if len(self) > self.most:
            self.elder = dict(self)
            self.clear()
        new = set().union(*lists).difference(self)
        if self.elder and (back := new.intersection(self.elder)):
            self.update({c: self.elder[c] for c in back})
            new -= back
        return list(new)


def as_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def encode_batch(path: str, texts: list[bytes]) -> Iterator[tuple[int, str, str]]:
    """For each text: number of ids, the ids in decimal joined by one space, the decoded text."""
    bpe = load(path)
    memory = worker_memory("bpe").setdefault(("chunks", path), Remembered(REMEMBERED))
    cut = [chunks_of(t) for t in texts]
    if new := memory.missing(cut):
        memory.update(zip(new, bpe.encode_chunks([c.decode() for c in new]), strict=True))
    for x in cut:
        found = list(map(memory.__getitem__, x))
        ids, decoded = " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
        if "  " in f" {ids} ":  # a chunk without tokens
            ids, decoded = " ".join(ids.split()), " ".join([t for t in decoded.split(" ") if t])
        yield ids.count(" ") + 1 if ids else 0, ids, decoded


def encode_documents(docs: DataFrame, path: str, *, full: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, and ids (array of int) and decoded (string), or with
    ``full=False`` their SHA-256 digests ids_sha256 and decoded_sha256 in place of the long values."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    ends = "ids array<int>, decoded string" if full else "ids_sha256 string, decoded_sha256 string"

    def run(batches):
        for batch in batches:
            for i, j in slices(batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(i, j - i)
                got = list(encode_batch(path, as_texts(part.column(1))))
                if full:
                    ends = [pa.array([list(map(int, g[1].split())) for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())]
                else:
                    ends = [pa.array([hashlib.sha256(g[k].encode()).hexdigest() for g in got], pa.string()) for k in (1, 2)]
                names = ["doc_id", "n_tokens", *(("ids", "decoded") if full else ("ids_sha256", "decoded_sha256"))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.int64()), *ends], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {ends}")
