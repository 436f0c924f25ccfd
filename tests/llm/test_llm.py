"""Training-data operators against brute force, with the awkward cases: nulls, empty and very long texts, ties,
repeated rows, empty tables, extra columns."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.llm import bpe, chat, exact_dedup, fingerprint, langid, line_dedup, mixing, near_dedup, tokens, toxicity
from isohyet.llm._common import Scratch
from isohyet.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, digest string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    words = ["rain", "Sun", "wörld", "snow's", "fog", "<|endoftext|>", "T̈x", "haze", "12", "mist,"]
    make = lambda n: " ".join(rnd.choice(words) + rnd.choice("abcd") for _ in range(n))
    base = [make(n) for n in (1, 3, 5, 40, 60, 90)] + [make(30000)]
    out = [(0, None), (1, ""), (2, " \t\n "), (3, base[3]), (4, base[3].replace(" ", "\n")), (5, base[3])]
    out += [(6 + i, b) for i, b in enumerate(base)]
    out += [(20 + i, " ".join([*b.split()[: len(b.split()) // 2], "changed", *b.split()[len(b.split()) // 2 :]])) for i, b in enumerate(base)]
    out.append(out[-1])
    return [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, 1, "x") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def library():
    return tokens.library(vocabulary())


def test_token_counts_and_cache(spark, rows, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    want = {r[0]: len(library().encode(r[1] or "", add_special_tokens=False)) for r in rows}
    got = tokens.count_tokens(docs, vocabulary(), cache=cache).collect()
    assert len(got) == len(rows)
    assert all(r.n_tokens == want[r.doc_id] and r.over_limit == (want[r.doc_id] > 2048) for r in got)
    stored = spark.read.parquet(cache).count()
    assert stored == len({re.sub(r"[ \t\n\x0b\f\r]+", " ", r[1] or "") for r in rows})
    tokens.count_tokens(docs, vocabulary(), cache=cache).count()
    assert spark.read.parquet(cache).count() == stored  # the second run has no misses
    assert tokens.count_tokens(docs.limit(0), vocabulary()).count() == 0


def test_counts_of_other_libraries(docs, rows):
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        lib = tokens.library(vocabulary(name))
        size = (lambda t: len(lib.encode(t))) if name.endswith(".model") else (lambda t: len(lib.encode(t, add_special_tokens=False)))  # noqa: B023
        got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs.where("doc_id < 12"), vocabulary(name)).collect()}
        assert got == {r[0]: size(r[1] or "") for r in rows if r[0] < 12}


def test_bpe_equals_the_library(docs, rows):
    rnd = random.Random(1)
    letters = "aAbBzZ'sStTéÉßΣςİ中文1٣½ \t\n\x1c\x85́̈😀<|>/w.-,!ﬁΩ"
    fuzz = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["ha" * 3000, "a" * 500, "<|endoftext|>x<|ENDOFTEXT|>"]
    for (n, ids, decoded), text in zip(bpe.encode_batch(vocabulary(), [t.encode() for t in fuzz]), fuzz, strict=True):
        want = library().encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), library().decode(want, skip_special_tokens=False)), text
    assert tokens.count_batch(vocabulary(), [t.encode() for t in fuzz], True) == [len(library().encode(t, add_special_tokens=False).ids) for t in fuzz]
    got = {r.doc_id: r for r in bpe.encode_documents(docs, vocabulary(), full=False).collect()}
    for r in rows:
        want = " ".join(map(str, library().encode(r[1] or "", add_special_tokens=False).ids))
        assert got[r[0]].ids_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), vocabulary()).count() == 0


def test_other_files_are_refused(tmp_path):
    with open(vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"][0]["type"] = "NFKC"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="NFC"):
        bpe.WordBpe(str(other))


def test_speculation_agrees_with_exact_merging():
    model = bpe.load(vocabulary())
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abehtinorsl") for _ in range(rnd.randint(1, 25))) + bpe.END for _ in range(3000)]
    assert model.encode_words(words) == [model.merge(w) for w in words]
    long = "".join(rnd.choice("thean") for _ in range(400)) + bpe.END
    assert model.merge(long) == model.encode_words([long])[0]


def best(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0]))
    return {k: (min(v)[1], len(v)) for k, v in groups.items()}


def test_exact_dedup(docs, rows):
    want = best(rows)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows}
    for r in got:
        t = text[r.doc_id]
        assert (r.keep_id, r.group_size) == want[t] and r.kept == (r.doc_id == r.keep_id) and r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    new = exact_dedup.exact_dedup(docs.where("doc_id >= 5"), docs.where("doc_id < 5")).collect()
    assert {r.doc_id: r.keep_id for r in new} == {r[0]: want[text[r[0]]][0] for r in rows if r[0] >= 5}
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    for n in (1, 2, 7, 500):
        keys = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        assert sorted(exact_dedup.place(keys, exact_dedup.BUCKETS)[2]) == list(range(n))


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_dedup(docs, rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = min(root[a], root[b])
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id) for r in got)
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_near_copies_around_a_hidden_base(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    rows = [(500, " ".join(base))]
    for i in range(30):  # copies differ from the base in 5 places, from each other in 10
        w = list(base)
        for k in rnd.sample(range(0, 400, 6), 5):
            w[k] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_mixing(docs, rows):
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    by = collections.defaultdict(list)
    for r in plan:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and sum(r.size for r in own) == own[0].source_size
    # Targets by a plain water-filling, source by source in code point order, null last.
    names = sorted((n for n in by if n is not None)) + [None] * (None in by)
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    size = {n: sum(r.size for r in own) for n, own in by.items()}
    fixed: dict = {}
    while True:
        left = 1.5 * sum(size.values()) - sum(fixed.values())
        free = [n for n in names if n not in fixed]
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > 2 * size[n]]
        if not over:
            break
        fixed |= {n: 2.0 * size[n] for n in over}
    for n in names:
        assert by[n][0].target == pytest.approx((fixed | share)[n])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    # Every document comes as its row of the plan says: whole repetitions, and one with its first words.
    want = collections.Counter()
    texts = {r[0]: r[1] for r in rows}
    for r in plan:
        w = WORD.findall(texts[r.doc_id] or "")
        for k in range(-(-r.taken // r.size) if r.size else 0):
            held = min(r.size, r.taken - k * r.size)
            want[r.doc_id, texts[r.doc_id] if held == r.size else " ".join(w[:held])] += 1
    assert collections.Counter((r.doc_id, r.text) for r in mixed.collect()) == want
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.water_fill([100, 10, 1], [1, 1, 1], 111, 2) == [89.0, 20.0, 2.0]


def test_mixing_of_rows_alike(spark):
    """One document a hundred times, so that the end of the rest falls among equal rows; names that clash."""
    rows = [(1, "a b c", "s", 7, 0, 0)] * 100 + [(2, "d e", None, 1, 1, 1), (None, "f g h i", "s", 2, 2, 2), (3, None, "t", 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, taken int, k int")
    plan = mixing.plan(docs, weights=(1, 1, 1), budget_share=1.17).collect()
    mixed = mixing.mix(docs, weights=(1, 1, 1), budget_share=1.17)
    assert mixed.columns == docs.columns and len(plan) == 103
    held = collections.Counter()
    for r in mixed.collect():
        held[r.doc_id] += len(r.text.split())
    for i in (1, 2, None):
        assert held[i] == sum(r.taken for r in plan if r.doc_id == i)
    assert sum(r.taken for r in plan) == pytest.approx(sum(t for t in {r.source: r.target for r in plan}.values()), abs=1.5)


def test_fingerprints(docs, rows):
    rows = [(r[0] * 10**17 - 5 * 10**18, *r[1:]) if r[0] > 3 else r for r in rows if r[0] != 26]  # ids far apart
    docs = docs.sparkSession.createDataFrame(rows, SCHEMA)
    own = sorted({(r[0], r[1] or "") for r in rows})
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(own):
        after = own[(k + 1) % len(own)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        # Five standard errors of 128 bins, whatever the similarity; nothing in common is within the chance of the low bits.
        for found, exact in ((r.near_edited, jac(shingles(t), shingles(edited))), (r.near_next, jac(shingles(t), shingles(after)))):
            assert abs(found - exact) <= 5 * (exact * (1 - exact) / 128) ** 0.5 + 0.03
    assert len({got[i].fingerprint for i, t in own if t == own[-1][1]}) == 1
    assert fingerprint.fingerprints(docs.limit(0)).count() == 0
    assert fingerprint.fingerprints(docs.where("doc_id = 3")).first().near_next == 1.0


def test_next_documents_of_many_groups(spark, monkeypatch):
    """Places among the sampled ids, times groups, are beyond 32 bits, as they are over 6 GB in groups of 256."""
    monkeypatch.setattr(fingerprint, "GROUP", 12)
    n, groups = 200_000, fingerprint.MAX_GROUPS
    assert n // fingerprint.GROUP >= groups and n <= fingerprint.SAMPLE * groups and n * groups > 2**31
    docs = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") * 3 - n).alias("id"), F.col("id").alias("rid"), F.col("id").cast("string").alias("text"))
    bounds = fingerprint.group_bounds(docs.select("id"), Scratch(spark, "bounds")).first().bounds
    assert len(bounds) == groups - 1 and {b - a for a, b in zip([-n, *bounds], [*bounds, 2 * n])} == {36, 39}
    after = F.pmod(F.col("doc_id") + 1, F.lit(n))
    right = (F.col("next_id") == after * 3 - n) & (F.col("next_rid") == after) & (F.col("next_text") == after.cast("string"))
    got = fingerprint.with_next(docs, Scratch(spark, "many")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(right).alias("right")).first()
    assert (got.n, got.ids, got.right) == (n, n, n)


def cleaned(rows):
    ws, first, out = " \t\n\x0b\f\r", {}, {}
    for i, t in sorted(rows):
        for k, raw in enumerate((t or "").split("\n")):
            if line := raw.strip(ws):
                first.setdefault(line, (i, k))

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:j] + b[j + 1 :] == a for j in range(len(b)))

    near = {x for x in first if any(first[y] < first[x] and one_edit(x, y) for y in first)}
    for i, t in rows:
        parts = (t or "").split("\n")
        keep = [raw for k, raw in enumerate(parts) if not raw.strip(ws) or (first[raw.strip(ws)] == (i, k) and raw.strip(ws) not in near)]
        out[i] = (sum(bool(raw.strip(ws)) for raw in parts), sum(bool(raw.strip(ws)) for raw in keep), "\n".join(keep))
    return out


def test_line_dedup(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcé d") for _ in range(n)).strip() + "z" for n in (20, 21, 63, 64, 65, 66, 127, 128, 129, 130, 200, 1, 2, 5, 15, 16, 17, 700, 5000)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(rnd.randint(0, 4)):
            b = rnd.choice(base)
            j, kind = rnd.randrange(len(b)), rnd.random()
            b = b[:j] + ("x" if kind < 0.6 else "") + b[j + (0 if 0.3 < kind < 0.6 else 1) :] if kind < 0.9 else b
            lines.append(b + rnd.choice(["", " "]))
        rows.append((i, "\n".join(lines) if lines else rnd.choice([None, "", "\n\n"])))
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == cleaned(rows)
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_line_dedup_of_awkward_rows(spark):
    schema = "doc_id bigint, text string, h1 int, line string, first int, gone int, id int, rid int"
    rows = [(2, "a long line of text\nx"), (1, "A long line of text\ny\nword"), (1, "A long line of text\ny\nword"), (3, None), (None, "word\nother one"), (1, "words")]
    found = line_dedup.line_dedup(spark.createDataFrame([(*r, 0, "", 0, 0, 0, 0) for r in rows], schema)).collect()
    got = sorted((r.doc_id or 9, r.n_lines, r.n_kept, r.text) for r in found)
    once = [g for g in got if g[0] == 1 and g[1] == 3]
    assert len(found) == 6 and len(once) == 2 and once[0] == once[1]  # rows alike are one document
    assert once[0][2:] in {(3, "A long line of text\ny\nword"), (2, "A long line of text\ny")}  # the other row 1 may come first
    assert (2, 2, 0, "") in got and (9, 2, 1, "other one") in got


def test_chat_links_order_and_json(spark):
    rows = [
        ("a", 0, "user", "hi \"q\"\n\\ \x01é", None, None, None, None, None),
        ("a", 1, "assistant", None, "k1", None, "add", {"x": "1", "y": "2"}, None),
        ("a", 2, "assistant", None, "k2", None, "add", {"x": "z"}, ["k1"]),
        ("a", 3, "tool", "4", None, "k2", None, None, None),
        ("a", 4, "tool", "3", None, "k1", None, None, None),
        ("a", 5, "tool", "?", None, "k9", None, None, None),
        ("b", 0, "assistant", None, "c1", None, "add", {"x": "1", "y": "1"}, ["c2"]),
        ("b", 1, "assistant", None, "c2", None, "add", {"x": "1", "y": "1"}, ["c1"]),
        ("b", 2, "assistant", "", "c2", None, "none", {}, None),
    ]
    schema = "conv_id string, turn int, role string, text string, call_id string, answers string, name string, arguments map<string,string>, needs array<string>"
    add = chat.Tool("add", {"x": chat.Parameter("[0-9]+"), "y": chat.Parameter("[0-9]+")})
    done = chat.format_chat(spark.createDataFrame(rows, schema), [add])
    got = {(r.conv_id, r.turn): r for r in done.collect()}
    assert [got["a", k].status for k in range(6)] == ["message", "linked", "linked", "linked", "linked", "orphan"]
    assert [got["b", k].status for k in range(3)] == ["cyclic", "cyclic", "repeated"]
    assert got["a", 1].args_valid and not got["a", 2].args_valid and not got["b", 2].args_valid
    for r in got.values():
        assert json.dumps(json.loads(r.json), ensure_ascii=False, sort_keys=True, separators=(",", ":")) == r.json
    whole = {r.conv_id: json.loads(r.json) for r in chat.render(done).collect()}
    order = [m.get("tool_call", {}).get("id") or m.get("tool_call_id") for m in whole["a"]]
    assert order.index("k1") < order.index("k2") and order.count("k1") == 2
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_chat(chat.exchanges(empty), [chat.REPLY]).count() == 0


def labelled(n=900, seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(("an", "re", "the", "ou", "ing", "so")) for _ in range(rnd.randint(1, 4)))
    out = []
    for i in range(n):
        w, bad = [word() for _ in range(rnd.randint(5, 60))], i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(("vileness", "vilest", "scumbag")))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity(spark):
    data = labelled()
    docs = spark.createDataFrame([(i, t, "extra") for i, t, _ in data] + [(9000, None, "e"), (9001, "", "e")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(y, got[i].predicted) for i, _, y in data if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in data)
    assert np.mean([a == b for a, b in held]) > 0.97 and got[9000].predicted == 0 and got[9001].score == got[9000].score
    kept = toxicity.toxicity(docs, labels, keep=True)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got.values())
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_keeps_every_sequence(spark, monkeypatch):
    data = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(9000, None), (9001, "! ?"), (9002, data[0][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id bigint, toxic int")
    want = {r.doc_id: (r.score, r.predicted) for r in toxicity.toxicity(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "MAX_GRAMS", 20)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.toxicity(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[i][0] - want[i][0]) < 1e-6 and got[i][1] == want[i][1] for i in want)
    kept = toxicity.toxicity(docs, labels, keep=True)
    assert kept.columns == docs.columns and kept.count() == sum(not p for _, p in want.values())


def test_toxicity_counts_the_rows_of_the_curve(spark):
    data = labelled()
    of = lambda y, k: next(i for i in range(9100, 9999) if zlib.crc32(str(i).encode()) % 4 == k and i % 2 == y)
    more = [(of(0, 3), "zzyzxq zzyzxq", 1), (of(1, 0), "brrkh", 0)]  # one labelled toxic row of the curve's remainder
    rows = data + more + [(20000, "zzyzxq", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data + more], "doc_id bigint, toxic int")
    model, _, _ = toxicity.train(docs, labels, Scratch(spark, "toxicity-test"))
    assert set(toxicity.grams("zzyzxq")) <= set(model.gram) and model.evidence("zzyzxq")[0] > 0


def test_kneser_ney_sums_to_one():
    model = toxicity.Model
    counts = [(g, 2, 3) for w in ("abc", "abd", "bca") for g in toxicity.grams(w)]
    shared = model._shared({g for g, _, _ in counts})
    letters = {g[-1] for g, _, _ in counts}
    assert abs(sum(shared("a" + x) for x in letters) - 1) < 1e-9


def test_language(spark):
    rnd = random.Random(8)
    parts = {"en": ("the", "ing", "wh", "ed"), "de": ("sch", "ein", "ung", "der"), "fr": ("eau", "que", "ment", "les"), "es": ("ción", "ado", "los", "que")}
    rows = [(i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(2)) for _ in range(30)), lang, None) for i in range(400) for lang in [("en", "de", "fr", "es")[i % 4]]]
    rows += [(900, None, "en", None), (901, "12 34 !", "de", None), (902, "sch einung", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.language_id(docs).collect()}
    held = [(r[2], got[r[0]].lang_pred) for r in rows[:400] if got[r[0]].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "de"
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(docs.limit(0)).count() == 0


def test_registered_chat_query_against_a_plain_version(spark):
    from isohyet.llm import queries

    sf = "/root/testdata/sf0.001"
    talks = collections.defaultdict(dict)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks[r.conv_id].setdefault(r.turn, []).append(r)
    want = collections.Counter()
    for conv, turns in talks.items():
        users = {t for t, rows in turns.items() if any(r.role == "user" for r in rows)}
        # Kahn's algorithm: a call is settled once the call it needs is.
        needs = {t: [t - 2] if t - 2 in users else [] for t in users}
        level, waiting = {}, set(users)
        while waiting:
            ready = {t for t in waiting if all(n in level for n in needs[t])}
            level |= {t: max([level[n] + 1 for n in needs[t]], default=0) for t in ready}
            waiting -= ready
        for t, rows in turns.items():
            for r in rows:
                body, status, place, lev, after, ok = {"role": r.role, "content": r.text}, "message", t, 0, False, None
                if r.role == "user":
                    answered = any(x.role == "assistant" for x in turns.get(t + 1, []))
                    args = {"to": r.text or "", "turn": str(t)}
                    body |= {"content": None, "tool_call": {"id": f"c{t}", "name": "reply", "arguments": args}}
                    status, lev, ok = "linked" if answered else "unanswered", level[t], 1 <= len(args["to"]) <= 350
                elif r.role == "assistant":
                    body["tool_call_id"] = f"c{t - 1}"
                    status, lev, place, after = ("linked", level[t - 1], t - 1, True) if t - 1 in users else ("orphan", 0, t, False)
                want[conv, t, r.role, lev, place, after, status, ok, json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)] += 1
    got = collections.Counter((r.conv_id, r.turn, r.role, r.level, r.place_turn, r.after_call, r.status, r.args_valid, r.json) for r in queries.op5_chat_format(spark, sf).collect())
    assert got == want
    assert max(k[3] for k in want) >= 2 and any(k[7] is False for k in want)  # levels and refusals do occur


def test_long_chains_and_cycles(spark):
    rows = [("a", f"k{i}", [f"k{i - 1}"] if i else []) for i in range(70)] + [("b", "x", ["y"]), ("b", "y", ["x"]), ("b", "z", ["x"]), ("b", "w", ["gone"])]
    calls = spark.createDataFrame(rows, "conv_id string, call_id string, needs array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(calls, Scratch(spark, "levels")).collect()}
    assert got == {("a", f"k{i}"): i for i in range(70)} | {("b", "w"): 0}
