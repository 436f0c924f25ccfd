"""The pipeline's stages, each on its own input, against brute force, with the awkward rows."""

import collections
import hashlib
import random
import re

import pytest

import corpus_pipeline
from isohyet.llm import tokens
from isohyet.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, own_id string, row int, near_id string"


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(11)
    make = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    base = [make(n) for n in (3, 30, 60, 200, 5000)]
    near = " ".join([*base[3].split()[:-1], "other"])
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[1].replace(" ", "\n")), (11, base[1] + " "), (12, near), (13, near.upper()), (14, None), (15, " \t"), (16, "")]
    rows += [(17, base[2]), (17, base[2]), (18, make(40)), (18, make(41)), (18, base[3] + " tail"), (None, make(50)), (None, base[4] + " more")]
    return spark.createDataFrame([(i, t, "en", f"s{k % 2}" if k % 7 else None, len(t or ""), "x", 1, "y") for k, (i, t) in enumerate(rows)], SCHEMA).cache()


def pairs(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_copies(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    best = {}
    for i, t in rows:
        rank = (-len(t or ""), i is None, i or 0)
        if strip(t) not in best or rank < best[strip(t)][0]:
            best[strip(t)] = (rank, (i, t))
    got = corpus_pipeline.drop_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((strip(t), len(t or ""), i is None, i or 0) for i, t in pairs(got).elements()) == sorted((k, len(t or ""), i is None, i or 0) for k, (_, (i, t)) in best.items())


def test_near_copies(spark, docs):
    once = corpus_pipeline.drop_copies(spark, docs, "")
    rows = sorted(pairs(once), key=lambda r: (r[0] is None, r[0] or 0))
    group = list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = min(group[a], group[b])
    got = pairs(corpus_pipeline.drop_near_copies(spark, once, ""))
    assert sum(got.values()) == len(set(group)) < len(rows)  # one of each group
    assert {group[rows.index(r)] for r in got} == set(group)
    clear = collections.Counter(i for i, _ in rows)
    for r in got:
        group_rows = [rows[k] for k in range(len(rows)) if group[k] == group[rows.index(r)]]
        if all(i is not None and clear[i] == 1 for i, _ in group_rows):
            assert r == min(group_rows)


def test_toxic_documents_go(spark):
    good, bad = "the quick river runs under old stone bridges".split(), "vile scum rotten filth hateful swine".split()
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(good) for _ in range(40)) + (" " + " ".join(rnd.choice(bad) for _ in range(6)) if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x", 1, "y") for i, t in rows] + [(None, None, None, None, 0, "x", 1, "y")], SCHEMA)
    from isohyet.llm import toxicity

    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    kept = toxicity.toxicity(docs, labels, keep=True)
    scored = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scored.items() if p == 0} and scored[None] == 0
    assert sum(scored[i] == (i % 4 == 0) for i in range(400)) >= 396


def test_encoding(spark, docs):
    lib = tokens.library(vocabulary())
    want = collections.Counter()
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    got = corpus_pipeline.encode(spark, docs, "")
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want


def test_all_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= 600


def test_an_empty_table_passes(spark, docs):
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, "").count() == 0, name
