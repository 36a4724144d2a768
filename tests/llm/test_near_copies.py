"""Near copies of the pipeline against all pairs by exact Jaccard similarity."""

import random

import corpus_pipeline
from skein.llm import near_copies
from skein.llm.simhash import fingerprint_of, shingle_hashes
from tests.llm.test_duplicates import groups_of


def edited_texts(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    out = []
    for _ in range(50):
        base = [word() for _ in range(rng.choice((3, 12, 60, 200, 1500)))]
        out.append(base)
        for share in (0.005, 0.01, 0.02, 0.04):
            copy = list(base)
            for _ in range(max(1, int(share * len(base)))):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    return [" ".join(x) for x in out]


def test_stage_finds_edited_copies(spark):
    texts = ["", " \n", *edited_texts()]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    fps = [fingerprint_of(shingle_hashes(t, 5)) if sets[i] else 0 for i, t in enumerate(texts)]
    assert sum((fps[a] ^ fps[b]).bit_count() > 2 for a, b in links) > 30  # out of reach of two bits
    groups = groups_of(range(len(texts)), links)
    found = corpus_pipeline.without_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in found.collect()) == sorted(set(groups.values()))


def test_near_copies_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b  c d e f"), (None, "x y z"), (None, "x y z"), (None, None), (7, ""), (3, "w " * 50_000), (4, "w " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.text[:11]) for r in near_copies.keep_one(docs).collect()), key=str)
    assert found == sorted([(1, "a b c d e f"), (None, "x y z"), (7, ""), (3, "w w w w w w")], key=str)
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_fingerprints_link_copies_by_themselves(spark):
    texts = ["", *edited_texts()]
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    fps = [fingerprint_of(shingle_hashes(t, 5)) if sets[i] else 0 for i, t in enumerate(texts)]
    near = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and sets[b] and (fps[a] ^ fps[b]).bit_count() <= 2]
    links = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(sets[a] != sets[b] for a, b in links) > 5
    groups = groups_of(range(len(texts)), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs, bands=0).collect()) == sorted(set(groups.values()))
