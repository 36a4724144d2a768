"""Crowded buckets against brute force, recall of the banding, and bounded work for crowds of near copies."""

import random

import numpy as np
import pytest

from skein.llm import line_dedup, near_copies, similar_sets
from tests.llm.test_duplicates import groups_of


def lines_of(kind, n, rng):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    base = " ".join(word() for _ in range(30))
    if kind == "dense":  # all alike
        return sorted({f"{base} {rng.randrange(10**6):07d}" for _ in range(n)})
    if kind == "sparse":  # a common part, none alike
        return sorted({f"{base[:60]} {rng.randrange(10**30):030d}" for _ in range(n)})
    out = {f"{base} {rng.randrange(10**6):07d}" for _ in range(n // 2)}  # a component, others by themselves, and pairs of those
    for _ in range(n // 4):
        alone = f"{base[:60]} {' '.join(word() for _ in range(16))}"
        out |= {alone, f"{alone} {rng.randrange(10)}"}
    return sorted(out)


def links_of(lines, threshold=0.8):
    sets = [set(x.tolist()) for x in line_dedup.shingle_sets(lines)]
    return [(a, b) for a in range(len(lines)) for b in range(a) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]


@pytest.mark.parametrize("kind,most", [("dense", 4_000), ("sparse", 20_000), ("mixed", 4_000), ("mixed", similar_sets.MOST)])
def test_one_bucket(spark, kind, most):
    """Whatever way a bucket is split, the components are those of all pairs in it."""
    lines = lines_of(kind, 160, random.Random(4))
    bodies = spark.createDataFrame([(i, x, len(x) + similar_sets.BASE) for i, x in enumerate(lines)], "node long, body string, weight long")
    shared = spark.createDataFrame([(7, i, sum(map(len, lines)) + similar_sets.BASE * len(lines)) for i in range(len(lines))], "key long, node long, w long")
    found = {r.node: r.root for r in similar_sets.similar_components(shared, bodies, line_dedup._line_sets, 0.8, most).collect()}
    links = links_of(lines)
    assert bool(links) == (kind != "sparse")
    assert found == {n: r for n, r in groups_of(range(len(lines)), links).items() if n != r}


def test_classes_are_not_compared_again():
    bucket = similar_sets.Bucket(0.8)
    same = np.arange(100, dtype=np.uint64)
    assert not bucket.add(1, same, 5) and not bucket.add(2, same, 5) and bucket.add(3, same, 6) == [(3, 1)]
    assert not bucket.add(4, same, 6)


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_crowd_of_variants(spark, kind):
    """6,000 variants of one line in the corpus, six units at least: all go but one, or none goes."""
    lines = lines_of(kind, 6_000, random.Random(1))
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 20])) for i in range(0, len(lines), 20)], "doc_id long, text string").repartition(8)
    dropped = sum(r.n_dropped for r in line_dedup.dedup_lines(docs).select("n_dropped").collect())
    assert dropped == (len(lines) - 1 if kind == "dense" else 0)


@pytest.mark.parametrize("low,high", [(20, 60), (60, 150), (150, 400), (400, 2000)])
def test_recall_of_line_bands(low, high):
    """Of pairs at 0.8 to 0.87, at least 0.98 share a band, by length."""
    rng = random.Random(low)
    letters = "abcdefghijklmnopqrstuvwxyz "
    pairs = []
    while len(pairs) < 400:
        a = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        n = rng.randint(1, max(2, len(a) // 5))
        b = a[: len(a) - n] + "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
        x, y = line_dedup.shingle_sets([a, b])
        if 0.8 <= similar_sets.jaccard(x, y) <= 0.87:
            pairs.append((a, b))
    keys = [line_dedup.band_keys(line_dedup.signatures(list(side), line_dedup.BANDS * line_dedup.ROWS)) for side in zip(*pairs, strict=True)]
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.98


def test_crowd_of_near_documents(spark):
    """Near copies beyond one unit: one document stays of the crowd, and all others stay."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(150):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(base[:120] + [f"y{i}-{j}" for j in range(80)]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (5_000, similar_sets.MOST):
        assert sorted(r.doc_id for r in near_copies.keep_one(docs, most=most).collect()) == [0, *range(150, 210)]
