"""Partial and edited copies of benchmark items, on corpora with and without the items' words, against all alignments."""

import random

import pytest

from skein.llm import decontaminate
from tests.llm.test_learned import plain_alignment


def corpus(kind, rng, n=60):
    """kind small: hardly any word of an item stands elsewhere; common: items of the corpus's 30 commonest words."""
    rare = [f"{a}{b}" for a in "bcdfgklmnp" for b in "aeiouxyz"] if kind == "common" else [f"w{i}" for i in range(3000)]
    pool = rare[:30] if kind == "common" else rare
    items = [[rng.choice(pool) for _ in range(40)] for _ in range(12)]
    docs = []
    for k in range(n):
        words = [rng.choice(rare) for _ in range(rng.randint(50, 150))]
        if k % 2:
            item = rng.choice(items)
            size = rng.choice((24, 28, 36, 40))
            start = rng.randint(0, 40 - size)
            copy = [rng.choice(rare) if rng.random() < 0.05 else w for w in item[start : start + size]]
            words[20:20] = copy
        docs.append(words)
    return items, docs


@pytest.mark.parametrize("kind", ["small", "common"])
def test_all_copies_are_found(spark, kind):
    items, docs = corpus(kind, random.Random(8))
    t = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    want = {(i, j) for i, d in enumerate(docs) for j, item in enumerate(items) if plain_alignment(item, d) >= 40}
    assert len(want) >= 20
    found = [{tuple(r) for r in decontaminate.contaminated(t, b, broadcast_bytes=n).collect()} for n in (decontaminate.BROADCAST_BYTES, 0)]
    assert found[0] == found[1] and {x[:2] for x in found[0]} == want


def test_long_items_and_dense_scripts(spark):
    rng = random.Random(2)
    item = [f"q{i}" for i in range(300)]
    clause = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(24))
    docs = [(1, "before " + " ".join(item[100:155]) + " after"), (2, " ".join(item[100:140])), (3, f"x。{clause}。y"), (4, clause[:8])]
    t = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item)), (2, clause)], "item_id long, text string")
    for n in (decontaminate.BROADCAST_BYTES, 0):
        found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(t, b, broadcast_bytes=n).collect()}
        assert set(found) == {(1, 1), (3, 2)} and (found[1, 1].start_word, found[1, 1].end_word) == (1, 56) and found[3, 2].score == 1.0
