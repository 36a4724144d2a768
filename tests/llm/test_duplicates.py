"""SimHash near-duplicates, line dedup and union-find against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from skein.llm import common, line_dedup, simhash


def groups_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(500, x) for x in range(501, 560)] + [(7, 7), (-5, 3), (-5, 3)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame([*links, (None, 1), (2, None)], "x long, y long")).collect()}
    want = groups_of({x for link in links for x in link}, links)
    assert found == {n: r for n, r in want.items() if n != r}
    assert common.components(spark.createDataFrame([], "x long, y long")).count() == 0


def plain_fingerprint(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 200, 400)))]
        out.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("most", [simhash.MOST, 1])
def test_near_duplicates(spark, most):
    texts = [None, "", " \t", "ONE two three", "one\xa0two three", "one Two three four"] + near_texts()
    rows = [(i * 3 % 997, t, "x") for i, t in enumerate(texts)] + [(9, texts[3], "x"), (9, texts[3], "x"), (None, texts[3], "x"), (None, "alone with no id at all", "x")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string"), most=most).collect()
    fps = [plain_fingerprint(t, 3) for _, t, _ in rows]
    links = [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 2]
    assert links
    groups = groups_of(set(fps), links)
    least = {}
    for (i, _, _), fp in zip(rows, fps, strict=True):
        if i is not None:
            least[groups[fp]] = min(i, least.get(groups[fp], i))
    want = sorted((str(i), fp, str(least.get(groups[fp]))) for (i, _, _), fp in zip(rows, fps, strict=True))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in found) == want


def test_buckets_link_all_near_pairs(spark):
    """A crowd in one bucket, random near pairs, and the finer keys: the components are those of all pairs."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    crowd = {base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)} | {base ^ (rng.getrandbits(20) << 40) for _ in range(300)}
    pairs = set()
    for _ in range(200):
        x = rng.getrandbits(64)
        pairs |= {x, x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    values = sorted(crowd | pairs)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    table = spark.createDataFrame(signed, "fp long")
    a = np.array(values, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2, 1))
    want = groups_of({s for (s,) in signed}, [(signed[i][0], signed[j][0]) for i, j in near])
    for most in (10, 10**6):
        found = {r.node: r.root for r in common.components(simhash.link_fingerprints(table, most=most)).collect()}
        assert found == {n: r for n, r in want.items() if n != r}


def test_keep_one(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "a b c d e f", 2), (1, "other words in this text", 7), (None, "x y z", 3), (None, "x y z", 4), (None, None, 5), (7, "", 5), (7, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs, words=5).collect()), key=str)
    assert found == sorted([(1, "a b c d e f"), (1, "other words in this text"), (7, ""), (None, "x y z")], key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.keep_one(docs).columns == docs.columns


def plain_lines(rows, threshold=line_dedup.THRESHOLD):
    """(line index of a row, kept) by comparing all lines."""
    shingle = lambda s: {s[i : i + 8] for i in range(len(s) - 7)} or {s}
    places = {}
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if normal := " ".join(line.lower().split()):
                places.setdefault(normal, []).append((i, n))
    lines = list(places)
    sets = [shingle(x) for x in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if min(len(sets[a]), len(sets[b])) >= threshold * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    groups = groups_of(range(len(lines)), links)
    first = {}
    for k, x in enumerate(lines):
        first[groups[k]] = min(first.get(groups[k], (10**9, 0)), min(places[x]))
    return {p for k, x in enumerate(lines) for p in places[x] if p != first[groups[k]]}, len(links)


@pytest.mark.parametrize("most", [line_dedup.MOST, 700])
def test_line_dedup(spark, most):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    lines = [" ".join(word() for _ in range(rng.choice((1, 3, 30)))) for _ in range(60)]
    texts = []
    for _ in range(40):
        some = []
        for line in rng.sample(lines, 5):
            words = line.split()
            if rng.random() < 0.5 and len(words) > 20:
                words[rng.randrange(len(words))] = word()
            some.append(" ".join(words).upper() if rng.random() < 0.2 else "  ".join(words))
        texts.append("\n".join([*some, "", "short"]))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, dropped int")
    found = line_dedup.dedup_lines(docs, most=most).collect()
    gone, near = plain_lines(rows)
    assert near > 10
    assert {(r.doc_id, n) for r in found for n in r.dropped} == gone
    for r in found:
        want = [x for n, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, n) not in gone]
        assert r.text == "\n".join(want) and r.n_lines == len(texts[r.doc_id].split("\n")) and r.n_dropped == len(r.dropped) == len(r.first_doc_ids)


def test_line_dedup_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "the same line of text"), (None, "THE same  line of text"), (5, "the same line of text\nthe same line of text"), (6, "x" * 50_000), (6, "x" * 50_000), (7, "x" * 50_000 + "\nlast")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, (r.text or "-")[:5], r.n_dropped) for r in found), key=str) == sorted([(1, "-", 0), (2, "-", 0), (3, "\n\n", 0), (4, "the s", 0), (None, "-", 1), (5, "-", 2), (6, "xxxxx", 0), (6, "xxxxx", 0), (7, "last", 1)], key=str)
    assert next(r for r in found if r.doc_id == 1).text is None
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_task_writes_the_bands_of_a_line_once(monkeypatch):
    batch = lambda texts: pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text_key": [0] * len(texts), "text": texts})
    rows = lambda *texts: [r for b in line_dedup._sign(iter([batch(x) for x in texts])) for r in b.to_pylist()]
    found = rows(["one line\nanother\none  LINE", None], ["another", "third"])
    assert [(r["doc_id"], r["line"], len(r["bands"])) for r in found] == [(0, 0, 14), (0, 1, 14), (0, 2, 0), (0, 0, 0), (1, 0, 14)]
    assert len({(r["h1"], r["h2"]) for r in found}) == 3 and found[0]["h1"] == found[2]["h1"]
    alone = rows(["another"])[0]
    assert alone["bands"] == found[1]["bands"]
    monkeypatch.setattr(line_dedup, "SEEN", 1)
    assert [len(r["bands"]) for r in rows(["a\nb\na\na"])] == [14, 14, 14, 0]
