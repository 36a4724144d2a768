"""Buckets of line_dedup against a plain count, whole and with little room in a task."""

import random

import pyarrow as pa
import pytest

from skein.llm import line_dedup


def some_lines(seed=3):
    rng = random.Random(seed)
    rows = []
    for node in range(600):
        node = node - 300 if node % 2 else node << 50
        bands = [rng.choice([rng.randrange(-(1 << 63), 1 << 63), 77 + band, (rng.randrange(40) << 58) - (1 << 62)]) for band in range(line_dedup.BANDS)]
        rows += [(node, 10 + node % 7, bands)] * rng.choice((1, 1, 3))  # several tasks write the bands of one line
    rng.shuffle(rows)
    return rows


def plain_buckets(rows):
    buckets = {}
    for node, size, bands in rows:
        for key in bands:
            buckets.setdefault(key, set()).add((node, size))
    return {(key, *x) for key, found in buckets.items() if len(found) > 1 for x in found}


@pytest.mark.parametrize(("held", "part"), [(1 << 20, 1 << 17), (50, 1 << 17), (50, 1)])
def test_packed_buckets_are_those_of_a_plain_count(monkeypatch, held, part):
    monkeypatch.setattr(line_dedup, "HELD", held)
    rows = some_lines()
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["node", "size", "bands"])
    parts = max(3, len(rows) * line_dedup.BANDS // part)
    packed = pa.Table.from_batches(list(line_dedup._deal(parts)(iter(table.to_batches(max_chunksize=37))))).sort_by("part")
    found = [tuple(r.values()) for b in line_dedup._several(iter(packed.to_batches(max_chunksize=5))) for r in b.to_pylist()]
    assert set(found) == plain_buckets(rows)
    if held > len(rows) * line_dedup.BANDS:
        assert len(found) == len(set(found))


def test_bands_cross_the_shuffle_packed(spark):
    rows = some_lines(4) + [(1, 5, [])]
    bands = spark.createDataFrame(rows, "node long, size int, bands array<long>").repartition(5)
    shared = line_dedup._shared_buckets(bands, len(rows))
    assert {tuple(r) for r in shared.collect()} == plain_buckets(rows)
    assert "Generate" not in shared._jdf.queryExecution().executedPlan().toString()  # no row for each band of each line
    assert line_dedup._shared_buckets(bands.limit(0), 0).count() == 0
