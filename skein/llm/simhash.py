"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32.  If two fingerprints differ in at most two bits, then some
segment differs in at most one.  So each fingerprint is indexed under its one-wildcard variants (a segment with one bit
masked out: 2 x 32 keys), an equality-join on the keys finds every candidate, and the bits are compared exactly.

Equal fingerprints are collapsed before.  A bucket of the index holds fingerprints that share 31 bits.  Inside a bucket
the links are found in time linear in its size and handed on as a forest, never as all pairs.  Buckets of over `most`
fingerprints are dealt out again by one-wildcard variants of the halves of the other segment; such a bucket shares 46
bits, so it has at most 2**18 different fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, keep, local_forest, slices

MOST = 20_000
#: Buckets (two longs each) that are broadcast at most.
FEW_BUCKETS = 250_000


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the text, A-Z in lower case; words are split at ASCII white space only."""
    from xxhash import xxh64_intdigest as digest

    found = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([digest(b" ".join(found), 42)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1]
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id long, text_key long, fp long): one row per input row, repeats included; null or wordless text has fingerprint zero.

    text_key is xxhash64 of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            at = 0
            for part in slices(batch):
                for x in part.column(2):
                    if len(h := shingle_hashes(x.as_py(), words)):
                        out[at] = fingerprint_of(h)
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], ["doc_id", "text_key", "fp"])

    text = F.col(text_col).cast("string")
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")), run, "doc_id long, text_key long, fp long")


def segment_keys(fp: str = "fp") -> F.Column:
    """The 64 one-wildcard keys: number of the segment and masked bit above the 32 bits of the masked segment."""
    return F.expr(f"transform(sequence(0L, 63L), k -> shiftleft(k, 32) | ((case when k < 32 then {fp} & 4294967295L else shiftrightunsigned({fp}, 32) end) & ~shiftleft(1L, cast(k % 32 as int))))")


def finer_keys(key: str = "key", fp: str = "fp") -> F.Column:
    """For a crowded bucket: 32 one-wildcard keys over the halves of the other segment, below the bucket's own key."""
    other = f"(case when shiftright({key}, 32) < 32 then shiftrightunsigned({fp}, 32) else {fp} & 4294967295L end)"
    half = f"(case when j < 16 then {other} & 65535L else shiftright({other}, 16) end)"
    return F.expr(f"transform(sequence(0L, 31L), j -> shiftleft({key}, 21) | shiftleft(j, 16) | ({half} & ~shiftleft(1L, cast(j % 16 as int))))")


def _near(fps: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among different fingerprints of one bucket, reduced to a forest."""
    u = fps.view(np.uint64)
    if len(u) <= 600:
        i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= differ, 1))
        return local_forest(fps[i], fps[j])
    order = np.argsort(u)
    u, fps = u[order], fps[order]
    free = int(np.bitwise_or.reduce(u ^ u[0]))  # only bits that vary in the bucket can differ
    bits = [1 << b for b in range(64) if free >> b & 1]
    probes = bits + [a | b for n, a in enumerate(bits) for b in bits[:n]] if differ > 1 else bits
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for probe in probes:
        want = u ^ np.uint64(probe)
        at = np.minimum(np.searchsorted(u, want), len(u) - 1)
        hit = u[at] == want
        a, b = np.concatenate([a, fps[hit]]), np.concatenate([b, fps[at[hit]]])
        if len(a) > 1 << 20:
            a, b = local_forest(a, b)
    return local_forest(a, b)


def _links_of_sorted(differ: int):
    """Over (key, fp) rows that come sorted by key: a forest of links for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            size = np.diff(np.concatenate([cut, [len(key)]]))
            two = cut[size == 2]
            x, y = fp[two], fp[np.minimum(two + 1, max(len(fp) - 1, 0))]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= differ
            found = [(np.maximum(x[near], y[near]), np.minimum(x[near], y[near]))]
            found += [_near(fp[i : i + n], differ) for i, n in zip(cut[size > 2], size[size > 2], strict=True)]
            a, b = (np.concatenate(z) for z in zip(*found, strict=True))
            a, b = local_forest(a, b)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(key) and key[0] != key[-1]:
                whole = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
                yield out(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        yield out(key, fp)

    return run


def link_fingerprints(different: DataFrame, differ: int = 2, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, no repeats) at `differ` (2 at most) or fewer bits."""
    if not 1 <= differ <= 2:
        raise ValueError("two segments with one wildcard each hold for one or two differing bits")
    keys = different.select(F.explode(segment_keys()).alias("key"), "fp")
    full = keep(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    small = full.count() <= FEW_BUCKETS  # then the keys are filtered where they are made; else both sides are dealt out by key
    shared = keys.join(F.broadcast(full) if small else full, "key")
    fine = shared.where(F.col("n") > most).select(F.explode(finer_keys()).alias("key"), "fp")
    coarse = shared.where(F.col("n") <= most).select("key", "fp")
    found = None
    for part in (coarse, fine):
        made = arrow_map(part.repartition("key").sortWithinPartitions("key"), _links_of_sorted(differ), "a long, b long")
        found = made if found is None else found.union(made)
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, differ: int = 2, most: int = MOST) -> DataFrame:
    """(doc_id, fp long, component_id): documents whose fingerprints are linked, directly or through others.

    component_id is the smallest doc_id reachable, the document's own included.  Null and empty texts have fingerprint
    zero and are linked like any other.  A null doc_id keeps its row and never is a component_id, unless its component
    has no other; then component_id is null.  Repeated rows stay repeated.  An empty table gives no rows.
    """
    known, placed = _groups(docs, id_col, text_col, words, differ, most)
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(best, "root").select("fp", "component_id")
    return known.join(named, "fp").select("doc_id", "fp", "component_id")


def _groups(docs: DataFrame, id_col: str, text_col: str, words: int, differ: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and each fingerprint (fp) with its least doc_id (least) and its component (root)."""
    known = keep(fingerprints(docs, id_col, text_col, words), "fingerprints")
    least = keep(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    roots = components(link_fingerprints(least.select("fp"), differ, most))
    return known, least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, words: int = 3, differ: int = 2, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One document for each group of near copies, with its own columns: the one of the least doc_id.

    Null ids come last.  Among rows that repeat that id, the one of the least xxhash64 of its text stays; of rows that
    repeat both, any one.
    """
    known, placed = _groups(docs, id_col, text_col, words, differ, most)
    return keep_least(docs, known.join(placed.select("fp", "root"), "fp").select("root", "doc_id", "text_key"), id_col, text_col)


def keep_least(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document for each root of rows (root, doc_id, text_key), as keep_one tells; rows has one row for each of docs."""
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("best"))
    tied = rows.join(ids, "root").where(F.col("doc_id").eqNullSafe(F.col("best")))  # null ids only where the group has no other
    stay = tied.groupBy("root").agg(F.min("text_key").alias("text_key"), F.first("best").alias("best"))
    stay = keep(stay.select(F.col("best").alias("_id"), F.col("text_key").alias("_key")), "stay")
    # The rows that go are told by id and text; so are those that stay more than once.
    keys = rows.groupBy(F.col("doc_id").alias("_row_id"), F.col("text_key").alias("_row_key")).agg(F.count(F.lit(1)).alias("_times"))
    same = F.col("_row_id").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key"))
    marked = keep(keys.join(stay.withColumn("_stays", F.lit(True)), same, "left").where("_stays is null or _times > 1").select("_row_id", "_row_key", "_stays"), "marked")
    text = F.col(text_col).cast("string")
    own = F.col(id_col).cast("long").eqNullSafe(F.col("_row_id")) & (F.xxhash64(text) == F.col("_row_key"))
    once = docs.join(marked, own, "left_anti")
    names = [F.col(f"`{n}`") for n in docs.columns]
    repeated = docs.join(marked.where("_stays"), own).dropDuplicates(["_row_id", "_row_key"]).select(*names)
    return once.unionByName(repeated)
