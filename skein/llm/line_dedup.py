"""Fuzzy line dedup by MinHash.

Lines (A to Z and other letters in lower case, white space as one space, trimmed) that are equal are one line.  Each
different line has a one-permutation MinHash signature over its shingles of 8 characters; bands of the signature are
join keys with a high recall at the threshold; candidates are verified by the exact Jaccard similarity of their shingle
sets; a distributed union-find makes components, and of each component the first line in the corpus stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep, slices
from .similar_sets import BASE, MOST, one_of_equal, similar_components, weight_of

SHINGLE, THRESHOLD = 8, 0.8
#: A pair at the threshold is found with probability 1 - (1 - 0.8**5)**14 = 0.996, one at 0.9 in all but 3 of 10**6 cases.
BANDS, ROWS = 14, 5
#: So many line keys are broadcast at most.
FEW = 1_000_000
#: So many lines a task remembers, to write their bands once; beyond them it starts anew, and results stay the same.
SEEN = 100_000
#: Bucket keys are packed by parts of about PART keys on their way to the task that compares them; a task holds HELD of them.
PART, HELD = 1 << 17, 1 << 20

_M1, _M2, _P = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def _windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the lines one after another, and each line's number of them; short lines are filled up with zeros."""
    filled = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    sizes = np.fromiter(map(len, filled), np.int64, len(filled))
    return np.frombuffer("".join(filled).encode("utf-32-le", "surrogatepass"), np.uint32), sizes


def _rolled(chars: np.ndarray, power: np.unsignedinteger) -> np.ndarray:
    """A polynomial hash of each SHINGLE characters in a row, by doubling: that of 2w characters from those of w."""
    h, width = chars, 1
    with np.errstate(over="ignore"):
        while width < SHINGLE:
            low, h = h[width:], h[:-width] * power if len(h) > width else h[:0]
            if len(h):
                h += low
            power, width = power * power, width * 2
    return h


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of 64 bits of all shingles of the lines, and the number of the line that each is of.

    A line of fewer than SHINGLE characters is filled up with zeros to one shingle.
    """
    chars, sizes = _windows(lines)
    of = np.repeat(np.arange(len(lines), dtype=np.int32), sizes)
    h = _rolled(chars.astype(np.uint64) + np.uint64(1), _P)
    whole = of[: len(h)] == of[SHINGLE - 1 :] if len(h) else np.empty(0, bool)
    return _mix(h[whole]), of[: len(h)][whole]


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each line."""
    h, of = shingle_hashes(lines)
    ends = np.searchsorted(of, np.arange(len(lines)), side="right").tolist()
    out = []
    for start, end in zip([0, *ends], ends, strict=False):
        own = h[start:end]
        own.sort()
        new = own[1:] != own[:-1]
        out.append(own if new.all() else own[np.concatenate([[True], new])])
    return out


def signatures(lines: list[str], bins: int) -> np.ndarray:
    """One-permutation MinHash: the least hash in each bin; an empty bin takes that of the next full one to its right."""
    chars, sizes = _windows(lines)
    h = _rolled(chars, np.uint32(0x9E3779B1))
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    place = np.repeat(np.arange(len(lines)) * bins, sizes)[: len(h)]
    place += (h >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16)
    h *= np.uint32(0x9E3779B1)
    h &= np.uint32(0xFFFFFFFE)
    h[(np.cumsum(sizes)[:-1, None] - np.arange(1, SHINGLE)).ravel()] = 0xFFFFFFFF  # shingles over the end of a line
    least = np.full(len(lines) * bins, 0xFFFFFFFF, np.uint32)
    np.minimum.at(least, place, h)
    least = least.reshape(len(lines), bins)
    empty = least == 0xFFFFFFFF
    at = np.where(np.concatenate([empty, empty], axis=1), 4 * bins, np.arange(2 * bins))
    next_full = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins]
    distance = (next_full - np.arange(bins)).astype(np.uint64)
    taken = np.take_along_axis(least, next_full % bins, axis=1)
    return taken.astype(np.uint64) + distance * np.uint64(0x100000001)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        keys = _mix((keys + signature[:, r::rows][:, :bands]) * _P + np.uint64(r + 1))
    return keys ^ _mix(np.arange(1, bands + 1, dtype=np.uint64) * _P)  # equal parts of different bands don't meet


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) -> (doc_id, text_key, line, size, h1, h2, bands) of every line that isn't blank; a line that the task has met has no bands."""
    from xxhash import xxh3_128_digest

    seen: set[bytes] = set()
    for batch in batches:
        for part in slices(batch, 1 << 18):
            docs, at, sizes, digests, ends, fresh = [], [], [], [], [0], []
            for i, text in enumerate(part.column(2)):
                for n, line in enumerate((text.as_py() or "").lower().split("\n")):
                    if line := " ".join(line.split()):  # normal(), with one lower() for all lines of the text
                        docs.append(i)
                        at.append(n)
                        sizes.append(len(line))
                        digests.append(digest := xxh3_128_digest(line.encode()))
                        if digest not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(digest)
                            fresh.append(line)
                        ends.append(len(fresh) * BANDS)
            hashed = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            keys = band_keys(signatures(fresh, BANDS * ROWS))
            taken = pa.array(docs, pa.int64())
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(taken), part.column(1).take(taken), pa.array(at, pa.int32()), pa.array(sizes, pa.int32()), pa.array(hashed[:, 0].copy()), pa.array(hashed[:, 1].copy()), flat], ["doc_id", "text_key", "line", "size", "h1", "h2", "bands"])


def _deal(parts: int):
    """Over (node, size, bands) rows: (part, keys, nodes, sizes), the bands of many lines by parts of the key, packed; lines without bands give nothing."""

    def dealt(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        part = ((columns[0].view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.min_scalar_type(parts))
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=parts)
        full = np.flatnonzero(counts)
        ends = np.concatenate([[0], np.cumsum(counts[full])])
        packed = [pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x[order])]) for x in columns]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *packed], ["part", "keys", "nodes", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            each = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            keys = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            held.append((keys, *(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), each) for i in (0, 1))))
            n += len(keys)
            if n >= HELD:
                yield dealt(held)
                held, n = [], 0
        if n:
            yield dealt(held)

    return run


def _met(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the different (key, node) pairs whose key has several nodes, and one place for each key."""
    order = np.argsort(keys)
    again = keys[order[1:]] == keys[order[:-1]]
    run = np.concatenate([again, [False]]) | np.concatenate([[False], again])
    alone, order = order[~run], order[run]
    order = order[np.lexsort((nodes[order], keys[order]))]
    first = np.ones(len(order), bool)
    first[1:] = keys[order[1:]] != keys[order[:-1]]
    new = first.copy()
    new[1:] |= nodes[order[1:]] != nodes[order[:-1]]
    order, first = order[new], first[new]
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(order)))
    return order[np.repeat(counts > 1, counts)], np.concatenate([alone, order[starts]])


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows of _deal that come sorted by part: (key, node, size) of the buckets with several different lines, some of them repeatedly.

    Of a part with more than HELD keys one line for each key is held on: every other line of its bucket meets that one.
    """
    part, held, n, room = None, [], 0, HELD

    def met() -> tuple[pa.RecordBatch, list[tuple[np.ndarray, ...]]]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        out, rest = _met(*columns[:2])
        return pa.RecordBatch.from_arrays([pa.array(x[out]) for x in columns], ["key", "node", "size"]), [tuple(x[rest] for x in columns)]

    for batch in batches:
        for p, *packed in zip(*batch.columns, strict=True):
            if p.as_py() != part:
                if held:
                    yield met()[0]
                part, held, n, room = p.as_py(), [], 0, HELD
            held.append(tuple(np.frombuffer(x.as_buffer(), t) for x, t in zip(packed, (np.int64, np.int64, np.int32), strict=True)))
            n += len(held[-1][0])
            if n > room:
                found, held = met()
                yield found
                n = len(held[0][0])
                room = max(room, 2 * n)  # so each key is looked at a few times only
    if held:
        yield met()[0]


def _shared_buckets(bands: DataFrame, lines: int) -> DataFrame:
    """(key, node, size) of the buckets that several different lines of (node, size, bands) share; lines: about how many rows there are."""
    parts = max(1024, lines * BANDS // PART)
    packed = arrow_map(bands, _deal(parts), "part long, keys binary, nodes binary, sizes binary")
    return arrow_map(packed.repartition("part").sortWithinPartitions("part"), _several, "key long, node long, size int").distinct()


def _lines_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, at array<struct<line, node>>) -> (node, the line as it is compared)."""
    for batch in batches:
        for part in slices(batch):
            nodes, texts = [], []
            for text, at in zip(part.column(0), part.column(1), strict=True):
                lines = text.as_py().split("\n")
                for x in at.as_py():
                    nodes.append(x["node"])
                    texts.append(normal(lines[x["line"]]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.string())], ["node", "body"])


def _line_sets(lines: pa.Array) -> list[np.ndarray]:
    return shingle_sets(lines.to_pylist())


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), F.col(text_col).cast("string").alias("text"))


def _names(different: DataFrame) -> F.Column:
    """The name of a line as a long: its first 64 bits, or a hash of all 128 where two different lines share those."""
    clashes = different.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1")
    found = [r.h1 for r in clashes.toLocalIterator()]  # at 10**11 lines some 300
    return F.when(F.col("h1").isin(found), F.xxhash64("h1", "h2")).otherwise(F.col("h1")) if found else F.col("h1")


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, text_key, dropped array<int>, first_doc_ids array<long>): the lines (from 0) of each document that go, and for each the
    document that holds the line that stays for it.  text_key is xxhash64 of the text.

    Blank lines always stay and link nothing.  The line that stays is the one of the least doc_id (null last), then the
    least text_key, then the first.  Rows equal in id and text count as one document.  Documents that lose nothing have no row.
    """
    rows = _with_keys(docs, id_col, text_col)
    signed = keep(arrow_map(rows, _sign, "doc_id long, text_key long, line int, size int, h1 long, h2 long, bands array<long>"), "signatures", **{"parquet.enable.dictionary": "false"})
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line")
    # One row for each different line.
    different = keep(signed.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n")), "different-lines")
    node = _names(different)
    # Buckets of several different lines; a line that occurs often is no such bucket.
    shared = _shared_buckets(signed.where(F.size("bands") > 0).select(node.alias("node"), "size", "bands"), signed.count())
    shared = keep(shared.select("key", "node", weight_of("size").alias("weight")), "line-candidates")
    # Bands mostly gather the same lines: of the buckets with equal members one is enough.
    shared = one_of_equal(shared, "line-buckets")
    # The candidates' texts, each from the place where it stands first.
    nodes = keep(shared.select(F.col("node").alias("hit")).distinct(), "line-nodes")
    few = nodes.count() <= FEW
    # Lines that stand once and in no such bucket neither go nor stay for another.
    touched = different.withColumn("node", node).join(F.broadcast(nodes) if few else nodes, F.col("node") == F.col("hit"), "left")
    touched = keep(touched.where("n > 1 or hit is not null"), "touched-lines")
    wanted = touched.where("hit is not null").select(F.col("place.doc_id").alias("at_id"), F.col("place.text_key").alias("at_key"), F.struct("place.line", "node").alias("at"))
    wanted = keep(wanted.groupBy("at_id", "at_key").agg(F.collect_list("at").alias("at")), "line-places")  # bounded by the document's own lines
    near = F.broadcast(wanted) if few else wanted
    found = rows.join(near, rows["doc_id"].eqNullSafe(near["at_id"]) & (rows["text_key"] == near["at_key"]))
    texts = keep(arrow_map(found.select("text", "at"), _lines_at, "node long, body string").dropDuplicates(["node"]).withColumn("weight", F.length("body") + BASE), "line-texts")
    roots = similar_components(shared, texts, _line_sets, threshold, most)
    placed = touched.join(roots, "node", "left").select("h1", "h2", "place", "n", F.coalesce("root", "node").alias("root"))
    best = placed.groupBy("root").agg(F.min("place").alias("stays"), F.sum("n").alias("all")).where("all > 1")
    decided = placed.join(best, "root").select("h1", "h2", "stays")
    gone = signed.select("doc_id", "text_key", "line", "h1", "h2").join(decided, ["h1", "h2"])
    gone = gone.where(~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_key") == F.col("stays.text_key")) & (F.col("line") == F.col("stays.line"))))
    lists = gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("line", F.col("stays.doc_id").alias("first")))).alias("gone"))  # bounded by the document's own lines
    return lists.select("doc_id", "text_key", F.col("gone.line").alias("dropped"), F.col("gone.first").alias("first_doc_ids"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """The documents with all their columns, repeated lines taken out of the text; adds n_lines, n_dropped, dropped, first_doc_ids.

    Texts without repeated lines stay as they are, null stays null; a text that loses every line becomes empty, its row
    stays.  Columns of the input with the names of added ones are replaced.  See repeated_lines for ties and repeats.
    """
    gone = keep(repeated_lines(docs, threshold, id_col, text_col, most), "repeated-lines").select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"), F.col("dropped").alias("_dropped"), F.col("first_doc_ids").alias("_first"))
    text = F.col(text_col).cast("string")
    size = gone.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("_dropped")), F.lit(0))).first()[0]
    if size <= FEW:
        gone = F.broadcast(gone)
    joined = docs.withColumn("_lines", F.split(text, "\n", -1)).join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text) == F.col("_gone_key")), "left")
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _dropped), i -> element_at(_lines, i + 1)), '\\n')")
    new = F.when(F.col("_dropped").isNull(), text).otherwise(kept)
    added = {text_col: new, "n_lines": F.when(text.isNull(), 0).otherwise(F.size("_lines")), "n_dropped": F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")), "dropped": F.coalesce("_dropped", F.array().cast("array<int>")), "first_doc_ids": F.coalesce("_first", F.array().cast("array<long>"))}
    return joined.withColumns(added).drop("_lines", "_gone_id", "_gone_key", "_dropped", "_first")
