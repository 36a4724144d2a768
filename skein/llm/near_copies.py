"""Near copies by SimHash and, beyond its reach, MinHash over word shingles.

Documents whose SimHash fingerprints the operator of simhash.py links (two bits at most, by one-wildcard segments) are
candidates.  Texts of a Jaccard similarity of 0.8 differ in about 4 to 14 of the 64 bits, too many for such segments
(they would share some 7 bits), so texts that share a band of a MinHash signature are candidates too.  All candidates are
verified by the exact Jaccard similarity of their shingle sets.  Equal sets are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, keep, slices
from .line_dedup import FEW, band_keys
from .similar_sets import BASE, MOST, one_of_equal, similar_components, weight_of
from .simhash import fingerprint_of, keep_least, link_fingerprints, shingle_hashes

THRESHOLD = 0.8
#: A pair at the threshold is found with probability 1 - (1 - 0.8**5)**24 = 0.99993.
BANDS, ROWS = 24, 5

_TURNS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted different shingle hashes of a text."""
    return np.unique(shingle_hashes(text, words))


def signature(own: np.ndarray) -> np.ndarray:
    """MinHash: the least of the set's hashes under each of BANDS x ROWS permutations of the 64-bit numbers."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(own), 1024):
        turned = (own[i : i + 1024] ^ _TURNS[1][:, None]) * _TURNS[0][:, None]
        np.minimum(least, turned.min(axis=1), out=least)
    return least


def _sign(words: int, bands: int):
    """(doc_id, text_key, text) -> (doc_id, text_key, node, size, fp, keys): hash and size of the shingle set, the fingerprint of all shingles and the set's band keys, none of a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for part in slices(batch):
                nodes, sizes, fps, keys, ends = [], [], [], [np.empty(0, np.int64)], [0]
                for text in part.column(2):
                    hashes = shingle_hashes(text.as_py(), words)
                    own = np.unique(hashes)
                    sizes.append(len(own))
                    nodes.append(xxh3_64_intdigest(own.tobytes()))
                    fps.append(fingerprint_of(hashes) if len(own) else 0)
                    signed = bands if len(own) else 0
                    if signed:
                        keys.append(band_keys(signature(own)[None], BANDS, ROWS)[0, :signed].view(np.int64))
                    ends.append(ends[-1] + signed)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
                longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), longs[0], pa.array(sizes, pa.int32()), longs[1], lists], ["doc_id", "text_key", "node", "size", "fp", "keys"])

    return run


def _sets(words: int):
    """(node, text) -> (node, body): the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [shingle_set(x.as_py(), words).view(np.int64) for x in part.column(1)]
                ends = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "body"])

    return run


def _taken(bodies: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy().view(np.uint64).copy() for x in bodies]


def _of_near_fingerprints(signed: DataFrame) -> DataFrame:
    """(key, node, weight): the different sets of each component of linked fingerprints; texts without words have no set."""
    own = keep(signed.where("size > 0").select("fp", "node", weight_of("size").alias("weight")).distinct(), "fingerprints")
    roots = components(link_fingerprints(own.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    return own.join(roots, "fp", "left").select(F.xxhash64(F.coalesce("root", "fp"), F.lit(8)).alias("key"), "node", "weight").distinct()


def keep_one(docs: DataFrame, words: int = 5, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, bands: int = BANDS) -> DataFrame:
    """One document for each group of near copies (linked, directly or through others, by a Jaccard similarity of
    `threshold` or more of their shingle sets), with its own columns: see simhash.keep_least.  Texts without words are one group.

    With bands=0 the candidates are those of the fingerprints alone.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    signed = keep(arrow_map(rows, _sign(words, bands), "doc_id long, text_key long, node long, size int, fp long, keys array<long>"), "minhashes")
    keys = signed.select(F.explode("keys").alias("key"), "node", weight_of("size").alias("weight"))
    full = keep(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key"), "buckets")
    shared = keys.join(F.broadcast(full) if full.count() <= FEW else full, "key").distinct()
    shared = keep(shared.unionByName(_of_near_fingerprints(signed)), "candidates")
    shared = one_of_equal(shared)  # of the buckets with equal members one is enough
    # The candidates' sets, each from one place where it stands.
    nodes = keep(shared.select("node").distinct(), "nodes")
    few = nodes.count() <= FEW
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    places = signed.join(F.broadcast(nodes) if few else nodes, "node").groupBy("node").agg(F.min(place).alias("place"))
    places = keep(places.select("node", F.col("place.doc_id").alias("at_id"), F.col("place.text_key").alias("at_key")), "places")
    found = rows.join(F.broadcast(places) if few else places, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_key")))
    sets = keep(arrow_map(found.select("node", "text"), _sets(words), "node long, body array<long>").distinct().withColumn("weight", F.size("body") + BASE), "sets")  # rows may repeat
    roots = similar_components(shared, sets, _taken, threshold, most)
    placed = signed.select("doc_id", "text_key", "node").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "doc_id", "text_key")
    return keep_least(docs, keep(placed, "placed"), id_col, text_col)
