"""Exact verification of candidate buckets: links that connect all sets of a Jaccard similarity that share a bucket.

A bucket of little weight is one unit of work in one task.  A crowded one (more weight than `most`) is split, so that no
task holds it and no pair of it is lost:

1. Its members are dealt out in parts, each with the same few sampled members.  A member like a sampled one is linked to it,
   which makes one component of a dense crowd in linear work.
2. A bucket of one component is done.  Else the blocks of its heaviest component are compared with all others, if
   these are one unit at most.
3. If they are more, members of different components meet by a prefix filter: with the shingles in the order of how often
   they stand in the sample, rarest first, two sets at the threshold share one of their first |x| - ceil(t |x|) + 1
   shingles.  So sets that have only the common part alike never meet.  A group that is crowded still is compared block
   against block, as in 2, and the others against one another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, arrow_map, components, keep, local_forest, slices

#: Weight of a unit of work; a set weighs its size and BASE more, so there are also at most MOST / BASE sets in a unit.
MOST, BASE = 400_000, 200
#: Sampled members of a crowded bucket.
SAMPLE = 32

Sets = Callable[[pa.Array], list[np.ndarray]]


def weight_of(size: str) -> F.Column:
    return F.col(size).cast("long") + BASE


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; a stable sort of both merges them."""
    merged = np.concatenate([a, b])
    merged.sort(kind="stable")
    both = np.count_nonzero(merged[1:] == merged[:-1])
    return both / max(1, len(merged) - both)


class Bucket:
    """The sets of one unit so far: bit maps of them and components.

    A bit of one map that the other lacks stands for a shingle that the other lacks, so the maps bound every Jaccard
    similarity from above; only sets that the bound lets through are compared exactly, one for each component at best.
    Sets of the same class are known to be in one component.  Maps are made when they are needed first.
    """

    WORDS = 32

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.names: list[int] = []
        self.sets: list[np.ndarray] = []
        self.maps = np.zeros((4, self.WORDS), np.uint64)
        self.mapped = self.parts = 0
        self.sizes = np.zeros(4, np.int64)
        self.group = np.zeros(4, np.int64)
        self.classes: dict[int, int] = {}

    def _alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        return min(len(a), len(b)) >= self.threshold * max(len(a), len(b)) and jaccard(a, b) >= self.threshold

    def _map(self, own: np.ndarray) -> np.ndarray:
        bits = np.zeros(self.WORDS * 64, bool)
        bits[own % np.uint64(self.WORDS * 64)] = True
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def add(self, name: int, own: np.ndarray, known: int | None = None) -> list[tuple[int, int]]:
        """The links of a new set to earlier ones, at most one to each component; known is its class."""
        n = len(self.names)
        if n == len(self.group):
            self.maps, self.sizes, self.group = (np.concatenate([x, np.zeros_like(x)]) for x in (self.maps, self.sizes, self.group))
        self.names.append(name)
        self.sets.append(own)
        self.sizes[n], self.group[n] = len(own), n
        self.parts += 1
        if known is not None and (first := self.classes.setdefault(known, n)) != n:
            self.group[n] = self.group[first]
            self.parts -= 1
        if self.parts == 1:
            return []
        found: list[tuple[int, int]] = []
        if self.parts == 2 and self.group[n] != self.group[0] and self._alike(own, self.sets[0]):
            return self._joined(found, n, 0)
        if n == 1:
            return []
        while self.mapped <= n:
            self.maps[self.mapped] = self._map(self.sets[self.mapped])
            self.mapped += 1
        mine, maps, size, sizes = self.maps[n], self.maps[:n], len(own), self.sizes[:n]
        both = np.minimum(size - np.bitwise_count(mine & ~maps).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(maps & ~mine).sum(axis=1, dtype=np.int64))
        bound = both / (size + sizes - both)
        near = np.flatnonzero((bound >= self.threshold) & (self.group[:n] != self.group[n]))
        near = near[np.argsort(-bound[near], kind="stable")]
        while len(near):
            i = int(near[0])
            if jaccard(own, self.sets[i]) >= self.threshold:
                self._joined(found, n, i)
                near = near[self.group[near] != self.group[n]]
            else:
                near = near[1:]
        return found

    def _joined(self, found: list[tuple[int, int]], n: int, i: int) -> list[tuple[int, int]]:
        found.append((self.names[n], self.names[i]))
        group = self.group[: n + 1]
        group[group == group[i]] = group[n]
        self.parts -= 1
        return found

    def first_alike(self, own: np.ndarray) -> int | None:
        """The name of a set like `own`, the likeliest first, without adding it."""
        while self.mapped < len(self.sets):
            self.maps[self.mapped] = self._map(self.sets[self.mapped])
            self.mapped += 1
        n, mine = len(self.sets), self._map(own)
        maps, sizes = self.maps[:n], self.sizes[:n]
        both = np.minimum(len(own) - np.bitwise_count(mine & ~maps).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(maps & ~mine).sum(axis=1, dtype=np.int64))
        bound = both / np.maximum(len(own) + sizes - both, 1)
        return next((self.names[i] for i in np.argsort(-bound, kind="stable") if bound[i] >= self.threshold and jaccard(own, self.sets[i]) >= self.threshold), None)


def _verify(threshold: float, sets: Sets, keys: int):
    """Over (keys..., node, class or null, body) rows that come sorted by the keys: links that connect all similar sets of each unit."""

    def run(batches: Batches) -> Batches:
        key, bucket = None, Bucket(threshold)
        for batch in batches:
            made: list[tuple[int, int]] = []
            for part in slices(batch, 1 << 18):
                columns = [part.column(i).to_pylist() for i in range(keys + 2)]
                for *k, node, known, own in zip(*columns, sets(part.column(keys + 2)), strict=True):
                    if k != key:
                        key, bucket = k, Bucket(threshold)
                    made += bucket.add(node, own, known)
            a, b = local_forest(np.array([m[0] for m in made], np.int64), np.array([m[1] for m in made], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _profile(threshold: float, sets: Sets):
    """Over (key, part, turn, node, body) rows sorted by key, part and turn (0: the sample): a sampled member like each member, and its prefix."""

    def run(batches: Batches) -> Batches:
        key, seen, shingles, often = None, Bucket(threshold), np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                out: list[tuple] = []
                columns = [part.column(i).to_pylist() for i in range(4)]
                for k, p, turn, node, own in zip(*columns, sets(part.column(4)), strict=True):
                    if (k, p) != key:
                        key, seen, shingles = (k, p), Bucket(2.0), np.empty(0, np.uint64)  # nothing is as like as 2, so the sample is only stored
                    if turn == 0:
                        seen.add(node, own)
                        continue
                    if not len(shingles):
                        shingles, often = np.unique(np.concatenate(seen.sets), return_counts=True)
                        seen.threshold = threshold
                    at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
                    count = np.where(shingles[at] == own, often[at], 0)
                    first = own[np.lexsort((own, count))][: len(own) - int(np.ceil(threshold * len(own) - 1e-9)) + 1]
                    out.append((k, node, seen.first_alike(own), first.view(np.int64)))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["key", "node", "like", "prefix"])

    return run


def one_of_equal(shared: DataFrame, name: str = "buckets") -> DataFrame:
    """(key, node, w) of (key, node, weight) rows: of the buckets of several members with equal members (told by two hashes over
    them) one, with the bucket's weight."""
    members = shared.groupBy("key").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    chosen = members.where("m > 1").groupBy("m", "x", "y").agg(F.min(F.struct("key", "w")).alias("one")).select("one.key", "one.w")
    return keep(shared.select("key", "node").join(chosen, "key"), name)


def _with_blocks(members: DataFrame, by: str, most: int) -> DataFrame:
    """members (by, node, known, weight) of groups of several components, with the group's heaviest component (main) and the numbers
    of blocks of its sets (mains) and of all others."""
    each = members.groupBy(by, "known").agg(F.sum("weight").alias("w"))
    groups = each.groupBy(by).agg(F.max(F.struct("w", "known")).alias("main"), F.sum("w").alias("all"), F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / most).cast("int"))
    return members.join(groups.select(by, F.col("main.known").alias("main"), blocks(F.col("main.w")).alias("mains"), blocks(F.col("all") - F.col("main.w")).alias("others")), by)


def _units(met: DataFrame, by: str, kind: int) -> DataFrame:
    """(id, kind, i, j, node, known): each set of the main component in a unit with each block of others, and each two blocks of others
    in a unit; with one block of others it is whole in the former units."""
    h, is_main = F.xxhash64("node", F.lit(4)), F.col("known") == F.col("main")
    own = F.pmod(h, F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    unit = lambda k, i, j: F.struct(F.lit(k).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda name: F.sequence(F.lit(0), F.col(name) - 1)
    against = F.transform(upto("others"), lambda j: unit(kind, F.col("own"), j))
    others = F.transform(upto("mains"), lambda i: unit(kind, i, F.col("own")))
    among = F.filter(F.transform(upto("others"), lambda j: unit(kind + 1, F.least(j, "own"), F.greatest(j, "own"))), lambda _: F.col("others") > 1)
    chosen = F.when(is_main, against).otherwise(F.concat(others, among))
    return met.withColumn("own", own).select(F.col(by).alias("id"), "node", "known", F.explode(chosen).alias("unit")).select("id", "unit.kind", "unit.i", "unit.j", "node", "known")


def similar_components(shared: DataFrame, bodies: DataFrame, sets: Sets, threshold: float, most: int = MOST) -> DataFrame:
    """(node, root) as components() gives them, of all pairs of sets at the threshold that share a bucket.

    shared: (key, node, w) as of one_of_equal; bodies: (node, body, weight), one row for each node; sets turns a column of bodies into sorted
    sets of unsigned 64-bit shingles, none of them empty.
    """
    null = F.lit(None).cast("long").alias("known")
    small = shared.where(F.col("w") <= most).join(bodies, "node").select("key", "node", null, "body")
    links = arrow_map(small.repartition("key").sortWithinPartitions("key", "node"), _verify(threshold, sets, 1), "a long, b long")
    crowd = shared.where(F.col("w") > most)
    if crowd.isEmpty():
        return components(links)
    crowd = crowd.withColumn("parts", F.ceil(F.col("w") / most).cast("int"))
    slot = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SAMPLE))
    sample = crowd.groupBy("key", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("node", F.lit(2)).alias("h"), "node")).alias("s"), F.first("parts").alias("parts"))
    sample = sample.select("key", F.col("s.node").alias("node"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(0).alias("turn"))
    rows = crowd.select("key", "node", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("turn"))
    dealt = rows.unionByName(sample).join(bodies, "node").select("key", "part", "turn", "node", "body")
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "turn", "node")
    profile = keep(arrow_map(dealt, _profile(threshold, sets), "key long, node long, like long, prefix array<long>"), "profiles")
    roots = components(links.unionByName(profile.where("like <> node").select(F.col("node").alias("a"), F.col("like").alias("b"))))
    members = profile.select("key", "node", "prefix").join(roots, "node", "left").join(bodies.select("node", "weight"), "node")
    members = keep(members.select("key", "node", "prefix", F.coalesce("root", "node").alias("known"), "weight"), "members")
    met = _with_blocks(members, "key", most)  # buckets of one component are done
    few = met.where("others = 1").drop("prefix")
    tokens = met.where("others > 1").select("node", "known", "weight", F.explode(F.transform("prefix", lambda x: F.xxhash64("key", x))).alias("token"))
    units = _units(few, "key", 0).unionByName(_units(_with_blocks(tokens, "token", most), "token", 2))
    dealt = units.join(bodies.select("node", "body"), "node").select("id", "kind", "i", "j", "node", "known", "body")
    dealt = dealt.repartition("id", "kind", "i", "j").sortWithinPartitions("id", "kind", "i", "j", "node")
    more = arrow_map(dealt, _verify(threshold, sets, 4), "a long, b long")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
