"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Seeds are word 3-grams of the test items, all of whose words occur in the corpus.  Rare ones are all seeds: their expected number by
chance, from the corpus counts of their words over all documents, is small.  (Counts of the 3-grams themselves would make a
leaked item's own seeds look frequent.)  In every stretch of SPAN places of an item the FEW rarest are seeds as well, so
that a partial copy holds some, wherever it lies.  A document's hits of one item's seeds make runs; a run with a rare seed, or
with two different ones, is aligned with the item, word by word, which tolerates replaced, added and missing words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Batches, arrow_map, keep, slices

N, RARE, SPAN, FEW = 3, 1e-8, 6, 2
#: Least alignment score against that of the item with itself; matching words that are enough for an item of any length.
THRESHOLD, LONG = 0.5, 50
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items (in bytes of text) up to which their words and seeds are sent to every task; beyond, documents' 3-grams are joined in a shuffle.
BROADCAST_BYTES = 4 << 20
#: Parts that a seed's hits are dealt out in there.
SALTS = 16

# Scripts that are written without spaces (Thai to Khmer, kana, Han): each letter is a word.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORDS = re.compile(rf"[^\W{_DENSE}]+|(?=\w)[{_DENSE}]").findall
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def word_hash(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode(), 7) | 1  # never 0, which stands for a word that no item has


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        return self.setdefault(word, word_hash(word))


def seeds_of(hashes: np.ndarray) -> np.ndarray:
    """A hash of each N words in a row; 0 where a word's hash is 0."""
    if len(hashes) < N:
        return np.empty(0, np.uint64)
    h = hashes[: len(hashes) - N + 1].copy()
    real = h != 0
    for k in range(1, N):
        more = hashes[k : len(hashes) - N + 1 + k]
        real &= more != 0
        h = (h ^ (h >> np.uint64(29))) * _A + more * _B
    return np.where(real, h | np.uint64(1), np.uint64(0))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (Smith-Waterman, linear gaps): score and the passage's words from start to before end.

    Of equal scores the least end counts, then the latest start.  Only two rows are held: a cell is its score, and below
    it the start of its alignment, so one maximum keeps both.
    """
    one = 1 << 32
    fresh = np.arange(len(passage) + 1)
    steps = fresh * (-GAP * one)
    before, best = fresh.copy(), (0, 0, 0)
    for word in item:
        here = np.maximum(fresh, before + GAP * one)
        here[1:] = np.maximum(here[1:], before[:-1] + np.where(passage == word, MATCH * one, MISMATCH * one))
        before = np.maximum.accumulate(here + steps) - steps  # gaps along the passage
        score = int(before.max() >> 32)
        if score >= max(best[0], 1):
            end = int(np.argmax(before >> 32 == score))
            best = max(best, (score, -end, int(before[end] & (one - 1))))
    return best[0], best[2], -best[1]


def align_hits(words: np.ndarray, item: np.ndarray, places: np.ndarray, grams: np.ndarray, rare: np.ndarray, seeds: int, threshold: float) -> Iterator[tuple[float, int, int]]:
    """(score, start, end) of the alignments that count, one for each run of hits (sorted places) of the item's seeds in a document."""
    reach = len(item) + len(item) // 2
    for run in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) > reach) + 1):
        if rare[run].any() or len(np.unique(grams[run])) >= min(2, seeds):
            start = max(0, int(places[run[0]]) - reach)
            score, first, end = align(item, words[start : int(places[run[-1]]) + N + reach])
            if score >= MATCH * min(threshold * len(item), LONG):
                yield score / (MATCH * len(item)), start + first, start + end


def _item_words(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, words array<string>) of the items with N words or more; shorter ones have no seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words_of(x.as_py()) for x in batch.column(1)], pa.list_(pa.string()))], ["item_id", "words"])

    chosen = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).distinct()
    return arrow_map(chosen, run, "item_id long, words array<string>").where(F.size("words") >= N)


def _word_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(word long, n long): how often the items' words (a broadcast of word -> hash; all words if None) stand in all documents; word 0: all others."""

    def known(batches: Batches) -> Batches:
        place = {w: i for i, w in enumerate(vocabulary.value, 1)}
        counts = np.zeros(len(place) + 1, np.int64)
        for batch in batches:
            for text in batch.column(1):
                words = words_of(text.as_py())
                counts += np.bincount(np.fromiter(map(place.get, words, repeat(0)), np.int64, len(words)), minlength=len(counts))
        hashes = np.array([0, *vocabulary.value.values()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts)], ["word", "n"])

    def every(batches: Batches) -> Batches:
        hashes = _Hashes()
        for batch in batches:
            for part in slices(batch):
                flat = [h for text in part.column(1) for h in map(hashes.__getitem__, words_of(text.as_py()))]
                word, n = np.unique(np.array(flat, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    return arrow_map(docs, every if vocabulary is None else known, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _seeds(hashed: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, seed, rare, seeds): the items' seeds and how many each has."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0] or 1
    # Expected share of places where the 3-gram stands by chance: the product of its words' shares.
    grams = hashed.select("item", "item_words", F.posexplode("seeds").alias("place", "seed"))
    each = grams.select("item", "seed", F.posexplode(F.expr(f"slice(item_words, place + 1, {N})")).alias("k", "word"), "place")
    shares = counts.where("n > 0").select("word", F.log((F.col("n") + 1) / F.lit(float(total + 1))).alias("share"))
    chance = each.join(shares, "word").groupBy("item", "place", "seed").agg(F.sum("share").alias("chance"), F.count(F.lit(1)).alias("known")).where(F.col("known") == N)
    rank = F.row_number().over(W.partitionBy("item", F.floor(F.col("place") / SPAN)).orderBy("chance", "seed"))
    rare = F.col("chance") <= float(np.log(RARE))
    chosen = chance.withColumn("rare", rare).withColumn("rank", rank).where(F.col("rare") | (F.col("rank") <= FEW))
    chosen = chosen.groupBy("item", "seed").agg(F.max("rare").alias("rare"))
    return chosen.withColumn("seeds", F.count(F.lit(1)).over(W.partitionBy("item")))


@dataclass
class _Index:
    """Seeds in order, and the items of each from starts[i] to before starts[i + 1]."""

    grams: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    rare: np.ndarray
    words: list[np.ndarray]
    ids: list[int | None]
    seeds: np.ndarray
    light: np.ndarray  # whether a seed has these upper 20 bits

    @staticmethod
    def of(hashed: list, chosen: list) -> _Index:
        place = {r.item: i for i, r in enumerate(hashed)}
        grams = np.array([r.seed for r in chosen], np.int64).view(np.uint64)
        order = np.argsort(grams, kind="stable")
        different, starts = np.unique(grams[order], return_index=True)
        seeds, light = np.zeros(len(hashed), np.int64), np.zeros(1 << 20, bool)
        for r in chosen:
            seeds[place[r.item]] = r.seeds
        light[different >> np.uint64(44)] = True
        items = np.array([place[r.item] for r in chosen], np.int64)
        rare = np.array([r.rare for r in chosen], bool)
        return _Index(different, np.append(starts, len(grams)), items[order], rare[order], [np.array(r.item_words, np.int64).view(np.uint64) for r in hashed], [r.item_id for r in hashed], seeds, light)

    def found(self, words: np.ndarray, threshold: float) -> Iterator[tuple[int | None, float, int, int]]:
        grams = seeds_of(words)
        hit = np.flatnonzero(self.light[grams >> np.uint64(44)])
        if not len(hit):
            return
        at = np.searchsorted(self.grams, grams[hit]).clip(max=len(self.grams) - 1)
        real = self.grams[at] == grams[hit]
        hit, at = hit[real], at[real]
        many = self.starts[at + 1] - self.starts[at]
        places = np.repeat(hit, many)
        rows = np.repeat(self.starts[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))  # one for each hit and item
        items = self.items[rows]
        order = np.lexsort((places, items))
        for own in np.split(order, np.flatnonzero(np.diff(items[order])) + 1) if len(order) else []:
            i = int(items[own[0]])
            for score, start, end in align_hits(words, self.words[i], places[own], grams[places[own]], self.rare[rows[own]], int(self.seeds[i]), threshold):
                yield self.ids[i], score, start, end


_KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
_FOUND = "doc_id long, item_id long, score double, start_word long, end_word long"


def _rows(made: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(_KINDS)], ["doc_id", "item_id", "score", "start_word", "end_word"])


def _by_broadcast(docs: DataFrame, hashed: DataFrame, chosen: DataFrame, vocabulary, threshold: float) -> DataFrame:
    """Each document is looked up and aligned where it is read; nothing is shuffled."""
    index = docs.sparkSession.sparkContext.broadcast(_Index.of(hashed.collect(), chosen.collect()))  # bounded by broadcast_bytes

    def run(batches: Batches) -> Batches:
        for batch in batches:
            made = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                known = np.fromiter(map(vocabulary.value.get, words, repeat(0)), np.uint64, len(words))
                made += [(key.as_py(), *x) for x in index.value.found(known, threshold)]
            yield _rows(made)

    return arrow_map(docs, run, _FOUND)


def _by_shuffle(docs: DataFrame, hashed: DataFrame, chosen: DataFrame, threshold: float) -> DataFrame:
    """The documents' 3-grams are joined with the seeds, and each document's hits of an item come back to its text."""

    def grams(batches: Batches) -> Batches:
        hashes = _Hashes()
        for batch in batches:
            for part in slices(batch, 1 << 20):
                found = []
                for text in part.column(2):
                    words = words_of(text.as_py())
                    found.append(seeds_of(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))))
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                taken = pa.array(np.repeat(np.arange(len(found)), sizes))
                places = np.concatenate([np.empty(0, np.int64), *map(np.arange, sizes)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(taken), part.column(1).take(taken), pa.array(places), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["doc_id", "text_key", "place", "seed"])

    def run(batches: Batches) -> Batches:
        hashes = _Hashes()
        for batch in batches:
            made = []
            for key, text, item, item_words, hits, seeds in zip(*batch.columns, strict=True):
                words = words_of(text.as_py())
                place, gram, rare = (hits.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                wanted = item_words.values.to_numpy(zero_copy_only=False).view(np.uint64)
                found = align_hits(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), wanted, place, gram, rare, seeds.as_py(), threshold)
                made += [(key.as_py(), item.as_py(), *x) for x in found]
            yield _rows(made)

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    own = arrow_map(keyed, grams, "doc_id long, text_key long, place long, seed long").withColumn("salt", F.pmod("place", F.lit(SALTS)).cast("int"))
    salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = own.join(salted, ["seed", "salt"]).groupBy("doc_id", "text_key", "item", "seeds").agg(F.array_sort(F.collect_set(F.struct("place", "seed", "rare"))).alias("hits"))  # bounded by the document's own words
    hits = hits.where(F.exists("hits", lambda h: h["rare"]) | (F.size(F.array_distinct("hits.seed")) >= F.least(F.lit(2), "seeds")))
    hits = hits.withColumnsRenamed({"doc_id": "at_id", "text_key": "at_key"}).join(hashed.select("item", "item_id", "item_words"), "item")
    rows = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_key") == F.col("at_key")))
    return arrow_map(rows.select("doc_id", "text", "item_id", "item_words", "hits", "seeds"), run, _FOUND)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): each document with each item that it holds a copy of.

    score is the alignment's score against the item's score with itself, at least `threshold`, or that of LONG matching words; the
    span is that of the best passage, the first among equals.  Null and empty texts match nothing, as do items of under N words
    (letters in scripts without spaces).  Rows with a null doc_id are reported with it; repeated documents or items give one row for
    each pair of ids.  Empty tables give no rows.  Outcomes are the same on either side of broadcast_bytes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = keep(_item_words(items, item_col, item_text_col), "items")
    size = wanted.agg(F.coalesce(F.sum(F.expr("aggregate(words, 0L, (n, w) -> n + length(w) + 1)")), F.lit(0))).first()[0]
    small = size <= broadcast_bytes

    def hash_items(batches: Batches) -> Batches:
        for batch in batches:
            hashed = [np.array([word_hash(w) for w in x.as_py()], np.uint64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.view(np.int64) for h in hashed], pa.list_(pa.int64())), pa.array([seeds_of(h).view(np.int64) for h in hashed], pa.list_(pa.int64()))], ["item_id", "item_words", "seeds"])

    hashed = keep(arrow_map(wanted, hash_items, "item_id long, item_words array<long>, seeds array<long>").withColumn("item", F.monotonically_increasing_id()), "hashed-items")
    vocabulary = None
    if small:
        vocabulary = spark.sparkContext.broadcast({r.word: word_hash(r.word) for r in wanted.select(F.explode("words").alias("word")).distinct().collect()})  # bounded by broadcast_bytes
    counts = keep(_word_counts(docs, vocabulary), "word-counts")
    chosen = keep(_seeds(hashed, counts), "seeds")
    found = _by_broadcast(docs, hashed, chosen, vocabulary, threshold) if small else _by_shuffle(docs, hashed, chosen, threshold)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("start"), (-F.col("end_word")).alias("end"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.score").alias("score"), (-F.col("best.start")).alias("start_word"), (-F.col("best.end")).alias("end_word"))


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, whose texts hold no item.  Rows with a null or repeated id are judged by their texts."""
    key = F.xxhash64(F.col(text_col).cast("string"))
    texts = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    found = keep(contaminated(texts, items, threshold).select(F.col("doc_id").alias("_found")).distinct(), "contaminated")
    return docs.join(found, key == F.col("_found"), "left_anti")
