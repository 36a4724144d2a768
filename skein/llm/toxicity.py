"""Toxic passages by maximum-scoring segments.

Each word has a log-odds of toxic against clean documents under hierarchical Dirichlet priors: the whole word is
shrunk towards its prefixes of 6, 5, 4 and 3 letters, and those towards the corpus, so unseen forms of a known stem are
scored too.  A document's words, each less a fixed penalty, are scanned once (Ruzzo and Tompa 1999) for all
maximal-scoring segments.  Their scores follow an extreme-value law in clean text (Karlin and Altschul 1990) whose
parameters are fitted on clean labelled documents; the significant segments' excess over it is mapped to a probability
by logistic regression on labelled documents that the weights have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep, slices

#: Documented bound of the labelled rows that the classifier is fitted on, half for weights and half for calibration.
FIT_ROWS = 40_000
PREFIXES = (3, 4, 5, 6)
#: Strength of the prior in tokens, least tokens of a feature, penalty for each word, largest log-odds.
PRIOR, LEAST, PENALTY, MOST = 10.0, 4, 0.5, 8.0
WORDS = 400_000
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&+-_/\\=~`^@…–—«»“”„‘’"


def features(word: str) -> list[str]:
    """From coarse to fine; the longest prefix and the word itself are told apart by an end mark."""
    return [word[:n] for n in PREFIXES if n <= len(word)] + [word + "$"]


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # of the extreme-value law
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = -2.0
    significant: float = 0.05  # greatest expected number of such segments by chance in a clean text of that length

    def word(self, word: str) -> float:
        score = 0.0
        for f in features(word.strip(_EDGES)):
            score = self.odds.get(f, score)
        return score - PENALTY

    def excess(self, score: float, words: int) -> float:
        """Minus the logarithm of the expected number of segments as good by chance."""
        return self.rate * score - self.log_k - log(max(words, 1))

    def evidence(self, scores: list[float], words: int) -> float:
        """Logarithm of the summed excess of the significant segments; 0 without any."""
        return log(1 + sum(e for s in scores if (e := self.excess(s, words)) > -log(self.significant)))

    def probability(self, scores: list[float], words: int) -> float:
        z = self.slope * self.evidence(scores, words) + self.offset
        return 1 / (1 + exp(-z)) if z > -700 else 0.0


class _Scores(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        score = self.model.word(word)
        if len(word) <= 48:
            if len(self) >= WORDS:
                self.clear()
            self[word] = score
        return score


def word_scores(words: list[str], known: _Scores) -> np.ndarray:
    """The words' scores; every occurrence counts alike, so that a passage is judged by its own words wherever it stands."""
    return np.fromiter(map(known.__getitem__, words), np.float64, len(words))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in order, in linear time."""
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    stack: list[list] = []  # start, end, sum before, sum at the end, index of the nearest earlier segment with a lower start
    for at in np.flatnonzero(scores > 0).tolist():
        start, left, right = at, sums[at], sums[at + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([start, at + 1, left, right, j])
                break
            start, left = stack[j][0], stack[j][2]  # joined with segment j and all between
            del stack[j:]
    return [(a, b, float(r - le)) for a, b, le, r, _ in stack]


def passages_of(words: list[str], known: _Scores) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """The maximal segments of all words' scores, and those scores with bursts damped within each segment.

    The k-th occurrence of a positive word in a segment counts a k-th part there, whatever other segments hold.  A
    segment's score is that of its best part so damped, so it is no less than that of its first passage alone.
    """
    scores = word_scores(words, known)
    damped, found = scores.copy(), []
    for start, end, total in maximal_segments(scores):
        before: Counter = Counter()
        repeated = False
        for i in range(start, end):
            if scores[i] > 0:
                before[words[i]] += 1
                if before[words[i]] > 1:
                    damped[i] /= before[words[i]]
                    repeated = True
        if repeated:
            sums = np.concatenate([[0.0], np.cumsum(damped[start:end])])
            total = float((sums[1:] - np.minimum.accumulate(sums[:-1])).max())
        found.append((start, end, total))
    return found, damped


def _labelled(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic, part): at most `rows` labelled documents of the folds 0 and 2, those with the least hashes."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"), F.max(fold).alias("part")).where("part <> 1")
    some = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # `rows` ids at most, so it may be broadcast
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "id").select("text", F.col("toxic").cast("int"), F.col("part").cast("int"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each feature in clean and toxic texts (a word once a text), summed within a task as far as memory allows."""
    seen = (Counter(), Counter())

    def out() -> Iterator[pa.RecordBatch]:
        for toxic, words in enumerate(seen):
            made: Counter = Counter()
            for w, n in words.items():
                for f in features(w.strip(_EDGES)):
                    made[f] += n
                made[""] += n
            words.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array([0 if toxic else n for n in made.values()], pa.int64()), pa.array([n if toxic else 0 for n in made.values()], pa.int64())], ["feature", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            seen[toxic.as_py()].update(set(words_of(text.as_py())))
            if len(seen[0]) + len(seen[1]) > WORDS:
                yield from out()
    yield from out()


def log_odds(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """feature -> log-odds against the corpus; features that say what their prefix says are left out."""
    clean, toxic = counts.get("", (1, 1))
    base = (toxic + 1) / (clean + toxic + 2)
    rates, odds = {"": base}, {}
    logit = lambda p: log(p / (1 - p))
    for f in sorted(counts, key=lambda f: (f.endswith("$"), len(f))):
        if not f:
            continue
        word = f.removesuffix("$")
        above = next((rates[p] for n in reversed(PREFIXES) if n <= len(word) and (n < len(word) or f != word) and (p := word[:n]) in rates), base)
        c, t = counts[f]
        rates[f] = rate = (t + PRIOR * above) / (c + t + PRIOR)
        value = logit(min(max(rate, 1e-9), 1 - 1e-9)) - logit(base)
        odds[f] = min(max(value, -MOST), MOST)
    return odds


def extreme_value_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p exp(rate * score) = 1; scores have a negative mean and a positive value."""
    p = counts / max(counts.sum(), 1)
    if not ((scores > 0) & (p > 0)).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while f(high) < 0:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labelled documents of fold 0 (weights) and fold 2 (calibration); fold 1 is never read.

    Without toxic or without clean rows in a fold the weights stay empty or the defaults of Model stay.  A document with
    several labels counts as toxic if one says so; null labels, ids and texts without label are left out.
    """
    known = _labelled(docs, labels, rows, id_col, text_col)
    model = Model()
    counted = arrow_map(known.where("part = 0").select("text", "toxic"), _count, "feature string, clean long, toxic long")
    counts = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST)
    # Bounded by the sample: at most the words of `rows` texts over LEAST.
    model.odds = log_odds({r.feature: (r.clean, r.toxic) for r in counts.toLocalIterator()})

    step = 1 / 16

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, bins = _Scores(model), np.zeros(round(2 * (MOST + 1) / step), np.int64)
        for batch in batches:
            made = []
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                segments, scores = passages_of(words, known_words)
                if not toxic.as_py():
                    bins += np.bincount(np.round((scores + MOST + 1) / step).astype(int).clip(0, len(bins) - 1), minlength=len(bins))
                best = sorted((s for _, _, s in segments), reverse=True)
                made.append((toxic.as_py(), len(words), best))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.list_(pa.float64()))], ["toxic", "words", "best"])
        for at in np.flatnonzero(bins).tolist():  # rows of the histogram of clean words' scores: -1, bin, count
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([at], pa.int64()), pa.array([[float(bins[at])]], pa.list_(pa.float64()))], ["toxic", "words", "best"])

    # The segments stay with the executors; what comes to the driver is the histogram, one mean and two numbers for each of `rows` texts.
    seen = keep(arrow_map(known.where("part = 2").select("text", "toxic"), scan, "toxic int, words long, best array<double>"), "segments")
    bins = np.zeros(round(2 * (MOST + 1) / step))
    for r in seen.where("toxic < 0").groupBy("words").agg(F.sum(F.col("best")[0]).alias("n")).collect():
        bins[r.words] = r.n
    texts = seen.where("toxic >= 0 and words > 0")
    model.rate = extreme_value_rate(np.arange(len(bins)) * step - MOST - 1, bins)
    # Location of the law: the mean of a Gumbel variable lies 0.5772 above it.
    top = F.when(F.size("best") > 0, F.col("best")[0]).otherwise(0.0)
    mean = texts.where("toxic = 0").agg(F.avg(F.lit(model.rate) * top - F.log("words"))).first()[0]
    if mean is not None:
        model.log_k = mean - 0.5772156649
    excess = F.transform("best", lambda s: F.lit(model.rate) * s - F.lit(model.log_k) - F.log("words"))
    real = F.filter(excess, lambda e: e > -log(model.significant))
    evidence = F.log(F.lit(1.0) + F.aggregate(real, F.lit(0.0), lambda a, e: a + e))
    rows_seen = texts.select("toxic", evidence.alias("evidence")).collect()  # bounded by `rows`
    x = np.array([r.evidence for r in rows_seen])
    y = np.array([r.toxic for r in rows_seen], float)
    if len(y) and 0 < y.sum() < len(y):
        model.slope, model.offset = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one variable, by Newton steps that never raise the loss; ridge on the slope."""
    a = np.stack([x, np.ones_like(x)], 1)
    loss = lambda w: float(np.logaddexp(0, np.where(y > 0, -1, 1) * (a @ w)).sum() + ridge * w[0] ** 2 / 2)
    w = np.array([0.0, log(y.mean() / (1 - y.mean()))])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        gradient = a.T @ (p - y) + [ridge * w[0], 0]
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-6])
        move, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", passages: bool = True) -> DataFrame:
    """(doc_id, score, n_words, n_passages, best double, starts, ends array<int>): starts and ends of significant passages in words.

    score is the probability of label 1; a null or empty text has the probability of a text without any passage.
    Null ids and repeated rows stay; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Scores(model)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column(1):
                    words = words_of(text.as_py())
                    segments, _ = passages_of(words, known)
                    real = [s for s in segments if model.excess(s[2], len(words)) > -log(model.significant)]
                    rows.append((model.probability([x for _, _, x in segments], len(words)), len(words), len(real), max((s for _, _, s in segments), default=0.0), [a for a, _, _ in real] if passages else None, [b for _, b, _ in real] if passages else None))
                kinds = [pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "score", "n_words", "n_passages", "best", "starts", "ends"])

    schema = "doc_id long, score double, n_words long, n_passages long, best double, starts array<int>, ends array<int>"
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)
