"""Language identification by Bayesian fusion of evidence.

A record's posterior over languages is the product of
  its text's likelihood under character-trigram models (tempered, as overlapping trigrams aren't independent),
  the likelihood of its declared language (markup or metadata),
  the likelihood of its address suffix (a language code in the path or host, and the top-level domain),
  the prior of its host, smoothed towards its domain, and that towards the whole corpus.
The likelihoods of declarations and suffixes and the host priors come from grouped aggregations over all records, with
the language that the text alone speaks for as the count's label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, keep, slices

#: Documented bound of the labelled records that the trigram models are fitted on, shared among the languages; least number of a language's records for a model.
FIT_ROWS, LEAST_TEXTS = 20_000, 20
SLOTS = 1 << 18
#: Exponent of the text's likelihood; the trigrams' worth that a text of any length speaks with at most (all its trigrams are read: the mean
#: over them counts as so many), so that declaration and host can still weigh against a long text; strength of each level of priors in records.
TEMPER, MOST_TRIGRAMS, PRIOR = 0.3, 400, 20.0
#: Least posterior (texts in two languages are kept), least letters and least advantage a trigram over text of no language, for a decision.
SURE, LETTERS, MARGIN = 0.34, 3, 0.0
#: A trigram that a language lacks costs at most so much more than one of no language.
FLOOR = 3.0
UNKNOWN = "und"
#: Hosts, domains or codes whose counts are broadcast at most; beyond, the join is a shuffle in which each key has SALTS parts.
FEW, SALTS = 200_000, 32
EVIDENCE = ["text", "declared", "suffix", "host", "domain"]

_LETTERS = re.compile(r"[^\W\d_]+")
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_META = re.compile(r"<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
_PATH = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", re.I)


def trigram_slots(text: str) -> np.ndarray:
    """Slots of the letter trigrams of a text, words in lower case between single spaces."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return np.empty(0, np.int64)
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    h = ((c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(46)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    tables: np.ndarray  # languages x SLOTS, log probabilities
    null: float  # log probability of a slot in text of no language

    def likelihoods(self, text: str | None) -> tuple[np.ndarray, int, float]:
        """Tempered log likelihood of each language, number of trigrams, best advantage a trigram over no language."""
        slots = trigram_slots(text or "")
        if not len(slots) or not self.languages:
            return np.zeros(len(self.languages)), 0, 0.0
        sums = np.array([table[slots].sum(dtype=np.float64) for table in self.tables])
        scale = TEMPER * min(1.0, MOST_TRIGRAMS / len(slots))
        return (sums - sums.max()) * scale, len(slots), float(sums.max() / len(slots) - self.null)


def fit_text(records: DataFrame, rows: int = FIT_ROWS) -> TextModel:
    """Trigram models from (text, declared): about `rows` records at most with a declared language, chosen by hash in each language.

    The bound is shared out evenly among the languages; what a rare language leaves goes to the others.  A declared code
    of fewer than LEAST_TEXTS records is noise and gets no model.  No usable record gives a model without languages.
    """
    labelled = records.select("text", F.lower(F.trim("declared")).alias("lang")).where("length(lang) > 0 and text is not null")
    coded = keep(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS), "languages")
    sizes = {r.lang: r.n for r in coded.toLocalIterator()}  # one row for each code
    shares, left = {}, rows
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        taken = min(n, max(LEAST_TEXTS, left // (len(sizes) - i)))
        shares[lang], left = min(1.0, taken / n), left - taken
    if shares:
        bound = F.create_map(*[F.lit(x) for lang, share in shares.items() for x in (lang, int((1 << 30) * share))])
        share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.coalesce(bound[F.col("lang")], F.lit(0))
    else:
        share = F.lit(False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trigram counts of each language, summed within a batch; slot -1 counts the texts."""
        for batch in batches:
            seen: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                seen.setdefault(lang.as_py(), []).append(trigram_slots(text.as_py()))
            for lang, found in seen.items():
                slots, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(slots) + 1), pa.string()), pa.array(np.append(slots, -1)), pa.array(np.append(n, len(found)))], ["lang", "slot", "n"])

    counted = arrow_map(labelled.where(share), count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    kept = keep(counted, "trigrams")
    languages = sorted(r.lang for r in kept.where("slot = -1").toLocalIterator())  # one row for each code in the sample
    tables = np.zeros((len(languages), SLOTS), np.float64)
    for batch in [kept.where(F.col("lang").isin(languages) & (F.col("slot") >= 0)).toArrow()] if languages else []:  # at most languages x SLOTS rows
        place = {lang: i for i, lang in enumerate(languages)}
        np.add.at(tables, (np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64), batch.column("slot").to_numpy()), batch.column("n").to_numpy())
    together = tables.sum(axis=0) + 0.01
    together /= together.sum()
    smooth = 2000.0  # trigrams' worth of the common distribution in each model
    tables = np.log((tables + smooth * together) / (tables.sum(axis=1, keepdims=True) + smooth)) if languages else tables
    null = float(-np.log(SLOTS))
    return TextModel(languages, np.maximum(tables, null - FLOOR).astype(np.float32), null)  # a few odd trigrams don't decide


def declared_in_markup(html: str | None) -> str | None:
    found = _LANG.search(html or "") or _META.search(html or "")
    return found[1].lower() if found else None


def address_parts(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (its last two labels) and suffix: the top-level domain with a two-letter code of the path or the first label."""
    found = _PATH.match(url or "")
    if not found or not found[1]:
        return None, None, None
    host = found[1].rsplit("@", 1)[-1].split(":")[0].lower().rstrip(".")
    labels = host.split(".")
    codes = [x.lower() for x in found[2].split("/") if re.fullmatch(r"[A-Za-z]{2}(?:[-_][A-Za-z]{2})?", x)][:1] + [x for x in labels[:1] if re.fullmatch(r"[a-z]{2}", x)]
    return host, ".".join(labels[-2:]), f"{labels[-1]}/{codes[0][:2] if codes else ''}"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(row struct<doc_id, page_id>, text, declared, suffix, host, domain) of web pages; text is the character data without scripts and styles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import html as entities

        drop = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for url, html in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    host, domain, suffix = address_parts(url)
                    rows.append((entities.unescape(drop.sub(" ", html or "")), declared_in_markup(html), suffix, host, domain))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], pa.string()) for i in range(5))], ["id", *EVIDENCE])

    chosen = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    made = arrow_map(chosen, run, "id long, text string, declared string, suffix string, host string, domain string")
    return made.select(F.struct(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("page_id")).alias("row"), *EVIDENCE)


def document_records(docs: DataFrame, whole: bool = False, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The like of documents: the source stands for the host, there is no address suffix; with whole=True, row is the whole input row."""
    null = F.lit(None).cast("string")
    row = F.struct("*") if whole else F.struct(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"))
    return docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("declared"), null.alias("suffix"), F.col(source_col).cast("string").alias("host"), null.alias("domain"))


def read_texts(records: DataFrame, model: TextModel, text_field: str | None = None) -> DataFrame:
    """With text_field, that field of row is the text, so it isn't sent twice.

    Gives row, the evidence but the text, and loglik array<double>, n_trigrams, speaks (index of the text's best language, -1 for none)."""
    names = ["row", *EVIDENCE[1:]]
    kinds = {f.name: f for f in records.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(len(names)) if text_field is None else part.column(0).field(text_field)
                found = [model.likelihoods(x.as_py()) for x in texts]
                best = [int(np.argmax(x)) if n >= LETTERS and gain > MARGIN else -1 for x, n, gain in found]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array([x.tolist() for x, _, _ in found], pa.list_(pa.float64())), pa.array([n for _, n, _ in found], pa.int64()), pa.array(best, pa.int32())], [*names, "loglik", "n_trigrams", "speaks"])

    made = T.StructType([kinds[n] for n in names]).add("loglik", T.ArrayType(T.DoubleType())).add("n_trigrams", T.LongType()).add("speaks", T.IntegerType())
    return arrow_map(records.select("row", *[F.lower(F.trim(n)).alias(n) for n in EVIDENCE[1:]], *(["text"] if text_field is None else [])), run, made)


def _counts(read: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n array<double>): for each value the number of records of each language by text; partial sums before the shuffle."""
    sums = [F.sum((F.col("speaks") == i).cast("double")).alias(f"n{i}") for i in range(size)]
    counted = read.where(F.col(key).isNotNull() & (F.col("speaks") >= 0)).groupBy(key).agg(*sums)
    return keep(counted.select(F.col(key), F.array(*[F.col(f"n{i}") for i in range(size)]).alias(f"{key}_n")), f"by-{key}")


def _with_counts(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """rows left-joined with the counts of their key; rows without key and rows of a frequent key are dealt out over many tasks."""
    if counts.count() <= FEW:
        return rows.join(F.broadcast(counts), key, "left")
    own = F.xxhash64("row", "loglik")  # by content, so a task that runs again deals its rows out alike
    salted = counts.select(F.col(key).alias("_key"), f"{key}_n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    lone = F.concat(F.lit("\0"), own.cast("string"))  # equal to no key
    dealt = rows.withColumn("_part", F.pmod(own, F.lit(SALTS))).withColumn("_at", F.coalesce(F.col(key), lone))
    return dealt.join(salted, (F.col("_at") == F.col("_key")) & (F.col("_part") == F.col("_salt")), "left").drop("_part", "_at", "_key", "_salt")


def identify(records: DataFrame, model: TextModel, twice: bool = False, text_field: str | None = None) -> DataFrame:
    """(the fields of row, id_lang, id_posterior, id_accepted, id_text_lang, id_declared): one row for each record.

    id_lang is UNKNOWN and id_accepted false where the text has too few letters, is no better than text of no language,
    or no language has a posterior of SURE; ties go to the language first in the alphabet.  Missing evidence (null,
    empty) counts as none.  Null ids and repeated rows stay, an empty table gives no rows.  twice=True scores the texts
    once for the counts and once for the outcome instead of writing the rows in between, for rows that hold the texts.
    """
    size = len(model.languages)
    read = read_texts(records, model, text_field)
    if not twice:
        read = keep(read, "likelihoods")
    if not size:
        return read.select("row.*", F.lit(UNKNOWN).alias("id_lang"), F.lit(0.0).alias("id_posterior"), F.lit(False).alias("id_accepted"), F.lit(UNKNOWN).alias("id_text_lang"), F.col("declared").alias("id_declared"))
    seen = read if not twice else keep(read_texts(records.withColumn("row", F.lit(None).cast("long")), model).drop("row", "loglik"), "best-languages")
    total = np.full(size, 1.0)
    for r in seen.where("speaks >= 0").groupBy("speaks").count().collect():  # one row for each language
        total[r.speaks] += r["count"]
    world = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    joined = read.withColumn("_world", world)
    for key in ("host", "domain", "declared", "suffix"):
        joined = _with_counts(joined, _counts(seen, key, size), key)
    none = F.array(*[F.lit(0.0)] * size)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def shared(key: str, prior: str) -> F.Column:
        """The value's distribution over the languages, smoothed towards the prior."""
        n = F.coalesce(f"{key}_n", none)
        whole = F.aggregate(n, F.lit(PRIOR), lambda s, x: s + x)
        return F.zip_with(n, F.col(prior), lambda a, p: (a + PRIOR * p) / whole)

    def likelihood(key: str) -> F.Column:
        """Of the value under each language, up to a factor of the value alone: its share over the corpus share."""
        return F.zip_with(shared(key, "_world"), F.col("_world"), lambda s, w: F.log(s) - F.log(w))

    joined = joined.withColumn("_domain", shared("domain", "_world")).withColumn("_host", shared("host", "_domain"))
    joined = joined.withColumn("_log", add(add(F.col("loglik"), likelihood("declared")), add(likelihood("suffix"), F.transform("_host", lambda p: F.log(p)))))
    joined = joined.withColumn("_top", F.array_max("_log")).withColumn("_post", F.lit(1.0) / F.aggregate("_log", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top"))))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.element_at(names, F.array_position("_log", F.col("_top")).cast("int"))
    sure = (F.col("speaks") >= 0) & (F.col("_post") >= SURE)
    return joined.select(
        "row.*",
        F.when(sure, best).otherwise(UNKNOWN).alias("id_lang"),
        F.when(F.col("n_trigrams") >= LETTERS, F.col("_post")).otherwise(0.0).alias("id_posterior"),
        sure.alias("id_accepted"),
        F.when(F.col("speaks") >= 0, F.element_at(names, F.col("speaks") + 1)).otherwise(UNKNOWN).alias("id_text_lang"),
        F.col("declared").alias("id_declared"),
    )


def keep_identified(docs: DataFrame, **columns: str) -> DataFrame:
    """The documents of a known language, with their own columns; the others go."""
    records = document_records(docs, whole=True, **columns)
    names = docs.columns
    text = columns.get("text_col", "text")
    found = identify(records, fit_text(records), twice=True, text_field=text if docs.schema[text].dataType == T.StringType() else None)
    return found.where("id_accepted").select(*[F.col(f"`{n}`") for n in names])
