"""BM25 text search over DataFrames: postings, corpus statistics, ranking.

The index is derived data: postings (term, doc, tf) and lengths (doc, dl).  Scoring reads only the query's terms, so the
filter on term reaches the scan of materialised postings, and the per-term document counts are tiny.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scalar import LOWER, STOP_WORDS, UPPER, query_terms, text_tokens
from skein.sources.scratch import keep

# The parameters of the score.
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class TextIndex:
    """postings (id, term, tf), lengths (id, dl) of documents with tokens, and the number of all documents."""

    postings: DataFrame
    lengths: DataFrame
    documents: DataFrame
    config: str


def postings(docs: DataFrame, id_col: str, text_col: str, config: str = "english") -> DataFrame:
    """(id, term, tf): the texts are dealt out by id, which is less than to deal out their terms, and counted where they are cut.

    Ids should be unique; rows that share an id are counted as one document.  Those without id, which no number bounds, are counted
    in part before their terms are dealt out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named, others = rows.where("id is not null").repartition("id"), rows.where("id is null")
    return _counted(named, config).unionAll(_counted(others, config))


def _counted(rows: DataFrame, config: str) -> DataFrame:
    return rows.select("id", F.explode(text_tokens("text", config)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def build_index(docs: DataFrame, id_col: str, text_col: str, config: str = "english") -> TextIndex:
    """Lengths need no shuffle, as ids are unique in a table with an index."""
    lengths = docs.select(F.col(id_col).alias("id"), F.size(text_tokens(text_col, config)).cast("bigint").alias("dl")).where("dl > 0")
    return TextIndex(postings(docs, id_col, text_col, config), lengths, docs.select(F.col(id_col).alias("id")), config)


def with_score(df: DataFrame, text_col: str, query: str, config: str = "english", name: str = "score") -> DataFrame:
    """df with the BM25 score of each row in column `name`, 0.0 where no term matches.

    Terms are counted inside each row, so ranking a table needs no postings and no shuffle of texts: one pass gives the
    statistics (row count, mean length, document frequency of each term), a second one the scores.
    A term that the query repeats counts as often.
    """
    terms = query_terms(query, config)
    names = df.columns
    df = df.withColumn("__tokens", text_tokens(text_col, config))  # used several times, so Catalyst keeps it as a step of its own
    tokens = F.col("__tokens")
    dl = F.coalesce(F.size(tokens), F.lit(0)).cast("double")
    counted = df.select(dl.alias("dl"), *[_tf(tokens, t).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"), *[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("bigint")), F.lit(0)).alias(f"df{i}") for i in range(len(terms))])
    stats = stats.select(F.struct("*").alias("__bm25"))
    score: Column = F.lit(0.0)
    for i, term in enumerate(terms):
        score = score + _part(_tf(tokens, term).cast("double"), dl, F.col("__bm25.n"), F.col(f"__bm25.df{i}"), F.col("__bm25.avgdl"))
    return df.crossJoin(F.broadcast(stats)).select(*[F.col(f"`{c}`") for c in names], score.alias(name))  # stats is one row


def scores(docs: DataFrame, id_col: str, text_col: str, query: str, config: str = "english") -> DataFrame:
    """(id, score) of every document, as with_score.

    The texts are read and cut once: each document's length and term counts, a few numbers, are written to the scratch folder, and
    both the statistics and the scores come from there.
    """
    terms = query_terms(query, config)
    different = sorted(set(terms))
    cut = docs.select(F.col(id_col).alias("id"), text_tokens(text_col, config).alias("ts"))
    hits = F.filter("ts", lambda t: t.isin(*different)) if different else F.array().cast("array<string>")
    cut = cut.select("id", F.coalesce(F.size("ts"), F.lit(0)).cast("double").alias("dl"), F.coalesce(hits, F.array().cast("array<string>")).alias("hits"))
    counted = keep(cut.select("id", "dl", *[_tf(F.col("hits"), t).alias(f"tf{i}") for i, t in enumerate(different)]), "terms")
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"), *[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("bigint")), F.lit(0)).alias(f"df{i}") for i in range(len(different))])
    joined = counted.crossJoin(F.broadcast(stats.select(F.struct("*").alias("__bm25"))))  # one row
    parts = [_part(F.col(f"tf{different.index(t)}").cast("double"), F.col("dl"), F.col("__bm25.n"), F.col(f"__bm25.df{different.index(t)}"), F.col("__bm25.avgdl")) for t in terms]
    return joined.select("id", sum(parts, F.lit(0.0)).alias("score"))


def _part(tf: Column, dl: Column, n: Column, df: Column, avgdl: Column) -> Column:
    """What one term adds to the score."""
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))).otherwise(0.0)


def _tf(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def rank_index(index: TextIndex, query: str) -> DataFrame:
    """(id, score) of the matching documents from materialised postings; reads the query's terms alone."""
    terms = query_terms(query, index.config)
    weights = {t: float(terms.count(t)) for t in terms}
    hits = index.postings.where(F.col("term").isin(*weights)) if weights else index.postings.limit(0)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row for each term of the query
    stats = index.documents.agg(F.count(F.lit(1)).alias("n")).crossJoin(index.lengths.agg(F.avg("dl").alias("avgdl")))
    weight = F.coalesce(*[F.when(F.col("term") == t, F.lit(w)) for t, w in weights.items()], F.lit(1.0))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    joined = hits.join(F.broadcast(df), "term").join(index.lengths, "id").crossJoin(F.broadcast(stats))
    return joined.groupBy("id").agg(F.sum(part).alias("score"))


def term_stats(docs: DataFrame, text_col: str, config: str = "english") -> DataFrame:
    """(term, df, n, dl, full): the number of rows with each term, sorted by term for pruning; in the row of the empty term the numbers of all
    rows, of their tokens and of rows with tokens.  Such tables of parts of a corpus add up to that of the whole."""
    tokens = docs.select(text_tokens(text_col, config).alias("ts"))
    zero = F.lit(0).cast("bigint")
    each = tokens.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = F.greatest(F.coalesce(F.size("ts"), F.lit(0)), F.lit(0))
    whole = tokens.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("dl"), F.coalesce(F.sum((size > 0).cast("bigint")), F.lit(0)).alias("full"))
    rows = each.select("term", "df", zero.alias("n"), zero.alias("dl"), zero.alias("full")).unionByName(whole.select(F.lit("").alias("term"), zero.alias("df"), "n", "dl", "full"))
    return rows.repartitionByRange("term").sortWithinPartitions("term")


def ranked_call(operand: str, terms: list[str], stats: dict[str, tuple[int, int, int, int]], config: str) -> str:
    """SQL text of the corpus score of an operand, of built-in functions alone, so it may stand anywhere; stats: term -> (df, n, dl, full)."""
    _, n, dl, full = stats.get("", (0, 0, 0, 0))
    idf = [log((n - (df := stats.get(t, (0,))[0]) + 0.5) / (df + 0.5) + 1) for t in terms]
    quoted = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    if not terms:
        return "0D"
    stop = f" AND t NOT IN ({quoted(STOP_WORDS)})" if config == "english" else ""
    small = f"CASE WHEN octet_length({operand}) = length({operand}) THEN lower({operand}) ELSE translate({operand}, '{UPPER}', '{LOWER}') END"
    tokens = f"filter(split({small}, '[^\\\\p{{L}}\\\\p{{N}}]+'), t -> t <> ''{stop})"
    counts = f"transform(array({quoted(terms)}), w -> CAST(size(filter(ts, t -> t = w)) AS DOUBLE))"
    length = f"{1 - B!r}D + {B!r}D * try_divide(CAST(size(ts) AS DOUBLE), {float(dl / full if full else 1.0)!r}D)"
    part = f"CASE WHEN tf > 0D THEN try_divide(i * tf * {K1 + 1!r}D, tf + {K1!r}D * ({length})) ELSE 0D END"
    weights = ", ".join(f"{w!r}D" for w in idf)
    # transform over one array of the tokens names them, so they are made once for all terms
    return f"coalesce(element_at(transform(array({tokens}), ts -> aggregate(zip_with({counts}, array({weights}), (tf, i) -> {part}), 0D, (s, v) -> s + v)), 1), 0D)"
