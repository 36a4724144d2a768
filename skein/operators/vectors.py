"""Exact vector search: distance expressions with ORDER BY and LIMIT, which Spark runs as one top-k per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.scalar import cosine_distance, l2_distance

METRICS = {"l2": l2_distance, "cosine": cosine_distance}


def distances(df: DataFrame, vector_col: str, query: list[float], metric: str = "l2") -> DataFrame:
    """df with a column dist; the query is a literal, so no join is needed."""
    return df.withColumn("dist", METRICS[metric](vector_col, F.array(*[F.lit(float(x)) for x in query])))


def nearest(df: DataFrame, vector_col: str, query: list[float], k: int, tiebreak: str, metric: str = "l2") -> DataFrame:
    return distances(df, vector_col, query, metric).orderBy("dist", tiebreak).limit(k)
