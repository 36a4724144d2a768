"""Table rewrites behind DML statements: each takes the table's rows and returns those after the statement.

Rows that a statement leaves alone pass through without a shuffle wherever the other side is small enough to be broadcast
by Spark's own size statistics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Appends rows by position, cast to the table's types."""
    if len(rows.columns) != len(table.columns):
        raise ValueError(f"INSERT has {len(rows.columns)} columns, the table has {len(table.columns)}")
    cast = [F.col(f"`{c}`").cast(f.dataType).alias(f.name) for c, f in zip(rows.columns, table.schema, strict=True)]
    return table.unionAll(rows.select(*cast))


def update(table: DataFrame, assignments: dict[str, Column], where: Column | None = None) -> DataFrame:
    """All assignments read the old row; values are cast to the columns' types."""
    chosen = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return table.select(*[F.when(chosen, assignments[f.name].cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name in assignments else F.col(f"`{f.name}`") for f in table.schema])


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False))) if where is not None else table.limit(0)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update_set: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]] | None = None, where: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None, order: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO NOTHING, or DO UPDATE SET update_set(old, excluded) [WHERE ...].

    rows must have the table's columns.  Rows with equal keys in one statement: the first by `order` is inserted; with DO
    NOTHING the others are dropped.  With DO UPDATE one row for each key is taken, the last by `order` (a fold over several
    would depend on the order; the SQL front end applies such rows one after another).
    """
    names = table.columns
    direction = (lambda c: F.col(c).desc()) if update_set else (lambda c: F.col(c).asc())
    if order:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(direction(order)))).where("_n = 1")
    else:
        rows = rows.dropDuplicates(keys)
    rows = rows.select(*[F.col(f"`{n}`").alias(f"_new_{n}") for n in names])
    match = [F.col(k) == F.col(f"_new_{k}") for k in keys]
    if update_set is None:
        fresh = rows.join(table.select(*keys), match, "left_anti")
        return table.unionAll(fresh.select(*[F.col(f"_new_{n}").cast(f.dataType).alias(n) for n, f in zip(names, table.schema, strict=True)]))
    old, excluded = (lambda n: F.col(n)), (lambda n: F.col(f"_new_{n}"))
    sets = update_set(old, excluded)
    allowed = F.coalesce(where(old, excluded), F.lit(False)) if where else F.lit(True)
    both = table.withColumn("_old", F.lit(True)).join(rows.withColumn("_new", F.lit(True)), match, "full_outer")
    out = []
    for f in table.schema:
        changed = sets[f.name] if f.name in sets else F.col(f.name)
        value = F.when(F.col("_old").isNull(), F.col(f"_new_{f.name}")).when(F.col("_new").isNull() | ~allowed, F.col(f.name)).otherwise(changed.cast(f.dataType))
        out.append(value.cast(f.dataType).alias(f.name))
    return both.select(*out)


def first_match(table: DataFrame, source: DataFrame, on: Column, row_id: str, order: list[Column]) -> DataFrame:
    """The table's matching rows with the first source row of each (UPDATE ... FROM takes one); row_id tells the table's rows apart."""
    ranked = table.join(source, on).withColumn("_rank", F.row_number().over(W.partitionBy(row_id).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def update_from(table: DataFrame, source: DataFrame, on: Column, assignments: dict[str, Column], row_id: str, order: list[Column]) -> DataFrame:
    """UPDATE ... FROM: matched rows take the assignments over table and source columns, others stay."""
    hit = first_match(table, source, on, row_id, order)
    new = hit.select(F.col(row_id).alias("_row"), *[e.alias(f"_set_{n}") for n, e in assignments.items()], F.lit(True).alias("_hit"))
    joined = table.join(new, table[row_id] == new["_row"], "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_set_{f.name}").cast(f.dataType)).otherwise(table[f.name]).alias(f.name) if f.name in assignments else table[f.name] for f in table.schema])


def delete_using(table: DataFrame, source: DataFrame, on: Column, row_id: str | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """DELETE ... USING [ORDER BY ... LIMIT n]: a row goes once, however many matches it has; the limit counts matches."""
    if limit is None:
        return table.join(source, on, "left_anti")
    gone = table.join(source, on).orderBy(*(order or [])).limit(limit).select(F.col(row_id).alias("_gone")).distinct()
    return table.join(gone, table[row_id] == gone["_gone"], "left_anti")
