"""Shared plumbing of the corpus operators: scratch tables in the shared folder, Arrow helpers, union-find.

Every operator reads only the columns it names, so further columns of an input (whatever their names) are harmless.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources.scratch import forget, keep, release_scratch, scratch_path, shared_dir  # noqa: F401

Batches = Iterator[pa.RecordBatch]
#: Rows travel to Python in batches of so many bytes (a session's own setting goes before), so long texts don't pile up.
BATCH_BYTES, _BATCH_SETTING, _BATCH_DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def _give_back() -> None:
    """Hand free memory back to the system: a Python worker outlives its tasks, and the next stage needs the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, run: Callable[[Batches], Batches], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow over batches of BATCH_BYTES, whose workers hand their free memory back at the end of each task."""
    if df.sparkSession.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    @wraps(run)
    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(whole, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes (one row at least), so that Python values of few rows are alive at once."""
    rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links a-b: each node that isn't the least of its component, with that least node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            break
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _forest_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduces a task's links to a forest; memory holds at most two links for each node of the task."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    room = 1 << 20
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > room:
            a, b = local_forest(a, b)
            room = max(room, 2 * len(a))  # so each link is looked at a few times only
    a, b = local_forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): (node, root) for every node that isn't its component's least.

    Distributed union-find: each task shrinks its links to a forest, then rounds of large-star and small-star
    (Kiveris et al., "Connected Components in MapReduce and Beyond") run until nothing changes; the number of rounds
    grows with the logarithm of the longest chain.  Each round is written to the shared folder, which cuts lineage.
    Null ends and self-links are ignored; repeated links count once; no links give an empty result.
    """
    links = links.select(F.col(links.columns[0]).cast("long").alias("a"), F.col(links.columns[1]).cast("long").alias("b"))
    links = links.where("a is not null and b is not null and a <> b").distinct()
    now = keep(arrow_map(links, _forest_of_task, "a long, b long").distinct(), "links")
    before = None
    while (state := tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != before:
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        last, now = now, keep(small.where("a <> b").distinct(), "links")
        forget(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
