"""Vector columns as numpy blocks, for the searches of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(column: str, zero_too: bool) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component and, unless ``zero_too``, not all zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    sound = x.isNotNull() & finite
    return sound if zero_too else sound & F.exists(x, lambda v: v != 0)


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a double matrix; shorter vectors are filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    length = np.diff(np.asarray(lists.offsets)) if len(lists) else np.empty(0, np.int64)
    flat = np.asarray(lists.flatten()).astype(np.float64)
    widest = int(length.max(initial=0))
    out = np.zeros((len(lists), max(widest, width or 0)))
    if len(lists):
        row = np.repeat(np.arange(len(lists)), length)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        out[row, column] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def best_per_query(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """(query_id, vec_id, score) of several blocks to each query's k best, ranked from 1; ties to smaller vec_id.

    Each query brings k rows a block at most, so a group stays small.
    """
    score = F.col("score") if not largest else -F.col("score")
    order = F.struct(score.alias("by"), F.col("vec_id"), F.col("score"))
    top = found.distinct().groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("top"))
    flat = top.select("query_id", F.posexplode("top").alias("at", "t"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
