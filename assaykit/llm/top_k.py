"""Exact top-k inner products by no-random-access aggregation.

The rows are cut into blocks. In a block, every dimension is a list sorted by component. The
lists are read from their better end for a query (largest first where the query's
component is positive, smallest first where it is negative), all to the same depth. A row
that was read in some lists has a lower bound (what was read, plus the worst that unread
lists can hold) and an upper bound (what was read, plus the values at the reading depth in
unread lists); a row read nowhere is bounded by those values alone. Reading goes on until
no outsider can qualify for the k best, twice as deep each time; the rows still in doubt are then
read to their end. Bounds of many queries are worked out together as matrix products. Blocks'
winners merge by query. Blocks of queries meet blocks of rows, so neither a driver nor a task holds
all rows or all queries.

Components are turned into whole numbers first, so sums are exact. Defined results: vectors
null or with null or non-finite components take no part, nor do rows without an id; shorter
vectors count as filled up with zeros; a query without candidates has no rows; ties go to
the smaller id; scores beyond 64 bits become the nearest 64-bit number; repeated (id, vector) rows count once and rows of the query's own id are no
candidates; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read
from .vectors import best_per_query, matrix, same_width, usable

BLOCK, QUERIES = 16_384, 2048  #: rows and queries that meet in a group
FIRST = 1 / 8  #: share of the lists that is read first
EXACT, LONG = 1 << 53, (1 << 63) - 1


class Lists:
    """The sorted lists of a block of rows (whole numbers), and what reading them to some depth tells."""

    def __init__(self, rows: np.ndarray, row_ids: np.ndarray):
        order = np.argsort(row_ids, kind="stable")
        self.rows, self.ids = rows[order], row_ids[order]
        self.rank = np.empty(rows.shape, np.int32)  # place in each list, largest first
        by = np.argsort(-self.rows, axis=0, kind="stable")
        np.put_along_axis(self.rank, by, np.arange(len(rows), dtype=np.int32)[:, None], axis=0)
        self.lists = np.take_along_axis(self.rows, by, axis=0)
        self.read: dict[int, tuple] = {}

    def at(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For [positive parts, negative parts] of a query: the values at the depth, and per row what was read over them and over the worst."""
        if depth not in self.read:
            n, rows = len(self.rows), self.rows
            high, low = self.rank < depth, self.rank >= n - depth
            top, bottom, last, first = self.lists[depth - 1], self.lists[n - depth], self.lists[-1], self.lists[0]
            over_reach = np.hstack([np.where(high, rows - top, 0), np.where(low, rows - bottom, 0)])
            over_worst = np.hstack([np.where(high, rows - last, 0), np.where(low, rows - first, 0)])
            self.read[depth] = np.hstack([top, bottom]), over_reach, over_worst
        return self.read[depth]


def no_random_access(queries: np.ndarray, lists: Lists, query_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Each query's k best rows in this block: (query id, row id, score)."""
    rows, row_ids = lists.rows, lists.ids
    n = len(rows)
    largest = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * max(1, rows.shape[1])
    if largest >= EXACT:  # doubles would round: plain integers, of any size
        return _whole_numbers(queries, rows, query_ids, row_ids, k)
    parts = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
    worst = parts @ np.hstack([lists.lists[-1], lists.lists[0]]) if n else None
    out: list[tuple[int, int, int]] = []
    active = np.arange(len(queries))
    depth = max(k + 1, int(np.ceil(n * FIRST))) // 2
    while len(active) and n:
        depth = min(n, 2 * depth + 1)
        reach, over_reach, over_worst = lists.at(depth)
        lower = parts[active] @ over_worst.T + worst[active][:, None]
        upper = parts[active] @ over_reach.T + (parts[active] @ reach)[:, None]
        at = np.searchsorted(row_ids, query_ids[active])
        for i in np.flatnonzero(row_ids[np.minimum(at, n - 1)] == query_ids[active]):
            same = slice(at[i], np.searchsorted(row_ids, query_ids[active[i]], side="right"))
            lower[i, same] = upper[i, same] = -np.inf
        place = max(0, n - k)
        bar = np.partition(lower, place, axis=1)[:, place]  # the k-th best lower bound
        doubt = upper >= bar[:, None]
        done = (doubt.sum(1) <= max(4 * k, n // 64)) | (depth == n)
        for i in np.flatnonzero(done):
            at = np.flatnonzero(doubt[i] & (upper[i] > -np.inf))
            score = rows[at] @ queries[active[i]]  # the rows in doubt, read to the end
            best = np.lexsort((row_ids[at], -score))[:k]
            out += [(int(query_ids[active[i]]), int(row_ids[at[j]]), int(score[j])) for j in best]
        active = active[~done]
    return out


def _whole_numbers(queries, rows, query_ids, row_ids, k):
    out = []
    whole = [[int(v) for v in r] for r in rows]
    for q, i in zip(queries, query_ids, strict=True):
        q = [int(v) for v in q]
        scored = sorted((-max(-LONG, min(LONG, sum(a * b for a, b in zip(q, r, strict=True)))), int(j)) for r, j in zip(whole, row_ids, strict=True) if j != i)
        out += [(int(i), j, -s) for s, j in scored[:k]]
    return out


def top_k(rows: DataFrame, is_query, k: int, id_col: str = "vec_id", vector: str = "embedding", factor: float = 256.0) -> DataFrame:
    """Each query's k rows of the highest inner product of floor(factor * component): query_id, rank, vec_id, score."""
    sound = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    sound = sound.where(F.col("vec_id").isNotNull() & usable("x", zero_too=True)).distinct()
    size = sound.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query(F.col("vec_id")), 1)).alias("q")).first()
    blocks, asked = max(1, -(-size["n"] // BLOCK)), max(1, -(-size["q"] // QUERIES))
    deal = lambda parts: F.pmod(F.xxhash64("vec_id", "x"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    placed = sound.select("vec_id", "x", deal(blocks).alias("block"), each(asked).alias("part"))
    wanted = sound.where(is_query(F.col("vec_id"))).select("vec_id", "x", deal(asked).alias("part"), each(blocks).alias("block"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = same_width(*(np.floor(factor * matrix(t.column("x"))) for t in (left, right)))
        query_ids, lists, found = np.asarray(left.column("vec_id")), Lists(b, np.asarray(right.column("vec_id"))), []
        for i in range(0, len(a), 256):
            found += no_random_access(a[i : i + 256], lists, query_ids[i : i + 256], k)
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    met = wanted.groupBy("block", "part").cogroup(placed.groupBy("block", "part")).applyInArrow(run, "query_id long, vec_id long, score long")
    return best_per_query(met, k, largest=True)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for every id divisible by 50."""
    return top_k(read(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, 5)


OP10_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
