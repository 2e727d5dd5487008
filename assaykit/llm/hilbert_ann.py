"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions several times; each time the projections, shifted
by a random part of a cell, are placed on a Hilbert curve. The rows of a curve are cut into
ranges of its key of about equal size. A query is compared with its own range and the two
beside it, on every curve; all curves' finds merge, are ranked by the exact distance on the
original vectors and cut to the nearest.

How many ranges there are follows from the data: on a bounded sample, the distance along the
curves between queries and their true neighbours is measured at two sizes, and the trend is
carried on to the number of rows. Where the projections keep neighbours together, ranges are
short and grow little with the rows; where they do not, as for vectors alike in all
directions, ranges stay a share of the table, and the work is near that of comparing everything.

Equal vectors are one point of the curves: a point keeps its k + 1 smallest ids, which is
all that any query can be given of it, so large groups of copies neither crowd a range nor
meet in one task. Large ranges are divided by rows and by queries, and each division of queries
meets each of rows, so a task's rows and queries are bounded.

The projections' scale is fitted on at most ``FIT_ROWS`` rows; every row is indexed. Defined
results: vectors null, all zero or with null or non-finite components take no part, nor do
rows without an id; shorter vectors count as filled up with zeros; ties go to the smaller
id; a repeated row counts once; a query without candidates has no rows; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read
from .vectors import matrix, same_width, usable

CURVES, DIMS, BITS, SPREAD = 20, 8, 7, 4.0
DIVISION, QUERIES, FIT_ROWS = 16_384, 4096, 4096
FOUND = 0.97  #: share of the sample's true neighbours that the ranges are to reach


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of whole-number cells (n by dimensions, each under 2**bits); dimensions * bits at most 63.

    Per bit plane from the top, a cell's axes are reflected or exchanged to the sub-cube's own
    orientation; then the planes are Gray-decoded and interleaved.
    """
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, below = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(dims):
            swap = np.where(x[i] & bit, np.uint64(0), (x[0] ^ x[i]) & below)
            flip = np.where(x[i] & bit, below, np.uint64(0))
            x[0] ^= flip ^ swap
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint64(level) & one, (one << np.uint64(level)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << one | (x[i] >> np.uint64(level) & one)
    return key.astype(np.int64)


class Curves:
    """The projections, shifts and scales of all curves."""

    def __init__(self, sample: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        width = max(1, sample.shape[1])
        self.mean = sample.mean(0) if len(sample) else np.zeros(width)
        self.axes, self.scale = [], []
        self.shift = rng.uniform(0, 1, (CURVES, DIMS))
        for _ in range(CURVES):
            axes = np.linalg.qr(rng.normal(size=(width, width)))[0][:, np.arange(DIMS) % width]
            spread = ((sample - self.mean) @ axes).std(0) if len(sample) else np.ones(DIMS)
            self.axes.append(axes)
            self.scale.append(np.where(spread > 0, spread, 1.0))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """n by CURVES keys."""
        top, out = (1 << BITS) - 1, np.empty((len(x), CURVES), np.int64)
        x = np.pad(x, ((0, 0), (0, max(0, len(self.mean) - x.shape[1]))))[:, : len(self.mean)]
        for c in range(CURVES):
            at = ((x - self.mean) @ self.axes[c]) / self.scale[c]
            cells = ((at / (2 * SPREAD) + 0.5 + self.shift[c]) / 2) * (top + 1)
            out[:, c] = hilbert_keys(np.clip(cells, 0, top).astype(np.int64), BITS)
        return out


def reach(sample: np.ndarray, curves: Curves, k: int) -> float:
    """The share of the sample that lies between a query and its true neighbours on the best curve, for ``FOUND`` of them."""
    n, asked = len(sample), min(len(sample), 256)
    place = np.argsort(np.argsort(curves.keys(sample), axis=0, kind="stable"), axis=0)
    square = (sample * sample).sum(1)
    gaps = []
    for q in range(asked):
        far = square - 2 * (sample @ sample[q])
        far[q] = np.inf
        near = np.argpartition(far, min(k, n - 1) - 1)[:k] if n > 1 else np.empty(0, int)
        gaps.append(np.abs(place[near] - place[q]).min(1) / n)
    return float(np.quantile(np.concatenate(gaps), FOUND)) if gaps and n > 1 else 1.0


def ranges_for(sample: np.ndarray, curves: Curves, k: int, rows: int) -> int:
    """How many ranges to cut a curve of so many rows into."""
    whole = reach(sample, curves, k)
    if rows > len(sample) >= 256:
        part = reach(sample[: len(sample) // 4], curves, k)
        falls = min(1.0, max(0.0, float(np.log(max(part, 1e-9) / max(whole, 1e-9)) / np.log(4))))
        whole *= (len(sample) / rows) ** falls
    return max(1, min(int(1 / max(whole, 1e-9)), rows // (4 * (k + 1))))


def points(rows: DataFrame, keep: int) -> DataFrame:
    """Rows (vec_id, x) to different vectors: x, ids (the ``keep`` smallest); combined in each partition before the shuffle."""

    def run(batches):
        found: dict[bytes, list] = {}
        for batch in batches:
            at, flat = batch.column("x").offsets.to_pylist(), np.asarray(batch.column("x").values) + 0.0  # no negative zeros
            for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                found.setdefault(flat[at[i] : at[i + 1]].tobytes(), []).append(vec_id)
            if sum(map(len, found.values())) > 20_000:
                yield table(found)
                found = {}
        yield table(found)

    def table(found):
        vectors, ids = [np.frombuffer(k) for k in found], [sorted(set(v))[:keep] for v in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(vectors, pa.list_(pa.float64())), pa.array(ids, pa.list_(pa.int64()))], ["x", "ids"])

    parts = rows.mapInArrow(run, "x array<double>, ids array<long>")
    return parts.groupBy("x").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def nearest_in(queries: np.ndarray, rows: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
    """Each query's k nearest ids among the points, by exact distance, then id."""
    queries, rows = same_width(queries, rows)
    out = []
    square = (rows * rows).sum(1)
    for a in range(0, len(queries), 256):
        part = queries[a : a + 256]
        rough = square[None, :] - 2 * (part @ rows.T)
        some = min(len(rows), k)
        limit = np.partition(rough, some - 1, axis=1)[:, some - 1]
        slack = 1e-9 * (1 + square.max() + (part * part).sum(1))  # more than rounding can do, so ties are all worked out
        for q, at in zip(part, (np.flatnonzero(r <= a) for r, a in zip(rough, limit + slack, strict=True)), strict=True):
            exact = np.sqrt(((rows[at] - q) ** 2).sum(1))
            every = sorted((float(d), i) for d, j in zip(exact, at, strict=True) for i in ids[j])
            out.append(every[:k])
    return out


def nearest(rows: DataFrame, is_query, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k nearest rows found: query_id, rank, vec_id, score (Euclidean distance)."""
    sound = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    sound = sound.where(F.col("vec_id").isNotNull() & usable("x", zero_too=False))
    sample = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("x").toArrow()
    fitted = matrix(sample.column("x"))
    curves = Curves(fitted)

    def place(batches):
        for batch in batches:
            keys = curves.keys(matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys), pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    every = points(sound, k + 1).mapInArrow(place, "x array<double>, ids array<long>, keys array<long>")
    asked = points(sound.where(is_query(F.col("vec_id"))), 1).mapInArrow(place, "x array<double>, ids array<long>, keys array<long>")
    size = sound.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query(F.col("vec_id")), 1)).alias("q")).first()
    ranges = ranges_for(fitted, curves, k, size["n"])
    shares = [i / ranges for i in range(1, ranges)] or [1.0]
    cuts = every.select([F.percentile_approx(F.col("keys")[c], shares, 10_000).alias(f"c{c}") for c in range(CURVES)] + [F.count(F.lit(1)).alias("n")]).first()
    bounds = [np.array(cuts[c] or [], np.int64) for c in range(CURVES)]
    divisions, parts = max(1, -(-cuts["n"] // (ranges * DIVISION))), max(1, -(-3 * size["q"] // (ranges * QUERIES)))

    def dealt(queries: bool):
        def run(batches):
            for batch in batches:
                keys = np.array(batch.column("keys").to_pylist(), np.int64).reshape(-1, CURVES)
                n = len(keys)
                if not n:
                    continue
                rep = np.array([i[0] for i in batch.column("ids").to_pylist()], np.int64)
                for c in range(CURVES):
                    part = np.searchsorted(bounds[c], keys[:, c], side="right")
                    for step in (-1, 0, 1) if queries else (0,):
                        for other in range(divisions if queries else parts):
                            both = (np.full(n, other), rep % parts) if queries else (rep % divisions, np.full(n, other))
                            kept = pa.array((part + step >= 0) & (part + step <= len(bounds[c])))
                            columns = [np.full(n, c), part + step, *both]
                            made = [pa.array(v.astype(np.int32)) for v in columns] + [pa.array(rep), batch.column("x"), batch.column("ids")]
                            yield pa.RecordBatch.from_arrays(made, ["curve", "part", "division", "asked", "rep", "x", "own"]).filter(kept)

        return run

    kinds = "curve int, part int, division int, asked int, rep long, x array<double>, own array<long>"
    left, right = asked.mapInArrow(dealt(True), kinds), every.mapInArrow(dealt(False), kinds)

    def meet(key, a: pa.Table, b: pa.Table) -> pa.Table:
        found = nearest_in(matrix(a.column("x")), matrix(b.column("x")), b.column("own").to_pylist(), k + 1) if len(a) and len(b) else []
        rows_ = [(q, i, d) for q, near in zip(a.column("rep").to_pylist(), found, strict=False) for d, i in near]
        columns = list(zip(*rows_, strict=True)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["rep", "vec_id", "score"])

    by = ("curve", "part", "division", "asked")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "rep long, vec_id long, score double").distinct()
    order = F.struct("score", "vec_id")
    top = found.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(order)), 1, k + 1).alias("top"))  # k + 1 rows a range and division at most
    same = sound.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "x").distinct()
    reps = asked.select("x", F.col("ids")[0].alias("rep"))
    each = same.join(reps, "x").join(top, "rep").select("query_id", F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    flat = each.select("query_id", F.posexplode("top").alias("at", "t"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def op9_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of all embeddings for every id divisible by 100."""
    return nearest(read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, 10)
