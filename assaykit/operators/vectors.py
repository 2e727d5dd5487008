"""Embedding similarity, separability, confounds and clustering."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import dot

STRIDES = (499, 997, 1499, 1999, 2503)  # fixed offsets of the impostor pairs
RANGES = 64  #: ranges of the key in which positions are counted
BLOCK, CELL = 2_000_000, 4_000_000  #: numbers in a block of vectors of a search, distances at once
AT_ONCE = 1_000_000  #: numbers of open clusters that average linkage ends with on the driver


def half_similarity(first: Column, second: Column) -> Column:
    return F.least(F.greatest(dot(first, second), F.lit(-1.0)), F.lit(1.0))


def numbered(rows: DataFrame, key: str, *ties: str) -> tuple[DataFrame, int]:
    """Rows with their place i in the order of the key, then of ``ties``, from 0, and their number; rows without a key come last.

    The place is counted within ranges of the key and shifted by their sizes. The ranges' ends are taken once and
    stand in the plan: Spark samples anew for each plan that deals by range, so two plans disagree on the ends.
    """
    ranged = rows.where(F.col(key).isNotNull()).select(key).repartitionByRange(RANGES, key).groupBy(F.spark_partition_id().alias("p"))
    ends = ranged.agg(F.max(key).alias("last"), F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row a range
    n = sum(r["n"] for r in ends) + rows.where(F.col(key).isNull()).count()
    before = F.array(*(F.lit(b).cast("long") for b in itertools.accumulate((r["n"] for r in ends), initial=0)))
    lasts = F.array(*(F.lit(r["last"]) for r in ends)) if ends else F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>")
    part = F.when(F.col(key).isNull(), len(ends)).otherwise(F.size(F.filter(lasts, lambda end: end < F.col(key))))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(F.asc_nulls_last(key), *ties)) - 1
    return rows.withColumn("__p", part).withColumn("i", inside + before[F.col("__p")]).drop("__p"), n


def impostor_pairs(rows: DataFrame, key: str, vector: str, strides: tuple[int, ...] = STRIDES) -> DataFrame:
    """Each row with the rows some strides further on in key order, wrapping: key, other, stride, similarity.

    Strides that are multiples of the row count would pair rows with themselves and are left out.
    Rows of equal keys are ordered by vector.
    """
    placed, n = numbered(rows.select(key, vector), key, vector)
    wanted = [s for s in strides if n and s % n]
    if not wanted:
        return placed.select(key, F.col(key).alias("other"), F.lit(0).alias("stride"), F.lit(0.0).alias("similarity")).limit(0)
    left = placed.withColumn("stride", F.explode(F.array(*(F.lit(s) for s in wanted)))).withColumn("j", (F.col("i") + F.col("stride")) % n)
    right = placed.select(F.col("i").alias("j"), F.col(key).alias("other"), F.col(vector).alias("__v"))
    return left.join(right, "j").select(key, "other", "stride", half_similarity(F.col(vector), F.col("__v")).alias("similarity"))


def cluster_quality(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """Mean similarity of unit vectors within and between clusters, over all pairs, from the clusters' vector sums.

    The sum of a cluster's pairs is |its vector sum| squared less its self-pairs; no pair is ever made.
    """
    long = rows.select(cluster, F.posexplode(vector).alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    sums = long.groupBy(cluster, "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    own = sums.groupBy(cluster).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"))
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    within = own.join(sizes, cluster).agg(F.sum(F.col("ss") - F.col("qq")).alias("w"), F.sum(F.col("n") * (F.col("n") - 1)).alias("wn"), F.sum("n").alias("n"), F.sum("qq").alias("qq"))
    whole = sums.groupBy("d").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("t"))
    all_ = within.crossJoin(F.broadcast(whole))  # one row each
    pairs = F.col("n") * (F.col("n") - 1)
    return all_.select(
        F.try_divide("w", "wn").alias("within"),
        F.try_divide(F.col("t") - F.col("qq") - F.col("w"), pairs - F.col("wn")).alias("between"),
    )


def text_confound(rows: DataFrame, cluster: str, text: str) -> DataFrame:
    """Rates of same-text pairs overall and within clusters, and their ratio."""
    pairs = lambda n: n * (n - 1) / 2
    both = rows.groupBy(cluster, text).agg(F.count(F.lit(1)).alias("n"))
    same_in = both.groupBy(cluster).agg(F.sum(pairs(F.col("n"))).alias("same"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    inside = same_in.agg(F.sum("same").alias("same_in"), F.sum(pairs(F.col("n"))).alias("pairs_in"), F.avg((F.col("texts") > 1).cast("double")).alias("multi_text"))
    whole = both.groupBy(text).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("same_all"), F.sum("n").alias("n"))
    rates = inside.crossJoin(F.broadcast(whole)).select(F.try_divide("same_all", pairs(F.col("n"))).alias("base_rate"), F.try_divide("same_in", "pairs_in").alias("cluster_rate"), "multi_text")
    return rates.withColumn("lift", F.try_divide("cluster_rate", "base_rate"))


def nearest_centroid(rows: DataFrame, key: str, vector: str, centroids: DataFrame) -> DataFrame:
    """The nearest of a few centroids (at most 1,000, sent to all) and the margin to the second: key, centroid, distance, confidence."""
    table = centroids.select("centroid", "center").limit(1001).collect()
    if len(table) > 1000:
        raise ValueError("more than 1000 centroids; use a nearest-neighbour search")
    distance = F.array(*(F.struct(F.sqrt(F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(v)) for v in r["center"])), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v)).alias("distance"), F.lit(r["centroid"]).alias("centroid")) for r in table))
    near = rows.select(key, F.array_sort(distance).alias("d"))
    second = F.try_element_at("d", F.lit(2))["distance"]
    return near.select(key, F.col("d")[0]["centroid"].alias("centroid"), F.col("d")[0]["distance"].alias("distance"), F.coalesce(F.try_divide(second - F.col("d")[0]["distance"], second), F.lit(1.0)).alias("confidence"))


def centroids_of(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    long = rows.select(cluster, F.posexplode(vector).alias("d", "x")).groupBy(cluster, "d").agg(F.avg("x").alias("m"))
    return long.groupBy(F.col(cluster).alias("centroid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("center"))


def nearest(ids: np.ndarray, own: np.ndarray, others: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``ids`` with mean vectors ``own`` the nearest of ``others`` with ``means``, itself not: distance, tie, id.

    Distances are rounded to 12 digits, so that they do not depend on how products are blocked. Of equally near ones the
    smallest hash of the pair counts (the tie): with one favourite for all, a round could join one pair only.
    """
    far, tie, near = np.full(len(ids), np.inf), np.zeros(len(ids), np.int64), np.full(len(ids), -1)
    step = max(1, CELL // max(1, len(others)))
    for a in range(0, len(ids) if len(others) else 0, step):
        mine = ids[a : a + step]
        distance = np.round(np.clip(1 - own[a : a + step] @ means.T, 0, 2), 12)
        distance[mine[:, None] == others] = np.inf
        least = distance.min(1)
        row, column = np.nonzero(distance == least[:, None])
        low, high = (f(mine[row], others[column]).astype(np.uint64) for f in (np.minimum, np.maximum))
        mixed = (low * np.uint64(0x9E3779B97F4A7C15) ^ high) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)).astype(np.int64)
        best = np.lexsort((others[column], mixed, row))
        best = best[np.r_[True, row[best][1:] != row[best][:-1]]]
        far[a : a + step], tie[a : a + step], near[a : a + step] = least, mixed[best], others[column[best]]
    near[np.isinf(far)] = -1
    return far, tie, near


def average_linkage(ids: np.ndarray, sums: np.ndarray, sizes: np.ndarray, most: float) -> dict[int, int]:
    """The joins of average linkage on cosine distance up to ``most``, from clusters of unit vectors given by their sums: id -> the id it ends in.

    The mean distance of two clusters is 1 less the product of their mean vectors. Two that are each other's nearest
    are joined in any order (a joined cluster is never nearer to a third than its nearer part was), so each round joins all
    such pairs, searches anew only for those whose nearest was joined, and leaves out those that have nothing within ``most``.
    """
    most = round(most, 12)
    into: dict[int, int] = {}
    far, near = np.full(len(ids), np.inf), np.full(len(ids), -1)
    while len(ids) > 1:
        ask, means = np.flatnonzero(near < 0), sums / sizes[:, None]
        far[ask], _, near[ask] = nearest(ids[ask], means[ask], ids, means)
        stay = (far <= most) & (near >= 0)
        if not stay.any():
            break
        ids, sums, sizes, far, near = (x[stay] for x in (ids, sums, sizes, far, near))
        order = np.argsort(ids)
        at = order[np.searchsorted(ids[order], near)]  # whose nearest stays, stays
        mutual = at[at] == np.arange(len(ids))
        low = np.flatnonzero(mutual & (ids < near))
        high = at[low]
        if not len(low) and len(ask) == len(stay):
            raise AssertionError("no two clusters are each other's nearest")
        lost = mutual | mutual[at] if len(low) else np.ones(len(ids), bool)  # ties of older searches can go round: search all again
        into.update(zip(ids[high].tolist(), ids[low].tolist(), strict=True))
        sums[low] += sums[high]
        sizes[low] += sizes[high]
        near[lost] = -1
        rest = np.ones(len(ids), bool)
        rest[high] = False
        ids, sums, sizes, far, near = (x[rest] for x in (ids, sums, sizes, far, near))
    for k in sorted(into):  # a smaller id always
        into[k] = into.get(into[k], into[k])
    return into


def kept(df: DataFrame) -> DataFrame:
    """The rows computed once: in the session's checkpoint folder, or on the executors where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return np.array(column.combine_chunks().flatten(), float).reshape(rows, -1)


def search(state: DataFrame, ask: DataFrame, numbers: int, asked: int) -> DataFrame:
    """``nearest`` of the clusters ``ask`` among all of ``state``, in a grid of blocks of bounded size: c, found (far, tie, near)."""
    columns, queries = (max(1, -(-k // BLOCK)) for k in (numbers, asked))
    mean = F.transform("s", lambda x: x / F.col("n")).alias("m")
    block = lambda k: F.pmod(F.xxhash64("c"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = ask.select("c", mean, F.lit(True).alias("q"), block(queries).alias("a"), every(columns).alias("b"))
    right = state.select("c", mean, F.lit(False).alias("q"), every(queries).alias("a"), block(columns).alias("b"))

    def best(table: pa.Table) -> pa.Table:
        q = np.array(table.column("q"))
        c, m = np.array(table.column("c")), matrix(table.column("m"), len(q))
        far, tie, near = nearest(c[q], m[q], c[~q], m[~q])
        return pa.table({"c": c[q], "far": far, "tie": tie, "near": near})

    cells = left.unionByName(right).groupBy("a", "b").applyInArrow(best, "c long, far double, tie long, near long")
    return cells.groupBy("c").agg(F.min(F.struct("far", "tie", "near")).alias("found"))


def linkage_clusters(rows: DataFrame, key: str, vector: str, similarity: float, at_once: int = AT_ONCE) -> DataFrame:
    """Average-linkage clusters on cosine distance (clipped to 0 to 2), cut at 1 - similarity, numbered from the largest down, then by their first row in key order: key, cluster.

    ``average_linkage`` says how; equal directions are one cluster from the start. Rounds run on the executors while the clusters still open have over ``at_once``
    numbers, then on the driver. The search is quadratic in the rows by nature, memory is not. Rows whose vector is null, zero or holds null or
    non-finite components are clusters of their own.
    """
    if not 0 < similarity < 1:
        raise ValueError("similarity must be between 0 and 1")
    placed, count = numbered(rows.select(key, vector), key, vector)
    long = F.transform(vector, lambda x: x.cast("double"))
    most = F.array_max(F.transform(long, F.abs))
    sound = F.forall(long, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (most > 0)
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  (inside a lambda it would be worked out for each component)
    norm = lambda m: F.sqrt(F.aggregate(long, F.lit(0.0), lambda a, x: a + x / m * (x / m)))  # noqa: E731  (squares neither overflow nor vanish)
    unit = once(most, lambda m: once(norm(m), lambda r: F.transform(long, lambda x: x / m / r)))
    placed = kept(placed.select(key, "i", F.when(sound, unit).alias("z")))
    sizes = placed.where("z IS NOT NULL").agg(F.min(F.size("z")).alias("a"), F.max(F.size("z")).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        raise ValueError("vectors differ in length")
    width = sizes["b"] or 1
    unlike = placed.where("z IS NOT NULL").groupBy("z").agg(F.min("i").alias("c"), F.count(F.lit(1)).cast("double").alias("n"))
    state = kept(unlike.select("c", "n", "z", F.transform("z", lambda x: x * F.col("n")).alias("s"), F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("far")))
    ends = placed.join(state.select("z", "c"), "z", "left").select("i", F.coalesce("c", "i").alias("c"))
    state = state.drop("z")
    cut = round(1 - similarity, 12)
    while (clusters := state.count()) * width > at_once and clusters > 1:
        ask = state.where("near IS NULL")
        asked = ask.count()
        found = search(state, ask, clusters * width, asked * width)
        told = state.join(found, "c", "left").select("c", "n", "s", F.coalesce("near", "found.near").alias("near"), F.coalesce("far", "found.far").alias("far"))
        state = kept(told.where((F.col("far") <= cut) & (F.col("near") >= 0)))
        one, other = state.select(F.col("c").alias("low"), F.col("near").alias("high")), state.select(F.col("c").alias("high"), F.col("near").alias("low"), F.col("n").alias("n2"), F.col("s").alias("s2"))
        pairs = kept(one.join(other, ["low", "high"]).where("low < high"))
        if pairs.isEmpty():
            if state.isEmpty():
                break
            if asked == clusters:
                raise AssertionError("no two clusters are each other's nearest")
            state = state.withColumn("near", F.lit(None).cast("long")).withColumn("far", F.lit(None).cast("double"))
            continue
        ends = kept(ends.join(pairs.select(F.col("high").alias("c"), "low"), "c", "left").select("i", F.coalesce("low", "c").alias("c")))
        touched = pairs.select(F.explode(F.array("low", "high")).alias("near"), F.lit(True).alias("gone"))
        rest = state.join(pairs.select(F.col("high").alias("c")), "c", "left_anti").join(pairs.withColumnRenamed("low", "c"), "c", "left").join(touched, "near", "left")
        lost = F.col("gone").isNotNull() | F.col("high").isNotNull()
        joined = F.when(F.col("high").isNotNull(), F.zip_with("s", "s2", lambda x, y: x + y)).otherwise(F.col("s"))
        state = kept(rest.select("c", (F.col("n") + F.coalesce("n2", F.lit(0.0))).alias("n"), joined.alias("s"), F.when(~lost, F.col("near")).alias("near"), F.when(~lost, F.col("far")).alias("far")))
    last = state.select("c", "n", "s").orderBy("c").toArrow() if clusters * width <= at_once else None
    if last is not None and last.num_rows:
        into = average_linkage(np.array(last.column("c")), matrix(last.column("s"), last.num_rows), np.array(last.column("n")), 1 - similarity)
        if into:
            moved = rows.sparkSession.createDataFrame(pa.table({"c": list(into), "low": list(into.values())}))
            ends = ends.join(moved, "c", "left").select("i", F.coalesce("low", "c").alias("c"))
    ends = kept(ends)
    order = ends.groupBy("c").agg(((count - F.count(F.lit(1))) * count + F.min("i")).alias("order"))  # the largest first, then the first row
    ranked = numbered(order, "order")[0].select("c", F.col("i").cast("int").alias("cluster"))
    return placed.select(key, "i").join(ends, "i").join(ranked, "c").select(key, "cluster")


def k_means(rows: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """Standardised features (population spread), k-means and margin confidence: key, cluster, confidence."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    long = rows.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    scale = [(r["m"], r["s"] if r["s"] > 0 else 1.0) for r in long.orderBy("d").collect()]  # one row per dimension
    standard = F.array(*((F.col(vector)[i].cast("double") - m) / s for i, (m, s) in enumerate(scale)))
    scaled = rows.select(key, standard.alias("z"))
    model = KMeans(k=k, seed=seed, featuresCol="f", initSteps=5, maxIter=50).fit(scaled.select(array_to_vector("z").alias("f")))
    centers = rows.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "centroid int, center array<double>")
    return nearest_centroid(scaled, key, "z", centers).select(key, F.col("centroid").alias("cluster"), "confidence")


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings, from their contingency counts."""
    pairs = lambda n: n * (n - 1) / 2.0
    both = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    cells = both.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    one = both.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("a"))
    two = both.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("b"))
    flat = cells.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(two))
    expected = F.try_divide(F.col("a") * F.col("b"), pairs(F.col("n")))
    most = (F.col("a") + F.col("b")) / 2
    return flat.select(F.when(most == expected, 1.0).otherwise(F.try_divide(F.col("s") - expected, most - expected)).alias("ari"))
