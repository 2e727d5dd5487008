"""Record sets and row-aligned comparisons: keys, selections, matches, differences and per-record summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def finite_mean(column: str) -> Column:
    """The mean of the finite values, null if there are none."""
    return F.avg(F.when(~F.isnan(column) & (F.abs(F.col(column)) < float("inf")), F.col(column)))


def mean_over_seeds(rows: DataFrame, by: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Means of metric columns over the seeds of each group; seeds without a finite value are skipped."""
    return rows.groupBy(*by).agg(*(finite_mean(c).alias(c) for c in columns), F.count(F.lit(1)).alias("seeds"))


def average_scores(rows: DataFrame, columns: tuple[str, ...], name: str = "averaged") -> DataFrame:
    """The elementwise mean of several score columns; null where one of them is."""
    return rows.withColumn(name, sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns))


def record_summary(rows: DataFrame, record: tuple[str, ...], value: str) -> DataFrame:
    """Count, mean, least and greatest value of each record."""
    return rows.groupBy(*record).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def paired_differences(rows: DataFrame, by: tuple[str, ...], candidate: str, baseline: str) -> DataFrame:
    """Mean difference, and how many rows rise, fall and stay."""
    d = F.col(candidate) - F.col(baseline)
    return rows.groupBy(*by).agg(F.avg(d).alias("mean_difference"), *(F.count(F.when(c, 1)).alias(n) for n, c in (("higher", d > 0), ("lower", d < 0), ("equal", d == 0))))


def top_by_magnitude(rows: DataFrame, by: tuple[str, ...], value: str, tie: str, k: int) -> DataFrame:
    """The k rows of each group with the largest absolute value, ties to the smaller ``tie``."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.abs(F.col(value))), F.asc(tie))
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def chunked(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], size: int) -> DataFrame:
    """The group's rows in order, cut into chunks of ``size``; the last one may be shorter."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("chunk", F.floor((place - 1) / size).cast("long"))


def next_in_cycle(rows: DataFrame, by: tuple[str, ...], order: str, name: str = "next") -> DataFrame:
    """What a cursor finds after each row; after the last one the first."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn(name, F.coalesce(F.lead(order).over(w), F.min(order).over(Window.partitionBy(*by))))


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; no rows if the sets are disjoint, as they must be."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def multiset_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that do not occur equally often on both sides, with both counts; no rows if the multisets are equal."""
    both = left.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy(key).agg(F.sum("a").alias("left_count"), F.sum("b").alias("right_count")).where("left_count <> right_count")


def same_rows(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are on the left alone, on the right alone, on both sides, and whether the sets are equal."""
    both = left.select(key).distinct().withColumn("__l", F.lit(1)).join(right.select(key).distinct().withColumn("__r", F.lit(1)), key, "full")
    n = both.agg(F.count(F.when(F.col("__r").isNull(), 1)).alias("left_only"), F.count(F.when(F.col("__l").isNull(), 1)).alias("right_only"), F.count(F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), 1)).alias("both"))
    return n.withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def compare_values(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """One row: aligned rows, the largest absolute difference, rows beyond the tolerance, keys without a partner."""
    both = left.select(key, F.col(value).alias("__l"), F.lit(1).alias("__a")).join(right.select(key, F.col(value).alias("__r"), F.lit(1).alias("__b")), key, "full")
    gap, aligned = F.abs(F.col("__l") - F.col("__r")), F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return both.agg(F.count(F.when(aligned, 1)).alias("aligned"), F.max(gap).alias("largest"), F.count(F.when(gap > tolerance, 1)).alias("beyond"), F.count(F.when(~aligned, 1)).alias("unpaired"))


def suffix_matches(rows: DataFrame, path: str, keys: DataFrame, key: str) -> DataFrame:
    """Each path with the key that is a suffix of its parts: matched, missing or ambiguous. An equi join on suffixes, whose number a path's depth bounds."""
    parts = F.split(path, "/")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, i, F.size(parts))))
    known = keys.select(F.col(key).alias("__suffix")).distinct()
    hits = rows.select(path, F.explode(suffix).alias("__suffix")).join(known, "__suffix").groupBy(path).agg(F.count(F.lit(1)).alias("hits"), F.min("__suffix").alias("matched"))
    status = F.when(F.col("hits").isNull(), "missing").when(F.col("hits") == 1, "matched").otherwise("ambiguous")
    return rows.join(hits, path, "left").withColumn("status", status).withColumn("matched", F.when(F.col("hits") == 1, F.col("matched"))).drop("hits")


def first_known(rows: DataFrame, candidates: tuple[str, ...], keys: DataFrame, key: str, value: str, row_id: str) -> DataFrame:
    """The value of the first of several candidate keys that is known; null if none is."""
    each = F.posexplode(F.array(*(F.col(c) for c in candidates))).alias("place", "__key")
    known = keys.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    best = rows.select(row_id, each).join(known, "__key").groupBy(row_id).agg(F.min_by("__value", "place").alias("value"), F.min("place").alias("place"))
    return rows.join(best, row_id, "left")


def selection(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows by key in the caller's order; an unknown key keeps its place with ``known`` false."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(wanted)], f"place int, {key} {dict(rows.dtypes)[key]}")
    return F.broadcast(asked).join(rows.withColumn("known", F.lit(True)), key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def first_mismatch(left: Column, right: Column) -> Column:
    """The first place (from 0) at which two arrays differ, one being longer included; null if they are equal."""
    shorter, longer = F.least(F.size(left), F.size(right)), F.greatest(F.size(left), F.size(right))
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    unlike = F.filter(places, lambda i: ~F.get(left, i).eqNullSafe(F.get(right, i)))
    return F.coalesce(F.get(unlike, F.lit(0)), F.when(longer > shorter, shorter))


def link(centre: Column, raw_gap: Column) -> tuple[Column, Column, Column]:
    """Cumulative probabilities q1 >= q2 around a centre, apart by a positive gap, and the score they give."""
    logistic = lambda x: 1 / (1 + F.exp(-x))
    gap = F.log1p(F.exp(raw_gap))
    q1, q2 = logistic(centre + gap / 2), logistic(centre - gap / 2)
    return q1, q2, 50 * (q1 + q2)


def rotations(rows: DataFrame, fold: str, folds: int) -> DataFrame:
    """Each row's part in each rotation: test in that of its own fold, calibration in the one before, fit otherwise."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("rotation")
    out = rows.select("*", turn)
    part = F.when(F.col("rotation") == F.col(fold), "test").when(F.pmod(F.col("rotation") + 1, F.lit(folds)) == F.col(fold), "calibration").otherwise("fit")
    return out.withColumn("part", part)


def sequence_digest(domain: str, lines: Column) -> Column:
    """A digest of an array of strings in order; the domain and the lengths keep unlike inputs apart."""
    framed = F.transform(lines, lambda s: F.concat(F.octet_length(s).cast("string"), F.lit(":"), s, F.lit("\n")))
    return F.sha2(F.concat(F.lit(f"{domain}\n"), F.array_join(framed, "")), 256)


def domain_violations(rows: DataFrame, score: str, low: float, high: float) -> DataFrame:
    """One row: scores that are null, not finite, below and above the domain."""
    x = F.col(score)
    tests = {"missing": x.isNull(), "not_finite": F.isnan(x) | (F.abs(x) == float("inf")), "below": x < low, "above": (x > high) & ~F.isnan(x)}
    return rows.agg(F.count(F.lit(1)).alias("rows"), *(F.count(F.when(t, 1)).alias(n) for n, t in tests.items()))


def token_report(rows: DataFrame, text: str, vocabulary: tuple[str, ...], most: int) -> DataFrame:
    """Tokens between white space: their number, whether they are too many, and the places (from 1) of unknown ones."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    marked = F.transform(tokens, lambda t, i: F.when(~t.isin(*vocabulary), i + 1))
    return rows.withColumn("n_tokens", F.size(tokens).cast("long")).withColumn("too_many", F.col("n_tokens") > most).withColumn("unknown", F.filter(marked, lambda i: i.isNotNull()))
