"""Rater agreement: intervals, alpha, pairwise agreement and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import LABELS, WILSON_Z


def wilson(successes: Column, total: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Score interval of a proportion, clamped to [0, 1]; null where total is 0."""
    p = F.try_divide(successes, total)
    wide = 1 + F.try_divide(F.lit(z * z), total)
    centre = p + F.try_divide(F.lit(z * z), 2 * total)
    reach = z * F.sqrt(F.try_divide(p * (1 - p), total) + F.try_divide(F.lit(z * z), 4 * total * total))
    low, high = F.try_divide(centre - reach, wide), F.when(successes == total, 1.0).otherwise(F.try_divide(centre + reach, wide))
    return F.when(total > 0, F.greatest(F.lit(0.0), low)), F.when(total > 0, F.least(F.lit(1.0), high))


def krippendorff_ordinal(ratings: DataFrame, item: str = "item", rating: str = "rating") -> DataFrame:
    """Ordinal alpha over units with two ratings or more: one row (n_units, n_ratings, alpha)."""
    counts = ratings.where(F.col(rating).isin(*LABELS)).groupBy(item).agg(*(F.count(F.when(F.col(rating) == i, 1)).alias(f"c{i}") for i in LABELS))
    m = F.col("c0") + F.col("c1") + F.col("c2")
    pair = [F.sum((F.col(f"c{i}") * (F.col(f"c{j}") - (1 if i == j else 0))) / (m - 1)).alias(f"o{i}{j}") for i in LABELS for j in LABELS]
    wide = counts.where(m > 1).agg(F.count(F.lit(1)).alias("n_units"), F.sum(m).alias("n_ratings"), *pair)
    n = [sum((F.col(f"o{i}{j}") for j in LABELS), F.lit(0.0)) for i in LABELS]
    total = n[0] + n[1] + n[2]
    distance = {}
    for i in LABELS:
        for j in LABELS:
            a, b = min(i, j), max(i, j)
            between = sum((n[g] for g in range(a, b + 1)), F.lit(0.0)) - (n[a] + n[b]) / 2
            distance[i, j] = F.pow(between, 2) if i != j else F.lit(0.0)
    observed = sum((F.col(f"o{i}{j}") * d for (i, j), d in distance.items()), F.lit(0.0))
    expected = F.try_divide(sum((n[i] * n[j] * d for (i, j), d in distance.items()), F.lit(0.0)), total - 1)
    return wide.select("n_units", "n_ratings", F.when(expected == 0, 1.0).otherwise(1 - F.try_divide(observed, expected)).alias("alpha"))


def pairwise_agreement(ratings: DataFrame, item: str = "item", rater: str = "rater", rating: str = "rating") -> DataFrame:
    """Each pair of raters: n items both rated, exact, exact_rate."""
    a = ratings.select(item, F.col(rater).alias("rater_a"), F.col(rating).alias("a"))
    b = ratings.select(item, F.col(rater).alias("rater_b"), F.col(rating).alias("b"))
    met = a.join(b, item).where("rater_a < rater_b").groupBy("rater_a", "rater_b")
    return met.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("exact")).withColumn("exact_rate", F.try_divide("exact", "n"))


def consensus(ratings: DataFrame, required: int, item: str = "item", rating: str = "rating") -> DataFrame:
    """The rating that over half of all required raters gave, else null."""
    votes = ratings.groupBy(item).agg(*(F.count(F.when(F.col(rating) == i, 1)).alias(f"c{i}") for i in LABELS))
    winner = F.coalesce(*(F.when(F.col(f"c{i}") * 2 > required, i) for i in LABELS))
    return votes.select(item, winner.alias("consensus"), (F.col("c0") + F.col("c1") + F.col("c2")).alias("n_ratings"))
