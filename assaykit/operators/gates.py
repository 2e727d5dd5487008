"""Pass and fail gates over metric differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# How much worse a candidate may be.
TOLERANCE = {"mae": 0.5, "qwk": -0.01, "macro_f1": -0.01, "spearman": -0.01, "class_recall_2": -0.02, "ece": 0.01}
LOWER_IS_BETTER = {"mae", "ece"}
MUST_RISE = ("class_recall_0", "class_recall_1")


def deltas(rows: DataFrame, arm: str, candidate: str, baseline: str, metrics: tuple[str, ...]) -> DataFrame:
    """One row per metric: candidate, baseline, delta; from one row per arm."""
    pick = lambda a, m: F.max(F.when(F.col(arm) == a, F.col(m)))
    wide = rows.agg(*(pick(a, m).alias(f"{k}_{m}") for m in metrics for k, a in (("c", candidate), ("b", baseline))))
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"c_{m}").alias("candidate"), F.col(f"b_{m}").alias("baseline")) for m in metrics))
    return wide.select(F.inline(each)).withColumn("delta", F.col("candidate") - F.col("baseline"))


def gates(changes: DataFrame) -> DataFrame:
    """(gate, value, tolerance, passed) per metric that has a gate; an undefined difference fails.

    Metrics of TOLERANCE may be so much worse; those of MUST_RISE have to be better.
    """
    limit = F.create_map(*(v for m, t in TOLERANCE.items() for v in (F.lit(m), F.lit(t))), *(v for m in MUST_RISE for v in (F.lit(m), F.lit(0.0))))[F.col("metric")]
    sound = F.when(~F.isnan("delta"), F.col("delta"))
    passed = F.when(F.col("metric").isin(*MUST_RISE), sound > limit).when(F.col("metric").isin(*LOWER_IS_BETTER), sound <= limit).otherwise(sound >= limit)
    return changes.where(F.col("metric").isin(*TOLERANCE, *MUST_RISE)).select(F.col("metric").alias("gate"), F.col("delta").alias("value"), limit.alias("tolerance"), F.coalesce(passed, F.lit(False)).alias("passed"))


def interval_gate(intervals: DataFrame, metric: str = "balanced_mae") -> DataFrame:
    """Passes if the whole interval of the metric's difference is below zero."""
    high = F.max(F.when((F.col("metric") == metric) & ~F.isnan("high"), F.col("high"))).alias("value")
    return intervals.agg(high).select(F.lit(f"{metric}_interval").alias("gate"), "value", F.lit(0.0).alias("tolerance"), F.coalesce(F.col("value") < 0, F.lit(False)).alias("passed"))


def every_seed_gate(errors: DataFrame, seed: str, candidate: str, baseline: str) -> DataFrame:
    """Passes if the candidate's error is below the baseline's in every seed; the value is the largest difference."""
    delta = F.col(candidate) - F.col(baseline)
    worst = errors.agg(F.max(F.when(~F.isnan(delta), delta)).alias("value"), F.count(F.lit(1)).alias("n"), F.count(F.when(~F.isnan(delta), 1)).alias("sound"))
    passed = F.coalesce((F.col("n") > 0) & (F.col("n") == F.col("sound")) & (F.col("value") < 0), F.lit(False))
    return worst.select(F.lit("every_seed").alias("gate"), "value", F.lit(0.0).alias("tolerance"), passed.alias("passed"))


def verdict(checked: DataFrame) -> DataFrame:
    return checked.agg(F.bool_and("passed").alias("accepted"), F.count(F.when(~F.col("passed"), 1)).alias("failed"))


def select_arm(rows: DataFrame, arm: str, passing: str, metric: str, baseline) -> DataFrame:
    """The passing arm of the lowest metric, else the baseline."""
    best = rows.agg(F.min_by(F.when(F.col(passing), F.col(arm)), F.when(F.col(passing), F.struct(F.col(metric), F.col(arm)))).alias("arm"))
    return best.select(F.coalesce("arm", F.lit(baseline)).alias("selected"))
