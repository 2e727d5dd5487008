"""Calibration curves over fixed-width bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import CALIBRATION_BINS


def bin_of(p: Column, bins: int) -> Column:
    """A value on an edge goes right, 1.0 stays in the last bin."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def curve(rows: DataFrame, prediction: Column, target: Column, by: tuple[str, ...] = (), bins: int = CALIBRATION_BINS) -> DataFrame:
    """Every bin of every group: n, mean_prediction, mean_target, gap; empty bins have nulls."""
    binned = rows.select(*by, prediction.alias("p"), target.alias("t")).groupBy(*by, bin_of(F.col("p"), bins).alias("bin"))
    have = binned.agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_prediction"), F.avg("t").alias("mean_target"))
    groups = have.select(*by).distinct() if by else have.sparkSession.range(1).select()
    every = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = every.join(have, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("gap", F.abs(F.col("mean_prediction") - F.col("mean_target")))


def errors(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected and largest calibration error of curves."""
    return points.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("n") * F.coalesce("gap", F.lit(0.0))), F.sum("n")).alias("ece"), F.max("gap").alias("max_calibration_error")
    )


def score_calibration(rows: DataFrame, score: str = "score", by: tuple[str, ...] = (), bins: int = CALIBRATION_BINS) -> DataFrame:
    """The curve of score / 100 against label / 2."""
    return curve(rows, F.col(score) / 100.0, F.col("label") / 2.0, by, bins)


def ordinal_calibration(rows: DataFrame, bins: int = CALIBRATION_BINS) -> DataFrame:
    """Per threshold 1 and 2 of cumulative probabilities q1, q2: prevalence, mean_probability, brier, ece, max_calibration_error."""
    each = F.array(*(F.struct(F.lit(k).alias("threshold"), F.col(f"q{k}").alias("p"), (F.col("label") >= k).cast("double").alias("t")) for k in (1, 2)))
    long = rows.select(F.inline(each))
    means = long.groupBy("threshold").agg(F.avg("t").alias("prevalence"), F.avg("p").alias("mean_probability"), F.avg(F.pow(F.col("p") - F.col("t"), 2)).alias("brier"))
    return means.join(errors(curve(long, F.col("p"), F.col("t"), ("threshold",), bins), ("threshold",)), "threshold")
