"""Ordinal quality metrics from one wide aggregate.

Everything but the rank correlation follows from a 3 x 3 table of counts and absolute-error
sums, so a report over any grouping is one shuffle of a few numbers per group.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import CLASS_THRESHOLDS, LABELS

K = len(LABELS)


def classify(score: Column, low: float = CLASS_THRESHOLDS[0], high: float = CLASS_THRESHOLDS[1]) -> Column:
    """0 under ``low``, 1 under ``high``, else 2."""
    if not 0 <= low < high <= 100:
        raise ValueError("thresholds must satisfy 0 <= low < high <= 100")
    return F.when(score < low, 0).when(score < high, 1).otherwise(2)


def cells(label: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """The aggregates n_00 ... n_22."""
    one = F.lit(1) if weight is None else weight
    return [F.sum(F.when((label == i) & (predicted == j), one).otherwise(0)).alias(f"n_{i}{j}") for i in LABELS for j in LABELS]


def _n(i: int, j: int) -> Column:
    return F.col(f"n_{i}{j}")


def _sum(columns) -> Column:
    return reduce(add, columns)


def row_total(i: int) -> Column:
    return _sum(_n(i, j) for j in LABELS)


def column_total(j: int) -> Column:
    return _sum(_n(i, j) for i in LABELS)


def mean_of_present(values: list[Column]) -> Column:
    """The mean of those that are not null."""
    present = _sum(F.when(v.isNotNull(), 1).otherwise(0) for v in values)
    return F.try_divide(_sum(F.coalesce(v, F.lit(0.0)) for v in values), present)


def weighted_kappa(degenerate: str = "nan") -> Column:
    """Quadratic-weighted kappa of the cells; what no expected disagreement gives is the caller's choice.

    ``nan``, ``zero`` and ``null`` give 1 where nothing was observed either; ``always_nan`` never does.
    """
    weight = {(i, j): ((i - j) / (K - 1)) ** 2 for i in LABELS for j in LABELS}
    total = _sum(row_total(i) for i in LABELS)
    observed = _sum(_n(i, j) * w for (i, j), w in weight.items())
    expected = F.try_divide(_sum(row_total(i) * column_total(j) * w for (i, j), w in weight.items()), total)
    edge = {"nan": F.lit(float("nan")), "zero": F.lit(0.0), "null": F.lit(None).cast("double"), "always_nan": F.lit(float("nan"))}[degenerate]
    flat = edge if degenerate == "always_nan" else F.when(observed == 0, 1.0).otherwise(edge)
    empty = F.lit(None).cast("double") if degenerate == "null" else F.lit(float("nan"))
    return F.when(total == 0, empty).when(expected == 0, flat).otherwise(1 - F.try_divide(observed, expected))


def f1(i: int) -> Column:
    """0 for a class that is neither labelled nor predicted."""
    return F.coalesce(F.try_divide(2 * _n(i, i), row_total(i) + column_total(i)), F.lit(0.0))


def ordinal_metrics(rows: DataFrame, by: tuple[str, ...] = (), score: str = "score", low: float = CLASS_THRESHOLDS[0], high: float = CLASS_THRESHOLDS[1]) -> DataFrame:
    """Per group: n_phones, balanced_mae, mae, qwk, macro_f1, balanced_accuracy, class_recall_*, class_mae_*.

    Classes without rows are left out of the balanced means but count as F1 zero; undefined values are null.
    """
    label, x = F.col("label"), F.col(score)
    error = F.abs(x - label * 50.0)
    sums = [F.sum(F.when(label == i, error).otherwise(0.0)).alias(f"e_{i}") for i in LABELS]
    wide = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_phones"), *cells(label, classify(x, low, high)), *sums)
    recall = [F.try_divide(_n(i, i), row_total(i)) for i in LABELS]
    mae = [F.try_divide(F.col(f"e_{i}"), row_total(i)) for i in LABELS]
    return wide.select(
        *by,
        "n_phones",
        mean_of_present(mae).alias("balanced_mae"),
        F.try_divide(_sum(F.col(f"e_{i}") for i in LABELS), F.col("n_phones")).alias("mae"),
        F.nanvl(weighted_kappa(), F.lit(None).cast("double")).alias("qwk"),
        (_sum(f1(i) for i in LABELS) / K).alias("macro_f1"),
        mean_of_present(recall).alias("balanced_accuracy"),
        *(r.alias(f"class_recall_{i}") for i, r in enumerate(recall)),
        *(m.alias(f"class_mae_{i}") for i, m in enumerate(mae)),
    )


def confusion(rows: DataFrame, by: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """Long confusion table with zero cells filled in: label, predicted, n."""
    wide = rows.groupBy(*by).agg(*cells(F.col("label"), classify(F.col(score))))
    every = F.array(*(F.struct(F.lit(i).alias("label"), F.lit(j).alias("predicted"), _n(i, j).alias("n")) for i in LABELS for j in LABELS))
    return wide.select(*by, F.inline(every))


def categorical_report(rows: DataFrame, by: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """Per class: support, precision, recall and F1, 0 where undefined."""
    wide = rows.groupBy(*by).agg(*cells(F.col("label"), classify(F.col(score))))
    zero = F.lit(0.0)
    each = F.array(
        *(
            F.struct(
                F.lit(i).alias("label"),
                row_total(i).alias("support"),
                F.coalesce(F.try_divide(_n(i, i), column_total(i)), zero).alias("precision"),
                F.coalesce(F.try_divide(_n(i, i), row_total(i)), zero).alias("recall"),
                f1(i).alias("f1"),
            )
            for i in LABELS
        )
    )
    return wide.select(*by, F.inline(each))


def pearson(x: Column, y: Column) -> Column:
    """Null for fewer than two rows or a constant side; clipped to [-1, 1]."""
    sound = (F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) > 1) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    covariance = F.covar_pop(x, y)
    r = F.try_divide(covariance, F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(sound & (n > 1), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def with_midranks(rows: DataFrame, column: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 1, ties sharing their mean.

    Counted on distinct values first, so only these are ranked and the rows never meet in one window.
    """
    counted = rows.groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))
    below = F.sum("__n").over(Window.partitionBy(*by).orderBy(column)) - F.col("__n")
    ranks = counted.select(*by, column, (below + (F.col("__n") + 1) / 2).alias(out))
    return rows.join(ranks, [*by, column])


def spearman(rows: DataFrame, left: str, right: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank correlation by midranks: spearman, null where a side is constant."""
    ranked = with_midranks(with_midranks(rows.select(*by, left, right), left, "__l", by), right, "__r", by)
    return ranked.groupBy(*by).agg(pearson(F.col("__l"), F.col("__r")).alias("spearman"))
