"""Reports over reviews, models and partitions: blocks, bins, gates, joins of audit tables and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import metrics


def models_compared(rows: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Ordinal metrics of several score columns, one row per model; one scan, one shuffle."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in scores.items())))
    return metrics.ordinal_metrics(rows.select("label", each.alias("m")).select("label", "m.*"), ("model",))


def metric_blocks(rows: DataFrame, score: str = "score") -> DataFrame:
    """Ordinal metrics of all rows (block ``all``) and of each label's rows."""
    block = F.explode(F.array(F.lit("all"), F.concat(F.lit("label "), F.col("label").cast("string"))))
    return metrics.ordinal_metrics(rows.withColumn("block", block), ("block",), score)


def score_to_bin(x: Column) -> Column:
    """A score from 0 to 2 to its nearest label: below 0.5, below 1.5, others; null outside of the range."""
    return F.when((x < 0) | (x > 2) | F.isnan(x), None).when(x < 0.5, 0).when(x < 1.5, 1).when(x.isNotNull(), 2)


def role_violations(rows: DataFrame, record: str, role: str) -> DataFrame:
    """Records that are not exactly once ``test`` and once ``calibration``, with both counts."""
    n = [F.count(F.when(F.col(role) == r, 1)).alias(r) for r in ("test", "calibration")]
    return rows.groupBy(record).agg(*n).where("test <> 1 OR calibration <> 1")


def confident_disagreements(rows: DataFrame, by: tuple[str, ...], label: str, predicted: str, confidence: str, ids: tuple[str, ...], k: int) -> DataFrame:
    """The k rows of each group on which label and prediction differ, the most confident first, ties to the smaller ids."""
    order = Window.partitionBy(*by).orderBy(F.desc(confidence), *ids)
    differ = rows.where(F.col(label) != F.col(predicted))
    return differ.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def review_status(items: DataFrame, decisions: DataFrame, legacy: DataFrame, key: tuple[str, ...], old_key: str) -> DataFrame:
    """Items with ``status``: the decision on the whole key, else the one on the legacy key, else ``pending``.

    ``decisions`` and ``legacy`` have one row a key, and a status.
    """
    both = items.join(decisions.select(*key, F.col("status").alias("own")), list(key), "left")
    both = both.join(legacy.select(old_key, F.col("status").alias("old")), old_key, "left")
    return both.withColumn("status", F.coalesce("own", "old", F.lit("pending"))).drop("own", "old")


def filter_items(items: DataFrame, phones: list | None = None, label: int | None = None, flags: list[str] | None = None, status: str | None = None) -> DataFrame:
    """Items that meet every condition given; of several flags any one will do."""
    keep = F.lit(True)
    if phones is not None:
        keep &= F.col("phone").isin(phones)
    if label is not None:
        keep &= F.col("label") == label
    if flags is not None:
        keep &= F.arrays_overlap("flags", F.array(*map(F.lit, flags)))
    if status is not None:
        keep &= F.col("status") == status
    return items.where(keep)


def audit_rows(tasks: DataFrame, selection: DataFrame, judgments: DataFrame, model: DataFrame, rechecks: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Selected tasks with their judgment and model score, and the recheck where there is one; all sides by one key, so rows shuffle once."""
    out = tasks
    for side in (selection, judgments, model):
        out = out.join(side, list(key))
    return out.join(rechecks, list(key), "left")


def unblinded(ratings: DataFrame, key: DataFrame, reviewer: str, item: str, rating: str, truth: str) -> DataFrame:
    """Per reviewer: items rated, items missing, and agreement with the private key, null while any is missing.

    ``ratings`` has one row a reviewer and item; items that the key does not have are not counted.
    """
    total = key.agg(F.count(F.lit(1)).alias("total"))
    met = ratings.join(key.select(item, truth), item)
    by = met.groupBy(reviewer).agg(F.count(F.lit(1)).alias("rated"), F.avg((F.col(rating) == F.col(truth)).cast("double")).alias("rate"))
    return by.crossJoin(F.broadcast(total)).select(  # one row
        reviewer, "rated", (F.col("total") - F.col("rated")).alias("missing"), F.when(F.col("total") == F.col("rated"), F.col("rate")).alias("agreement")
    )


def preflight(rows: DataFrame, by: tuple[str, ...], transcript: Column, word_error: str, valid: Column, label: str) -> DataFrame:
    """Gates before a run: enough transcripts, small errors, valid rows, several labels, none of them nearly all."""
    n = F.count(F.lit(1))
    share = lambda c: F.count(F.when(c, 1)) / n
    labels = [F.count(F.when(F.col(label) == k, 1)) for k in metrics.LABELS]
    out = rows.groupBy(*by).agg(
        share(transcript).alias("transcripts"),
        F.percentile(word_error, 0.5).alias("median_error"),
        share(valid).alias("valid"),
        F.count_distinct(label).alias("labels"),
        (F.greatest(*labels) / n).alias("largest"),
    )
    passed = (F.col("transcripts") >= 0.8) & (F.col("median_error") <= 0.5) & (F.col("valid") >= 0.9) & (F.col("labels") >= 2) & (F.col("largest") <= 0.95)
    return out.withColumn("passed", F.coalesce(passed, F.lit(False)))


def weighting_report(rows: DataFrame, by: tuple[str, ...], weight: str, value: str) -> DataFrame:
    """Counts, total and mean weight, weighted mean of a value."""
    w = F.col(weight)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("total_weight"), F.avg(w).alias("mean_weight"), F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias("weighted_mean")
    )


def leakage_by_threshold(assigned: DataFrame) -> DataFrame:
    """Rows (threshold, cluster, held boolean) to one row a threshold: clusters, those on both sides, held records in them.

    Two aggregates, the first over clusters; nothing is joined.
    """
    sides = assigned.groupBy("threshold", "cluster").agg(F.count(F.when(F.col("held"), 1)).alias("held"), F.count(F.when(~F.col("held"), 1)).alias("fit"))
    both = (F.col("held") > 0) & (F.col("fit") > 0)
    return sides.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count(F.when(both, 1)).alias("shared_clusters"),
        F.sum(F.when(both, F.col("held")).otherwise(0)).alias("leaked_records"),
        F.sum("held").alias("held_records"),
    )


def inconsistent_reports(reports: DataFrame, total: str, parts: tuple[str, ...], rate: tuple[str, str], quantiles: tuple[str, ...], tolerance: float = 1e-9) -> DataFrame:
    """Reports whose parts do not add up, whose rate is not the first part's share, or whose quantiles fall; with ``problems``."""
    adds = sum((F.col(c) for c in parts[1:]), F.col(parts[0])) == F.col(total)
    right = F.abs(F.col(rate[0]) - F.try_divide(F.col(rate[1]).cast("double"), F.col(total))) <= tolerance
    rises = F.lit(True)
    for a, b in zip(quantiles, quantiles[1:]):
        rises &= F.col(a) <= F.col(b)
    found = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in (("sum", adds), ("rate", right), ("order", rises)))))
    return reports.withColumn("problems", found).where(F.size("problems") > 0)


def quick_selection(rows: DataFrame, cells: tuple[str, ...], group: str, order: tuple[str, ...], k: int) -> DataFrame:
    """k rows for a quick run: the first of each cell, then the first of each group not seen so far, then the first others.

    Ties of ``order`` are rows that cannot be told apart. Column ``step`` is 0, 1 or 2.
    """
    first = F.row_number().over(Window.partitionBy(*cells).orderBy(*order)) == 1
    marked = rows.withColumn("__first", first)
    seen = F.max("__first").over(Window.partitionBy(group))
    opening = F.row_number().over(Window.partitionBy(group).orderBy(*order)) == 1
    step = F.when(F.col("__first"), 0).when(~seen & opening, 1).otherwise(2)
    return marked.withColumn("step", step).drop("__first").orderBy("step", *order).limit(k)
