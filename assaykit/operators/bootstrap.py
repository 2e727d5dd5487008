"""Cluster bootstrap from additive statistics.

A resample of groups only reweights the groups' sums, so the rows are aggregated once to a few
numbers per group. Draws come from a seeded generator; replicates are matrix products of draw
counts and group sums, made in Arrow batches of replicates spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..schemas import CALIBRATION_BINS, CLASS_THRESHOLDS, LABELS
from .calibration import bin_of
from .metrics import cells, classify

METRICS = ("balanced_mae", "mae", "qwk", "macro_f1", "balanced_accuracy", "ece")
MOST_GROUPS = 100_000


def group_statistics(rows: DataFrame, group: str, score: str = "score", bins: int = CALIBRATION_BINS) -> DataFrame:
    """One row per group: cells, absolute-error sums by class, and bin counts and sums."""
    label, x = F.col("label"), F.col(score)
    error, where = F.abs(x - label * 50.0), bin_of(x / 100.0, bins)
    columns = cells(label, classify(x, *CLASS_THRESHOLDS))
    columns += [F.sum(F.when(label == i, error).otherwise(0.0)).alias(f"e_{i}") for i in LABELS]
    for b in range(bins):
        columns += [F.sum(F.when(where == b, 1).otherwise(0)).alias(f"b_{b}"), F.sum(F.when(where == b, x / 100.0 - label / 2.0).otherwise(0.0)).alias(f"g_{b}")]
    return rows.groupBy(F.col(group).alias("group")).agg(*columns)


def metrics_of(sums: np.ndarray, bins: int = CALIBRATION_BINS) -> np.ndarray:
    """Rows of summed statistics to METRICS; undefined ones are NaN."""
    n = sums[:, :9].reshape(-1, 3, 3)
    e, tail = sums[:, 9:12], sums[:, 12 : 12 + 2 * bins]
    support, predicted, hit = n.sum(2), n.sum(1), np.einsum("rii->ri", n)
    weight = (np.subtract.outer(np.arange(3), np.arange(3)) / 2.0) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = support.sum(1)
        mae = np.nanmean(np.where(support > 0, e / support, np.nan), axis=1)
        recall = np.nanmean(np.where(support > 0, hit / support, np.nan), axis=1)
        expected = np.einsum("ri,rj,ij->r", support, predicted, weight) / total
        observed = np.einsum("rij,ij->r", n, weight)
        kappa = np.where(expected == 0, np.nan, 1 - observed / expected)
        both = support + predicted
        f1 = np.where(both > 0, 2 * hit / both, 0.0).mean(1)
        ece = np.abs(tail[:, 1::2]).sum(1) / total
        return np.column_stack([mae, e.sum(1) / total, kappa, f1, recall, ece])


def drawn(groups: int, replicates: int, seed: int, first: int, last: int, batch: int = 256):
    """How often each group is drawn: one stream of multinomial draws in batches of ``batch`` replicates; yields (replicate, counts) of those that hold replicates ``first`` to ``last``."""
    rng, share = np.random.default_rng(seed), np.full(groups, 1 / groups)
    for k in range(0, min(replicates, last + 1), batch):
        counts = rng.multinomial(groups, share, size=min(batch, replicates - k))
        if k + len(counts) > first:
            yield k, counts


def draw_counts(groups: int, replicates: int, seed: int, batch: int = 256) -> np.ndarray:
    """All replicates' counts."""
    return np.concatenate([counts for _, counts in drawn(groups, replicates, seed, 0, replicates - 1, batch)])


def paired_bootstrap(rows: DataFrame, group: str, scores: tuple[str, str], replicates: int = 10_000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Per metric: candidate, baseline and delta estimates with percentile intervals of the delta.

    ``scores`` is (candidate, baseline). Groups, in ascending order, are at most ``MOST_GROUPS``
    (their statistics are what travels, not the rows).
    """
    stats = [group_statistics(rows, group, s) for s in scores]
    names = stats[0].columns[1:]
    joined = stats[0].join(stats[1].select("group", *(F.col(c).alias(f"o_{c}") for c in names)), "group").orderBy("group").limit(MOST_GROUPS + 1)
    table = joined.drop("group").toPandas().to_numpy(float)
    if len(table) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups to draw from; use coarser groups")
    spark, n = rows.sparkSession, len(table)
    width = len(names)
    kinds = "rep long, metric string, candidate double, baseline double"
    if not n:
        return spark.createDataFrame([], "metric string, candidate double, baseline double, delta double, low double, high double, n_valid long")

    def run(batches):
        wanted = np.concatenate([np.empty(0, np.int64), *(np.asarray(batch.column("id")) for batch in batches)])
        if not len(wanted):
            return
        for k, counts in drawn(n, replicates, seed, int(wanted.min()), int(wanted.max())):
            reps = wanted[(wanted >= k) & (wanted < k + len(counts))]
            draws = counts[reps - k].astype(float)
            a, b = (metrics_of(draws @ table[:, i * width : (i + 1) * width]) for i in (0, 1))
            flat = [pa.array(np.repeat(reps, len(METRICS))), pa.array(list(METRICS) * len(reps)), pa.array(a.ravel()), pa.array(b.ravel())]
            yield pa.RecordBatch.from_arrays(flat, ["rep", "metric", "candidate", "baseline"])

    samples = spark.range(replicates).mapInArrow(run, kinds).withColumn("delta", F.col("candidate") - F.col("baseline"))
    tail = (1 - confidence) / 2
    sound = F.when(~F.isnan("delta"), F.col("delta"))
    spread = samples.groupBy("metric").agg(F.percentile(sound, [tail, 1 - tail]).alias("ci"), F.count(sound).alias("n_valid"))
    point = [metrics_of(table[:, k * width : (k + 1) * width].sum(0, keepdims=True))[0] for k in (0, 1)]
    estimates = spark.createDataFrame([(m, float(a), float(b), float(a - b)) for m, a, b in zip(METRICS, *point, strict=True)], "metric string, candidate double, baseline double, delta double")
    return estimates.join(spread, "metric").select("metric", "candidate", "baseline", "delta", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"), "n_valid")
