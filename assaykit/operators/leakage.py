"""Overlap between splits, purging, and split assignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hash_fold
from ..schemas import DEV_FOLD, PROMPT_FOLDS, SPLIT_FRACTION, SPLIT_SLACK


def overlap(left: DataFrame, right: DataFrame, key: str, size: str) -> DataFrame:
    """How much of ``right`` has a key that occurs in ``left``: records, phones, distinct keys and the rates."""
    known = left.select(key).distinct().withColumn("seen", F.lit(True))
    marked = right.join(known, key, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    hit = F.col("seen")
    out = marked.agg(
        F.count(F.lit(1)).alias("records"),
        F.count(F.when(hit, 1)).alias("leaked_records"),
        F.coalesce(F.sum(size), F.lit(0)).alias("phones"),
        F.coalesce(F.sum(F.when(hit, F.col(size))), F.lit(0)).alias("leaked_phones"),
        F.countDistinct(F.when(hit, F.col(key))).alias("shared_keys"),
    )
    rates = {"record_rate": F.try_divide("leaked_records", "records"), "phone_rate": F.try_divide("leaked_phones", "phones")}
    return out.withColumns(rates)


def purge(fit: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Fit rows whose key does not occur in the held rows."""
    return fit.join(held.select(key).distinct(), key, "left_anti")


def seen_flags(rows: DataFrame, train: DataFrame, **keys: Column) -> DataFrame:
    """A boolean per key: whether train has it; keys may be arrays."""
    out = rows
    for name, key in keys.items():
        known = train.select(key.alias("__k")).distinct().withColumn(f"seen_{name}", F.lit(True))
        out = out.withColumn("__k", key).join(known, "__k", "left").drop("__k").withColumn(f"seen_{name}", F.coalesce(f"seen_{name}", F.lit(False)))
    return out


def with_prompt_split(rows: DataFrame, key: Column, folds: int = PROMPT_FOLDS, dev: int = DEV_FOLD) -> DataFrame:
    """prompt_fold and split fit / dev."""
    fold = hash_fold(key, folds)
    return rows.withColumn("prompt_fold", fold).withColumn("split", F.when(fold == dev, "dev").otherwise("fit"))


def set_difference_report(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: key, side (missing or extra)."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


def fold_report(rows: DataFrame, fold: str, group: str, key: str) -> DataFrame:
    """Per fold: held and train rows, groups, labels, prompts shared with the other folds."""
    per = rows.groupBy(fold).agg(F.count(F.lit(1)).alias("held_rows"), F.countDistinct(group).alias("held_groups"), *(F.count(F.when(F.col("label") == i, 1)).alias(f"held_{i}") for i in (0, 1, 2)))
    homes = rows.groupBy(key).agg(F.countDistinct(fold).alias("k"))
    shared = rows.select(fold, key).distinct().join(homes.where("k > 1"), key, "left_semi").groupBy(fold).agg(F.count(F.lit(1)).alias("shared_prompts"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    full = per.join(shared, fold, "left").crossJoin(F.broadcast(total))  # one row
    return full.select(fold, "held_rows", (F.col("total") - F.col("held_rows")).alias("train_rows"), "held_groups", "held_0", "held_1", "held_2", F.coalesce("shared_prompts", F.lit(0)).alias("shared_prompts"))


def functional_dependency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with several values: none if value depends on key."""
    return rows.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def assign_group_folds(counts: DataFrame, group: str, folds: int, seed: int = 0, most: int = 1_000_000) -> DataFrame:
    """Groups to folds with balanced label mixes: (group, fold).

    ``counts`` is one row per group (n_0, n_1, n_2). Groups go, from the most uneven down, to the
    fold that leaves the labels' shares over folds least spread; the number of groups is bounded
    because the loop runs in the driver. Folds are renumbered by their smallest group.
    """
    table = counts.select(group, "n_0", "n_1", "n_2").orderBy(group).limit(most + 1).toPandas()
    if len(table) > most:
        raise ValueError(f"more than {most} groups")
    n = table[["n_0", "n_1", "n_2"]].to_numpy(float)
    order = np.random.default_rng(seed).permutation(len(n))
    order = order[np.argsort(-n[order].std(1), kind="stable")]
    total, filled, chosen = np.maximum(n.sum(0), 1), np.zeros((folds, 3)), np.zeros(len(n), int)
    for g in order:
        spread = [np.std((filled + n[g] * (np.arange(folds) == k)[:, None]) / total, axis=0).mean() for k in range(folds)]
        best = min(range(folds), key=lambda k: (round(spread[k], 12), filled[k].sum()))
        filled[best] += n[g]
        chosen[g] = best
    names: dict[int, int] = {}
    canonical = [names.setdefault(int(k), len(names)) for k in chosen]
    return counts.sparkSession.createDataFrame([(table[group][i].item(), canonical[i]) for i in range(len(n))] or [], f"{group} {counts.schema[group].dataType.simpleString()}, fold int")


def speaker_split(counts: DataFrame, group: str, fraction: float = SPLIT_FRACTION, slack: float = SPLIT_SLACK, most: int = 100_000) -> DataFrame:
    """Groups for a held-out part of about ``fraction`` of all rows, label mix close to the whole: (group, step).

    Greedy: each step takes the group that brings the total-variation distance lowest (then the
    smallest id) without going over the budget times ``slack``; it ends at the target or when none fits.
    """
    table = counts.select(group, "n_0", "n_1", "n_2").orderBy(group).limit(most + 1).toPandas()
    if len(table) > most:
        raise ValueError(f"more than {most} groups")
    n = table[["n_0", "n_1", "n_2"]].to_numpy(float)
    whole, target = n.sum(0) / max(1.0, n.sum()), fraction * n.sum()
    taken, have, free = [], np.zeros(3), np.ones(len(n), bool)
    while have.sum() < target:
        after = have + n
        fits = free & (after.sum(1) <= slack * target) & (n.sum(1) > 0)
        if not fits.any():
            break
        distance = np.abs(after / np.maximum(after.sum(1, keepdims=True), 1) - whole).sum(1) / 2
        best = int(np.flatnonzero(fits)[np.argmin(np.round(distance[fits], 12))])
        taken.append(best)
        have, free[best] = have + n[best], False
    return counts.sparkSession.createDataFrame([(table[group][i].item(), k) for k, i in enumerate(taken)], f"{group} {counts.schema[group].dataType.simpleString()}, step int")
