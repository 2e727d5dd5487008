"""Ordered operators: queues, samplers, thresholds, offsets and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import stable_order


def relabel_by_size(rows: DataFrame, label: str) -> DataFrame:
    """Labels to 0, 1, ... from the largest group down, ties by label: label, size, rank."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), label)) - 1)


def stable_sample(rows: DataFrame, key: Column, count: int, seed: int) -> DataFrame:
    """The first ``count`` rows of a hash order (the limit is the operator's meaning)."""
    return rows.withColumn("__order", stable_order(seed, key)).orderBy("__order", key).limit(count).drop("__order")


def disagreement_queue(rows: DataFrame, by: tuple[str, str], severity: str, key: str, limit: int, seed: int) -> DataFrame:
    """Interleaved queue: within each (label, phone) by falling severity then hash; phones take turns, then labels.

    Only the first ``limit`` of any cell can be taken, so each cell is cut there before the turns are dealt.
    """
    label, phone = by
    tie = stable_order(seed, F.col(key))
    cell = Window.partitionBy(label, phone).orderBy(F.desc(severity), tie, key)
    ranked = rows.withColumn("cell_rank", F.row_number().over(cell)).where(F.col("cell_rank") <= limit)
    turn = Window.partitionBy(label).orderBy("cell_rank", phone)
    ranked = ranked.withColumn("label_rank", F.row_number().over(turn)).where(F.col("label_rank") <= limit)
    place = F.row_number().over(Window.orderBy("label_rank", label))
    return ranked.orderBy("label_rank", label).limit(limit).withColumn("position", place)


def balanced_queue(rows: DataFrame, label: str, utterance: str, speaker: str, phone: str, index: str, priority: str, per_label: int) -> DataFrame:
    """Greedy top ``per_label`` of each label: one per utterance, the least used (speaker, phone) first, then the highest priority.

    Every row of an unused utterance is a candidate. What no pick can reach is left out first: rows of a
    cell after its first ``per_label`` utterances (picks use up fewer), and rows after 2 ``per_label`` - 1 better
    ones of different cells and utterances (one of which is always free and in an unused cell).
    """
    order = [F.desc(priority), F.asc(utterance), F.asc(index), F.asc(phone), F.asc(speaker)]
    once = Window.partitionBy(label, speaker, phone, utterance).orderBy(*order)
    cell = Window.partitionBy(label, speaker, phone).orderBy(*order)
    first = rows.withColumn("__k", F.row_number().over(once)).where("__k = 1").withColumn("__k", F.row_number().over(cell)).where(F.col("__k") <= per_label).drop("__k")
    heads = first.withColumn("__k", F.row_number().over(Window.partitionBy(label, utterance).orderBy(*order))).where("__k = 1")
    apart = heads.withColumn("__k", F.row_number().over(cell)).where("__k = 1").withColumn("__k", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
    last = apart.where(F.col("__k") == 2 * per_label - 1).select(label, F.col(priority).alias("__least"))
    near = first.join(F.broadcast(last), label, "left").where(F.col("__least").isNull() | (F.col(priority) >= F.col("__least"))).drop("__least")

    def pick(group):
        group = group.sort_values([priority, utterance, index, phone, speaker], ascending=[False, True, True, True, True])
        cells = list(zip(group[speaker], group[phone], strict=True))
        free, used, chosen = dict(enumerate(zip(group[utterance], cells, strict=True))), {}, []
        while free and len(chosen) < per_label:
            i = min(free, key=lambda k: (used.get(free[k][1], 0), k))
            taken, at = free[i]
            chosen.append(i)
            used[at] = used.get(at, 0) + 1
            free = {k: v for k, v in free.items() if v[0] != taken}
        return group.iloc[chosen].assign(position=range(1, len(chosen) + 1))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema)
    return near.groupBy(label).applyInPandas(pick, f"{kinds}, position int")


def equal_error(genuine: DataFrame, impostor: DataFrame, value: str) -> DataFrame:
    """The threshold at which false rejects and false accepts come closest (the lowest of equals): one row.

    Counted on distinct values; a value at the threshold is accepted.
    """
    g = genuine.select(F.col(value).alias("v"), F.lit(1).alias("g"), F.lit(0).alias("i"))
    i = impostor.select(F.col(value).alias("v"), F.lit(0).alias("g"), F.lit(1).alias("i"))
    counts = g.unionByName(i).groupBy("v").agg(F.sum("g").alias("g"), F.sum("i").alias("i"))
    below = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.broadcast(counts.agg(F.sum("g").alias("ng"), F.sum("i").alias("ni")))
    at = counts.select("v", F.coalesce(F.sum("g").over(below), F.lit(0)).alias("gb"), F.coalesce(F.sum("i").over(below), F.lit(0)).alias("ib")).crossJoin(whole)
    frr, far = F.try_divide("gb", "ng"), F.try_divide(F.col("ni") - F.col("ib"), F.col("ni"))
    rates = at.select("v", frr.alias("false_reject"), far.alias("false_accept"), F.abs(far - frr).alias("gap"))
    best = rates.agg(F.min_by(F.struct("v", "false_reject", "false_accept"), F.struct("gap", "v")).alias("b"))
    return best.select(F.col("b.v").alias("threshold"), F.col("b.false_reject").alias("false_reject"), F.col("b.false_accept").alias("false_accept"), ((F.col("b.false_reject") + F.col("b.false_accept")) / 2).alias("rate"))


def threshold_grid(rows: DataFrame, by: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """Per group the (low, high) of best macro-F1 on a half-point grid.

    low 5 ... 55, high max(45, low + 1) ... 95; ties go to the pair nearest (25, 75), then the lower.
    Rows become counts per class and half-point, so the grid meets 201 cells, not rows.
    """
    cell = F.least(F.greatest(F.floor(F.col(score) * 2).cast("int"), F.lit(0)), F.lit(200))  # a score at a threshold is not under it
    counts = rows.groupBy(*by, cell.alias("tick")).agg(*(F.sum(F.when(F.col("label") == i, 1).otherwise(0)).alias(f"c{i}") for i in (0, 1, 2)))
    per = counts.groupBy(*by).agg(*(F.map_from_entries(F.collect_list(F.struct("tick", f"c{i}"))).alias(f"m{i}") for i in (0, 1, 2)))  # 201 cells

    def under(counted):
        """How many are under each tick."""
        return F.transform(F.sequence(F.lit(0), F.lit(201)), lambda t: F.aggregate(F.filter(F.map_entries(counted), lambda e: e["key"] < t), F.lit(0).cast("long"), lambda a, e: a + e["value"]))

    per = per.select(*by, *(under(F.col(f"m{i}")).alias(f"u{i}") for i in (0, 1, 2)))
    lows = F.explode(F.sequence(F.lit(10), F.lit(110))).alias("lo")
    pairs = per.select("*", lows).select("*", F.explode(F.sequence(F.greatest(F.lit(90), F.col("lo") + 2), F.lit(190))).alias("hi"))
    under_lo = [F.col(f"u{i}")[F.col("lo")] for i in (0, 1, 2)]
    under_hi = [F.col(f"u{i}")[F.col("hi")] for i in (0, 1, 2)]
    total = [F.col(f"u{i}")[201] for i in (0, 1, 2)]
    hit = [under_lo[0], under_hi[1] - under_lo[1], total[2] - under_hi[2]]
    said = [under_lo[0] + under_lo[1] + under_lo[2], sum((under_hi[i] - under_lo[i] for i in (0, 1, 2)), F.lit(0)), sum((total[i] - under_hi[i] for i in (0, 1, 2)), F.lit(0))]
    f1 = sum((F.coalesce(F.try_divide(2 * hit[i], said[i] + total[i]), F.lit(0.0)) for i in (0, 1, 2)), F.lit(0.0)) / 3
    scored = pairs.select(*by, "lo", "hi", F.round(f1, 12).alias("f1"), (F.abs(F.col("lo") - 50) + F.abs(F.col("hi") - 150)).alias("away"))
    best = scored.groupBy(*by).agg(F.max_by(F.struct("lo", "hi", "f1"), F.struct("f1", -F.col("away"), -F.col("lo"), -F.col("hi"))).alias("b"))
    return best.select(*by, (F.col("b.lo") / 2).alias("low"), (F.col("b.hi") / 2).alias("high"), F.col("b.f1").alias("macro_f1"))


def record_offsets(rows: DataFrame, record: str, partition: Column) -> DataFrame:
    """How many rows come before each record in record order: record, n, offset.

    ``partition`` orders the records coarsely (such as record div 10000); sums of whole
    partitions are added to the running sums inside, so no window holds all records.
    """
    sizes = rows.groupBy(record).agg(F.count(F.lit(1)).alias("n")).withColumn("__p", partition)
    parts = sizes.groupBy("__p").agg(F.sum("n").alias("s"))
    before = parts.select("__p", (F.sum("s").over(Window.orderBy("__p")) - F.col("s")).alias("b"))
    inside = F.sum("n").over(Window.partitionBy("__p").orderBy(record)) - F.col("n")
    return sizes.withColumn("inside", inside).join(before, "__p").select(record, "n", (F.col("inside") + F.col("b")).alias("offset"))


def pack_batches(rows: DataFrame, key: str, duration: str, budget: float, most: int, bucket: int, partition: Column) -> DataFrame:
    """Batches of similar durations under a time and a size budget: (key, bucket, batch).

    Rows are ordered by duration and cut into buckets of ``bucket``; a bucket is packed in order, in one group.
    """
    import pandas as pd

    size = rows.select(key, duration, partition.alias("__p"))
    parts = size.groupBy("__p").agg(F.count(F.lit(1)).alias("s"))
    before = parts.select("__p", (F.sum("s").over(Window.orderBy("__p")) - F.col("s")).alias("b"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(duration, key)) - 1
    placed = size.withColumn("__i", place).join(before, "__p").withColumn("bucket", F.floor((F.col("__i") + F.col("b")) / bucket))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, duration))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([duration, key])
        batch, count, total, out = 0, 0, 0.0, []
        for d in group[duration]:
            if count and (count == most or total + d > budget):
                batch, count, total = batch + 1, 0, 0.0
            out.append(batch)
            count, total = count + 1, total + d
        return group.assign(batch=out)

    return placed.select(key, duration, "bucket").groupBy("bucket").applyInPandas(fill, f"{kinds}, bucket long, batch int")


def latest(rows: DataFrame, key: tuple[str, ...], *order: str) -> DataFrame:
    """The last row of each key by the order columns, without a window: what an upserting ledger shows."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(*key, "r.*")
