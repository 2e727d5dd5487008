"""Weights, baselines, calibrators and group profiles from grouped aggregates.

Corpus-wide numbers are one-row frames; they are the only thing crossed with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schemas import CALIBRATOR_PSEUDO_COUNT, LABELS, PROFILE_PRIOR


def one_row(rows: DataFrame, *aggregates) -> DataFrame:
    return F.broadcast(rows.agg(*aggregates))


def power_law_weights(rows: DataFrame, alpha: float) -> DataFrame:
    """Class weights n ** -alpha, scaled so that the mean over rows is 1: label, n, weight."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    raw = F.pow(F.col("n").cast("double"), F.lit(-alpha))
    scale = counts.agg((F.sum("n") / F.sum(F.col("n") * raw)).alias("scale"), F.count(F.lit(1)).alias("classes"))
    sound = counts.crossJoin(F.broadcast(scale))
    return sound.select("label", "n", F.when(F.col("classes") == len(LABELS), raw * F.col("scale")).alias("weight"))


def record_sampling_weights(rows: DataFrame, record: str) -> DataFrame:
    """Per record the mean inverse frequency of its labels, scaled to mean 1."""
    counts = F.broadcast(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")))  # three rows
    per = rows.select(record, "label").join(counts, "label").groupBy(record).agg(F.avg(1 / F.col("n")).alias("raw"))
    return per.crossJoin(one_row(per, F.avg("raw").alias("mean"))).select(record, (F.col("raw") / F.col("mean")).alias("weight"))


def phone_baseline(train: DataFrame, phone: str, balanced: bool = False) -> DataFrame:
    """Per phone the (class-balanced) mean target in [0, 100], and the fallback for others (phone null)."""
    target = F.col("label") * 50.0
    w = F.lit(1.0)
    if balanced:
        counts = F.broadcast(train.groupBy("label").agg((1 / F.count(F.lit(1))).alias("__w")))
        train, w = train.join(counts, "label"), F.col("__w")
    mean = F.least(F.greatest(F.try_divide(F.sum(w * target), F.sum(w)), F.lit(0.0)), F.lit(100.0)).alias("baseline")
    return train.groupBy(phone).agg(mean).unionByName(train.agg(mean).withColumn(phone, F.lit(None).cast(train.schema[phone].dataType)))


def predict_phone_baseline(rows: DataFrame, baseline: DataFrame, phone: str) -> DataFrame:
    default = F.broadcast(baseline.where(F.col(phone).isNull()).select(F.col("baseline").alias("__default")))
    known = baseline.where(F.col(phone).isNotNull())
    return rows.join(known, phone, "left").crossJoin(default).withColumn("baseline", F.coalesce("baseline", "__default")).drop("__default")


def shrunk_residuals(rows: DataFrame, phone: str, score: str = "score", prior: float = CALIBRATOR_PSEUDO_COUNT) -> DataFrame:
    """Per phone the median of target - score, pulled to the overall median by n / (n + prior)."""
    residual = F.col("label") * 50.0 - F.col(score)
    per = rows.groupBy(phone).agg(F.count(F.lit(1)).alias("n"), F.median(residual).alias("median"))
    whole = one_row(rows, F.median(residual).alias("overall"))
    share = F.col("n") / (F.col("n") + prior)
    return per.crossJoin(whole).select(phone, "n", (share * F.col("median") + (1 - share) * F.col("overall")).alias("shift"))


def affine_fit(rows: DataFrame, x: str) -> DataFrame:
    """Least squares of the target on one feature: slope, intercept (null where x is constant)."""
    target, f = F.col("label") * 50.0, F.col(x)
    slope = F.try_divide(F.covar_pop(f, target), F.var_pop(f))
    return rows.agg(slope.alias("slope"), (F.avg(target) - slope * F.avg(f)).alias("intercept"))


def profiles(rows: DataFrame, speaker: str, phone: str, prior: float = PROFILE_PRIOR) -> DataFrame:
    """Every speaker and phone: n, total, posterior mean severity, reliability and pattern.

    Severity is (2 - label) / 2. The posterior pulls a speaker's mean to the phone's corpus mean; the
    pattern is its excess over that mean less the speaker's common mode, times the root of the reliability.
    """
    severity = (2 - F.col("label")) / 2.0
    own = rows.groupBy(speaker, phone).agg(F.count(F.lit(1)).alias("n"), F.sum(severity).alias("total"))
    corpus = own.groupBy(phone).agg((F.sum("total") / F.sum("n")).alias("mean"))
    grid = own.select(speaker).distinct().crossJoin(F.broadcast(corpus))  # phones are a fixed vocabulary
    full = grid.join(own, [speaker, phone], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "total": F.coalesce("total", F.lit(0.0))})
    posterior = (F.col("total") + prior * F.col("mean")) / (F.col("n") + prior)
    reliability = F.col("n") / (F.col("n") + prior)
    full = full.withColumns({"posterior": posterior, "reliability": reliability})
    excess, by = F.col("posterior") - F.col("mean"), Window.partitionBy(speaker)
    common = F.coalesce(F.try_divide(F.sum(F.col("reliability") * excess).over(by), F.sum("reliability").over(by)), F.lit(0.0))
    return full.withColumn("pattern", (excess - common) * F.sqrt("reliability")).drop("mean")


def leave_one_out(rows: DataFrame, speaker: str, phone: str, utterance: str, prior: float = PROFILE_PRIOR) -> DataFrame:
    """Per utterance and phone the speaker's posterior with the utterance's own rows taken out of speaker and corpus."""
    severity = (2 - F.col("label")) / 2.0
    one = rows.groupBy(speaker, utterance, phone).agg(F.count(F.lit(1)).alias("n"), F.sum(severity).alias("s"))
    who = one.groupBy(speaker, phone).agg(F.sum("n").alias("sn"), F.sum("s").alias("ss"))
    all_ = F.broadcast(one.groupBy(phone).agg(F.sum("n").alias("cn"), F.sum("s").alias("cs")))
    j = one.join(who, [speaker, phone]).join(all_, phone)
    mean = F.try_divide(F.col("cs") - F.col("s"), F.col("cn") - F.col("n"))
    n = F.col("sn") - F.col("n")
    return j.select(speaker, utterance, phone, ((F.col("ss") - F.col("s") + prior * F.coalesce(mean, F.lit(0.0))) / (n + prior)).alias("posterior"), n.alias("n_left"))


def z_scores(rows: DataFrame, value: str) -> DataFrame:
    """Population z-score; a spread of 1e-8 or less counts as 1."""
    stats = one_row(rows, F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return rows.crossJoin(stats).withColumn("z", (F.col(value) - F.col("__m")) / F.when(F.col("__s") <= 1e-8, 1.0).otherwise(F.col("__s"))).drop("__m", "__s")


def effective_count(rows: DataFrame, group: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Inverse concentration of rows over groups: (sum n)^2 / sum n^2."""
    n = rows.groupBy(*by, group).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), (F.pow(F.sum("n"), 2) / F.sum(F.col("n") * F.col("n"))).alias("effective"))


def explained_by_groups(rows: DataFrame, group: str, value: str) -> DataFrame:
    """1 - within / total sum of squares."""
    per = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    within, between = F.sum(F.col("n") * F.col("v")), F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * mean * mean
    return per.agg(F.try_divide(between, within + between).alias("eta_squared"))


def total_variation(rows: DataFrame, part, column: str = "label") -> DataFrame:
    """Half the summed difference between the part's and the whole's mix of a column."""
    counts = rows.groupBy(column).agg(F.count(F.when(part, 1)).alias("p"), F.count(F.lit(1)).alias("q"))
    total = one_row(counts, F.sum("p").alias("tp"), F.sum("q").alias("tq"))
    return counts.crossJoin(total).agg((F.sum(F.abs(F.try_divide("p", "tp") - F.try_divide("q", "tq"))) / 2).alias("distance"))


def value_summary(rows: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """count, min, p05, median, p95, max, mean; exact percentiles."""
    q = F.percentile(column, [0.05, 0.5, 0.95])
    out = rows.groupBy(*by).agg(F.count(column).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"), q.alias("q"))
    return out.select(*by, "n", "low", F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"), "high", "mean")
