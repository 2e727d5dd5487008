"""Metric, calibration, weighting, ranking and gate queries.

Order lines stand for labelled tokens: the order is the utterance, the supplier the speaker, the part
the phone, the return flag the label, and quantity and discount two scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import bootstrap, calibration, gates as gate, leakage, metrics, ranking, weights
from ..operators.metrics import classify
from .registry import query

SOURCE = """WITH p AS (
  SELECT l_orderkey AS utterance_id, l_linenumber AS phone_index, l_suppkey AS speaker, CAST(l_partkey % 44 AS INTEGER) AS phone,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, (l_quantity - 1) * 100 / 49 AS score,
         l_discount * 1000 AS score_b, CAST(l_suppkey % 5 AS INTEGER) AS fold FROM lineitem
), c AS (SELECT *, CASE WHEN score < 25 THEN 0 WHEN score < 75 THEN 1 ELSE 2 END AS predicted, abs(score - label * 50.0) AS error FROM p)
"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled tokens of the order lines."""
    f = F.col("l_returnflag")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("utterance_id"),
        F.col("l_linenumber").alias("phone_index"),
        F.col("l_suppkey").alias("speaker"),
        (F.col("l_partkey") % 44).cast("int").alias("phone"),
        F.when(f == "A", 0).when(f == "N", 1).otherwise(2).alias("label"),
        ((F.col("l_quantity") - 1) * 100 / 49).alias("score"),
        (F.col("l_discount") * 1000).alias("score_b"),
        (F.col("l_suppkey") % 5).cast("int").alias("fold"),
    )


def rounded(rows: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, negative zero gone, so that sums in any order agree."""
    return rows.select(*((F.round(F.col(n), places) + F.lit(0.0)).alias(n) if k == "double" else F.col(n) for n, k in rows.dtypes))


def metric_sql(by: str = "", source: str = "c") -> str:
    """One block of ordinal metrics in SQL."""
    group, comma = (f"GROUP BY {by}", f"{by},") if by else ("", "")
    n = lambda i, j: f"n{i}{j}"
    cells = ", ".join(f"count(*) FILTER (WHERE label = {i} AND predicted = {j})::DOUBLE AS {n(i, j)}" for i in range(3) for j in range(3))
    errors = ", ".join(f"sum(error) FILTER (WHERE label = {i}) AS e{i}" for i in range(3))
    row = [f"({' + '.join(n(i, j) for j in range(3))})" for i in range(3)]
    column = [f"({' + '.join(n(i, j) for i in range(3))})" for j in range(3)]
    weight = [(i, j, ((i - j) / 2) ** 2) for i in range(3) for j in range(3) if i != j]
    seen = " + ".join(f"{w} * {n(i, j)}" for i, j, w in weight)
    due = " + ".join(f"{w} * {row[i]} * {column[j]}" for i, j, w in weight)
    recall = [f"{n(i, i)} / nullif({row[i]}, 0)" for i in range(3)]
    mae = [f"e{i} / nullif({row[i]}, 0)" for i in range(3)]
    f1 = " + ".join(f"coalesce(2 * {n(i, i)} / nullif({row[i]} + {column[i]}, 0), 0)" for i in range(3))
    mean = lambda v: f"list_avg(list_filter([{', '.join(v)}], lambda x: x IS NOT NULL))"
    each = ", ".join([f"round({r}, 6) AS class_recall_{i}" for i, r in enumerate(recall)] + [f"round({m}, 6) AS class_mae_{i}" for i, m in enumerate(mae)])
    return f"""w AS (SELECT {comma} count(*) AS n_phones, {cells}, {errors} FROM {source} {group})
SELECT {comma} n_phones, round({mean(mae)}, 6) AS balanced_mae, round((coalesce(e0, 0) + coalesce(e1, 0) + coalesce(e2, 0)) / n_phones, 6) AS mae,
  round(1 - ({seen}) / nullif(({due}) / n_phones, 0), 6) AS qwk, round(({f1}) / 3, 6) AS macro_f1, round({mean(recall)}, 6) AS balanced_accuracy, {each} FROM w"""


@query(SOURCE + "," + metric_sql())
def ordinal_metrics(spark, sf_dir):
    return rounded(metrics.ordinal_metrics(tokens(spark, sf_dir)))


@query(SOURCE + "," + metric_sql("phone"))
def metrics_by_phone(spark, sf_dir):
    return rounded(metrics.ordinal_metrics(tokens(spark, sf_dir), ("phone",)))


@query(SOURCE + "," + metric_sql("fold"))
def metrics_by_fold(spark, sf_dir):
    return rounded(metrics.ordinal_metrics(tokens(spark, sf_dir), ("fold",)))


@query(SOURCE + ", s AS (SELECT * FROM c WHERE phone IN (3, 7, 11, 19))," + metric_sql("phone", "s"))
def special_phone_metrics(spark, sf_dir):
    return rounded(metrics.ordinal_metrics(tokens(spark, sf_dir).where(F.col("phone").isin(3, 7, 11, 19)), ("phone",)))


@query(SOURCE + "SELECT label, l.j::INTEGER AS predicted, count(*) FILTER (WHERE predicted = l.j)::BIGINT AS n FROM c CROSS JOIN range(3) l(j) GROUP BY label, l.j")
def confusion_table(spark, sf_dir):
    return metrics.confusion(tokens(spark, sf_dir))


@query(SOURCE + """, l AS (SELECT i::INTEGER AS label FROM range(3) r(i)), n AS (
  SELECT l.label, count(*) FILTER (WHERE c.label = l.label)::BIGINT AS support, count(*) FILTER (WHERE predicted = l.label) AS said, count(*) FILTER (WHERE predicted = l.label AND c.label = l.label) AS hit
  FROM c CROSS JOIN l GROUP BY l.label)
SELECT label, support, round(coalesce(hit / nullif(said, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hit / nullif(said + support, 0), 0), 6) AS f1 FROM n""")
def categorical_report(spark, sf_dir):
    return rounded(metrics.categorical_report(tokens(spark, sf_dir)))


@query(SOURCE + "SELECT fold, round(greatest(-1, least(1, corr(label * 50.0, score))), 6) AS pearson FROM p GROUP BY fold")
def pearson_by_fold(spark, sf_dir):
    return rounded(tokens(spark, sf_dir).groupBy("fold").agg(metrics.pearson(F.col("label") * 50.0, F.col("score")).alias("pearson")))


@query(SOURCE + """, r AS (
  SELECT fold, rank() OVER (PARTITION BY fold ORDER BY label) + (count(*) OVER (PARTITION BY fold, label) - 1) / 2 AS a,
         rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2 AS b FROM p)
SELECT fold, round(corr(a, b), 6) AS spearman FROM r GROUP BY fold""")
def spearman_by_fold(spark, sf_dir):
    return rounded(metrics.spearman(tokens(spark, sf_dir), "label", "score", ("fold",)))


@query(SOURCE + """, b AS (SELECT least(floor(score / 100.0 * 10), 9)::INTEGER AS bin, score / 100.0 AS x, label / 2.0 AS t FROM p)
SELECT r.i::INTEGER AS bin, count(x)::BIGINT AS n, round(avg(x), 6) AS mean_prediction, round(avg(t), 6) AS mean_target, round(abs(avg(x) - avg(t)), 6) AS gap
FROM range(10) r(i) LEFT JOIN b ON b.bin = r.i GROUP BY r.i""")
def calibration_curve(spark, sf_dir):
    return rounded(calibration.score_calibration(tokens(spark, sf_dir)))


@query(SOURCE + """, b AS (SELECT fold, least(floor(score / 100.0 * 10), 9) AS bin, count(*) AS n, abs(avg(score / 100.0) - avg(label / 2.0)) AS gap FROM p GROUP BY 1, 2)
SELECT fold, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS max_calibration_error FROM b GROUP BY fold""")
def calibration_error_by_fold(spark, sf_dir):
    return rounded(calibration.errors(calibration.score_calibration(tokens(spark, sf_dir), by=("fold",)), ("fold",)))


def with_probabilities(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"q1": F.least(F.lit(1.0), F.col("score") / 80), "q2": F.greatest(F.lit(0.0), F.col("score") / 125 - 0.1)})


@query(SOURCE + """, q AS (SELECT label, least(1.0, score / 80) AS q1, greatest(0.0, score / 125 - 0.1) AS q2 FROM p), l AS (
  SELECT 1 AS threshold, q1 AS x, (label >= 1)::INTEGER::DOUBLE AS t FROM q UNION ALL SELECT 2, q2, (label >= 2)::INTEGER::DOUBLE FROM q),
b AS (SELECT threshold, least(floor(x * 10), 9) AS bin, count(*) AS n, abs(avg(x) - avg(t)) AS gap FROM l GROUP BY 1, 2),
e AS (SELECT threshold, sum(n * gap) / sum(n) AS ece, max(gap) AS m FROM b GROUP BY threshold)
SELECT threshold, round(avg(t), 6) AS prevalence, round(avg(x), 6) AS mean_probability, round(avg((x - t) * (x - t)), 6) AS brier, round(any_value(ece), 6) AS ece, round(any_value(m), 6) AS max_calibration_error
FROM l JOIN e USING (threshold) GROUP BY threshold""")
def ordinal_probability_calibration(spark, sf_dir):
    return rounded(calibration.ordinal_calibration(with_probabilities(tokens(spark, sf_dir))))


@query(SOURCE + """SELECT speaker AS "group", """ + ", ".join(f"count(*) FILTER (WHERE label = {i} AND predicted = {j})::BIGINT AS n_{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"round(coalesce(sum(error) FILTER (WHERE label = {i}), 0), 6) AS e_{i}" for i in range(3)) + " FROM c GROUP BY speaker")
def group_statistics(spark, sf_dir):
    stats = bootstrap.group_statistics(tokens(spark, sf_dir), "speaker")
    return rounded(stats.select("group", *(f"n_{i}{j}" for i in range(3) for j in range(3)), "e_0", "e_1", "e_2"))


@query()
def paired_bootstrap(spark, sf_dir):
    return rounded(bootstrap.paired_bootstrap(tokens(spark, sf_dir), "speaker", ("score_b", "score")))


@query(SOURCE + """, n AS (SELECT label, count(*) AS n FROM p GROUP BY label), s AS (SELECT sum(n) / sum(n * n ** -0.54) AS k FROM n)
SELECT label, n::BIGINT AS n, round(n ** -0.54 * k, 6) AS weight FROM n CROSS JOIN s""")
def power_law_weights(spark, sf_dir):
    return rounded(weights.power_law_weights(tokens(spark, sf_dir), 0.54))


@query(SOURCE + """, n AS (SELECT label, count(*) AS n FROM p GROUP BY label), r AS (SELECT utterance_id, avg(1.0 / n) AS raw FROM p JOIN n USING (label) GROUP BY utterance_id)
SELECT utterance_id, round(raw / (SELECT avg(raw) FROM r), 6) AS weight FROM r""")
def record_sampling_weights(spark, sf_dir):
    return rounded(weights.record_sampling_weights(tokens(spark, sf_dir), "utterance_id"))


@query(SOURCE + """, w AS (SELECT label, 1.0 / count(*) AS w FROM p GROUP BY label)
SELECT phone, round(sum(w * label * 50) / sum(w), 6) AS baseline FROM p JOIN w USING (label) GROUP BY phone
UNION ALL SELECT -1, round(sum(w * label * 50) / sum(w), 6) FROM p JOIN w USING (label)""")
def balanced_phone_baseline(spark, sf_dir):
    return rounded(weights.phone_baseline(tokens(spark, sf_dir), "phone", balanced=True).select(F.coalesce("phone", F.lit(-1)).alias("phone"), "baseline"))


@query(SOURCE + """, t AS (SELECT phone, avg(label * 50.0) AS b FROM p WHERE fold <> 0 AND phone < 40 GROUP BY phone), g AS (SELECT avg(label * 50.0) AS b FROM p WHERE fold <> 0 AND phone < 40)
SELECT p.phone, count(*)::BIGINT AS n, round(avg(abs(coalesce(t.b, g.b) - label * 50.0)), 6) AS mae FROM p CROSS JOIN g LEFT JOIN t ON t.phone = p.phone WHERE fold = 0 GROUP BY p.phone""")
def phone_baseline_prediction(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    fitted = weights.phone_baseline(rows.where("fold <> 0 AND phone < 40"), "phone")
    predicted = weights.predict_phone_baseline(rows.where("fold = 0"), fitted, "phone")
    return rounded(predicted.groupBy("phone").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("baseline") - F.col("label") * 50.0)).alias("mae")))


@query(SOURCE + """, g AS (SELECT median(label * 50.0 - score) AS g FROM p), m AS (SELECT phone, count(*) AS n, median(label * 50.0 - score) AS m FROM p GROUP BY phone)
SELECT phone, n::BIGINT AS n, round(n / (n + 200) * m + (1 - n / (n + 200)) * g, 6) AS shift FROM m CROSS JOIN g""")
def shrunk_residual_calibrator(spark, sf_dir):
    return rounded(weights.shrunk_residuals(tokens(spark, sf_dir), "phone"))


@query(SOURCE + "SELECT round(regr_slope(label * 50.0, score_b), 6) + 0.0 AS slope, round(regr_intercept(label * 50.0, score_b), 6) AS intercept FROM p")
def affine_fit(spark, sf_dir):
    return rounded(weights.affine_fit(tokens(spark, sf_dir), "score_b"))


PROFILE_SQL = SOURCE + """, o AS (SELECT speaker, phone, count(*) AS n, sum((2 - label) / 2.0) AS total FROM p GROUP BY ALL),
m AS (SELECT phone, sum(total) / sum(n) AS mean FROM o GROUP BY phone), s AS (SELECT DISTINCT speaker FROM o),
f AS (SELECT s.speaker, m.phone, coalesce(n, 0) AS n, coalesce(total, 0) AS total, mean, (coalesce(total, 0) + 12 * mean) / (coalesce(n, 0) + 12) AS posterior, coalesce(n, 0) / (coalesce(n, 0) + 12.0) AS reliability
      FROM s CROSS JOIN m LEFT JOIN o ON o.speaker = s.speaker AND o.phone = m.phone),
c2 AS (SELECT speaker, coalesce(sum(reliability * (posterior - mean)) / nullif(sum(reliability), 0), 0) AS common FROM f GROUP BY speaker)
"""


@query(PROFILE_SQL + "SELECT speaker, phone, n::BIGINT AS n, round(total, 6) AS total, round(posterior, 6) AS posterior, round(reliability, 6) AS reliability, round((posterior - mean - common) * sqrt(reliability), 6) + 0.0 AS pattern FROM f JOIN c2 USING (speaker)")
def speaker_profiles(spark, sf_dir):
    return rounded(weights.profiles(tokens(spark, sf_dir), "speaker", "phone"))


@query(SOURCE + """, o AS (SELECT speaker, utterance_id, phone, count(*) AS n, sum((2 - label) / 2.0) AS s FROM p GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY speaker, phone) AS sn, sum(s) OVER (PARTITION BY speaker, phone) AS ss, sum(n) OVER (PARTITION BY phone) AS cn, sum(s) OVER (PARTITION BY phone) AS cs FROM o)
SELECT speaker, utterance_id, phone, round((ss - s + 12 * coalesce((cs - s) / nullif(cn - n, 0), 0)) / (sn - n + 12), 6) AS posterior, (sn - n)::BIGINT AS n_left FROM k""")
def leave_one_out_profiles(spark, sf_dir):
    return rounded(weights.leave_one_out(tokens(spark, sf_dir), "speaker", "phone", "utterance_id"))


@query(SOURCE + "SELECT speaker, phone_index, label, round((score - (SELECT avg(score) FROM p)) / (SELECT stddev_pop(score) FROM p), 6) + 0.0 AS z FROM p")
def z_scores(spark, sf_dir):
    rows = weights.z_scores(tokens(spark, sf_dir), "score")
    return rounded(rows.select("speaker", "phone_index", "label", "z"))


@query(SOURCE + ", n AS (SELECT label, speaker, count(*)::DOUBLE AS n FROM p GROUP BY ALL) SELECT label, count(*)::BIGINT AS groups, round(sum(n) ** 2 / sum(n * n), 6) AS effective FROM n GROUP BY label")
def effective_speakers(spark, sf_dir):
    return rounded(weights.effective_count(tokens(spark, sf_dir), "speaker", ("label",)))


@query(SOURCE + """, g AS (SELECT count(*) AS n, avg(score) AS m, var_pop(score) AS v FROM p GROUP BY phone)
SELECT round((SELECT var_pop(score) * count(*) FROM p) ** -1 * ((SELECT var_pop(score) * count(*) FROM p) - sum(n * v)), 6) AS eta_squared FROM g""")
def explained_by_phone(spark, sf_dir):
    return rounded(weights.explained_by_groups(tokens(spark, sf_dir), "phone", "score"))


@query(SOURCE + """, n AS (SELECT label, count(*) FILTER (WHERE fold = 0) AS a, count(*) AS b FROM p GROUP BY label)
SELECT round(sum(abs(a / (SELECT sum(a) FROM n) - b / (SELECT sum(b) FROM n))) / 2, 6) AS distance FROM n""")
def label_mix_distance(spark, sf_dir):
    return rounded(weights.total_variation(tokens(spark, sf_dir), F.col("fold") == 0))


@query(SOURCE + "SELECT label, count(score)::BIGINT AS n, round(min(score), 6) AS low, round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.95), 6) AS p95, round(max(score), 6) AS high, round(avg(score), 6) AS mean FROM p GROUP BY label")
def score_summary(spark, sf_dir):
    return rounded(weights.value_summary(tokens(spark, sf_dir), "score", ("label",)))


@query(SOURCE + "SELECT speaker, count(*)::BIGINT AS size, (row_number() OVER (ORDER BY count(*) DESC, speaker) - 1)::INTEGER AS rank FROM p GROUP BY speaker")
def relabel_by_size(spark, sf_dir):
    return ranking.relabel_by_size(tokens(spark, sf_dir), "speaker")


@query(SOURCE + """, u AS (SELECT DISTINCT utterance_id FROM p)
SELECT utterance_id FROM u ORDER BY sha256('42:' || utterance_id), utterance_id LIMIT 200""")
def stable_sample(spark, sf_dir):
    return ranking.stable_sample(tokens(spark, sf_dir).select("utterance_id").distinct(), F.col("utterance_id"), 200, 42)


QUEUE_ROWS = SOURCE + """, u AS (SELECT utterance_id, phone, label, max(error) AS severity FROM c GROUP BY ALL),
k AS (SELECT *, utterance_id || ':' || phone || ':' || label AS key FROM u)"""


def review_rows(spark, sf_dir):
    error = F.abs(F.col("score") - F.col("label") * 50.0)
    rows = tokens(spark, sf_dir).groupBy("utterance_id", "phone", "label").agg(F.max(error).alias("severity"))
    return rows.withColumn("key", F.concat_ws(":", "utterance_id", "phone", "label"))


@query(QUEUE_ROWS + """, r AS (SELECT *, row_number() OVER (PARTITION BY label, phone ORDER BY severity DESC, sha256('7:' || key), key) AS cell_rank FROM k),
s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cell_rank, phone) AS label_rank FROM r WHERE cell_rank <= 60)
SELECT key, label, phone, round(severity, 6) AS severity, row_number() OVER (ORDER BY label_rank, label)::INTEGER AS position FROM s WHERE label_rank <= 60 ORDER BY label_rank, label LIMIT 60""")
def disagreement_queue(spark, sf_dir):
    out = ranking.disagreement_queue(review_rows(spark, sf_dir), ("label", "phone"), "severity", "key", 60, 7)
    return rounded(out.select("key", "label", "phone", "severity", "position"))


@query(SOURCE + """, v AS (SELECT score_b AS v, count(*) FILTER (WHERE label = 2) AS g, count(*) FILTER (WHERE label = 0) AS i FROM p WHERE label <> 1 GROUP BY 1),
r AS (SELECT v, coalesce(sum(g) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT sum(g) FROM v) AS frr,
      1 - coalesce(sum(i) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (SELECT sum(i) FROM v) AS far FROM v)
SELECT round(v, 6) AS threshold, round(frr, 6) AS false_reject, round(far, 6) AS false_accept, round((frr + far) / 2, 6) AS rate FROM r ORDER BY round(abs(far - frr), 12), v LIMIT 1""")
def equal_error_rate(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    return rounded(ranking.equal_error(rows.where("label = 2"), rows.where("label = 0"), "score_b"))


@query(SOURCE + """, k AS (SELECT fold, label, least(greatest(floor(score * 2), 0), 200) AS tick, count(*) AS n FROM p GROUP BY ALL),
g AS (SELECT a.i AS lo, b.i AS hi FROM range(10, 111) a(i) JOIN range(90, 191) b(i) ON b.i >= a.i + 2),
n AS (SELECT fold, lo, hi, sum(n) FILTER (WHERE label = 0 AND tick < lo) AS h0, sum(n) FILTER (WHERE label = 1 AND tick >= lo AND tick < hi) AS h1, sum(n) FILTER (WHERE label = 2 AND tick >= hi) AS h2,
  sum(n) FILTER (WHERE tick < lo) AS s0, sum(n) FILTER (WHERE tick >= lo AND tick < hi) AS s1, sum(n) FILTER (WHERE tick >= hi) AS s2,
  sum(n) FILTER (WHERE label = 0) AS t0, sum(n) FILTER (WHERE label = 1) AS t1, sum(n) FILTER (WHERE label = 2) AS t2 FROM k CROSS JOIN g GROUP BY ALL),
f AS (SELECT fold, lo, hi, round((coalesce(2 * h0 / nullif(coalesce(s0, 0) + t0, 0), 0) + coalesce(2 * h1 / nullif(coalesce(s1, 0) + t1, 0), 0) + coalesce(2 * h2 / nullif(coalesce(s2, 0) + t2, 0), 0)) / 3, 12) AS f1 FROM n)
SELECT fold, lo / 2 AS low, hi / 2 AS high, round(f1, 6) AS macro_f1 FROM f QUALIFY row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, abs(lo - 50) + abs(hi - 150), lo, hi) = 1""")
def threshold_grid(spark, sf_dir):
    return rounded(ranking.threshold_grid(tokens(spark, sf_dir), ("fold",)))


@query()
def cross_fitted_thresholds(spark, sf_dir):
    """Thresholds of the other folds applied to each fold: one grid per held fold."""
    rows = tokens(spark, sf_dir)
    others = rows.join(F.broadcast(spark.range(5).select(F.col("id").cast("int").alias("held"))), F.col("held") != F.col("fold"))
    chosen = F.broadcast(ranking.threshold_grid(others, ("held",)).withColumnRenamed("held", "fold"))
    applied = rows.join(chosen.select("fold", "low", "high"), "fold").withColumn("score", F.when(F.col("score") < F.col("low"), 0.0).when(F.col("score") < F.col("high"), 50.0).otherwise(100.0))
    return rounded(metrics.categorical_report(applied))


@query(SOURCE + """, n AS (SELECT utterance_id, count(*)::BIGINT AS n FROM p GROUP BY utterance_id)
SELECT utterance_id, n, (sum(n) OVER (ORDER BY utterance_id) - n)::BIGINT AS "offset" FROM n""")
def record_offsets(spark, sf_dir):
    return ranking.record_offsets(tokens(spark, sf_dir), "utterance_id", F.floor(F.col("utterance_id") / 10_000))


@query(SOURCE + """, s AS (SELECT 1 AS seed, score AS x, * FROM c UNION ALL SELECT 2, score_b, * FROM c), e AS (SELECT seed, fold, label, avg(abs(x - label * 50.0)) AS m, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT seed, label, sum(m * n) / sum(n) AS m FROM e GROUP BY ALL)
SELECT seed, fold, round(avg(m), 6) AS balanced_mae FROM e GROUP BY ALL UNION ALL SELECT seed, -1, round(avg(m), 6) FROM o GROUP BY ALL""")
def seed_robustness(spark, sf_dir):
    each = F.array(F.struct(F.lit(1).alias("seed"), F.col("score").alias("x")), F.struct(F.lit(2).alias("seed"), F.col("score_b").alias("x")))
    long = tokens(spark, sf_dir).select("fold", "label", F.inline(each))
    sums = long.groupBy("seed", "fold", "label").agg(F.sum(F.abs(F.col("x") - F.col("label") * 50.0)).alias("e"), F.count(F.lit(1)).alias("n"))
    rolled = sums.rollup("seed", "label", "fold").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).where("seed IS NOT NULL AND label IS NOT NULL")
    return rounded(rolled.groupBy("seed", F.coalesce("fold", F.lit(-1)).alias("fold")).agg(F.avg(F.try_divide("e", "n")).alias("balanced_mae")))


def arms(spark, sf_dir):
    """One row of metrics per scorer."""
    each = F.array(F.struct(F.lit("candidate").alias("arm"), F.col("score_b").alias("x")), F.struct(F.lit("baseline").alias("arm"), F.col("score").alias("x")))
    long = tokens(spark, sf_dir).select("label", F.inline(each)).withColumnRenamed("x", "score")
    ece = calibration.errors(calibration.score_calibration(long, by=("arm",)), ("arm",)).select("arm", "ece")
    return metrics.ordinal_metrics(long, ("arm",)).join(ece, "arm").join(metrics.spearman(long, "label", "score", ("arm",)), "arm")


@query()
def confirmation_gates(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    changes = gate.deltas(arms(spark, sf_dir), "arm", "candidate", "baseline", (*gate.TOLERANCE, *gate.MUST_RISE))
    intervals = bootstrap.paired_bootstrap(rows, "speaker", ("score_b", "score"))
    error = lambda score: F.abs(F.col(score) - F.col("label") * 50.0)
    seeds = rows.groupBy("fold", "label").agg(F.avg(error("score_b")).alias("c"), F.avg(error("score")).alias("b")).groupBy("fold").agg(F.avg("c").alias("c"), F.avg("b").alias("b"))
    return rounded(gate.gates(changes).unionByName(gate.interval_gate(intervals)).unionByName(gate.every_seed_gate(seeds, "fold", "c", "b")))


@query(SOURCE + """, s AS (SELECT DISTINCT speaker, fold FROM p WHERE fold = 0), n AS (SELECT count(DISTINCT utterance_id) AS u FROM p),
k AS (SELECT fold, count(*)::BIGINT AS held_rows, count(DISTINCT speaker)::BIGINT AS held_groups, count(*) FILTER (WHERE label = 0)::BIGINT AS held_0, count(*) FILTER (WHERE label = 1)::BIGINT AS held_1, count(*) FILTER (WHERE label = 2)::BIGINT AS held_2 FROM p GROUP BY fold),
h AS (SELECT fold, count(DISTINCT utterance_id)::BIGINT AS shared_prompts FROM p WHERE utterance_id IN (SELECT utterance_id FROM p GROUP BY utterance_id HAVING count(DISTINCT fold) > 1) GROUP BY fold)
SELECT k.fold, held_rows, (SELECT count(*) FROM p) - held_rows AS train_rows, held_groups, held_0, held_1, held_2, coalesce(shared_prompts, 0) AS shared_prompts FROM k LEFT JOIN h USING (fold)""")
def fold_report(spark, sf_dir):
    return leakage.fold_report(tokens(spark, sf_dir), "fold", "speaker", "utterance_id")


@query(SOURCE + "SELECT speaker, count(DISTINCT fold)::BIGINT AS n_values FROM p GROUP BY speaker HAVING count(DISTINCT fold) > 1")
def group_fold_violations(spark, sf_dir):
    return leakage.functional_dependency(tokens(spark, sf_dir), "speaker", "fold")


@query(SOURCE + """, l AS (SELECT DISTINCT utterance_id FROM p WHERE fold = 1), r AS (SELECT utterance_id, count(*) AS n FROM p WHERE fold = 0 GROUP BY utterance_id),
m AS (SELECT r.*, l.utterance_id IS NOT NULL AS seen FROM r LEFT JOIN l USING (utterance_id))
SELECT count(*)::BIGINT AS records, count(*) FILTER (WHERE seen)::BIGINT AS leaked_records, sum(n)::BIGINT AS phones, coalesce(sum(n) FILTER (WHERE seen), 0)::BIGINT AS leaked_phones, count(DISTINCT utterance_id) FILTER (WHERE seen)::BIGINT AS shared_keys,
  round(count(*) FILTER (WHERE seen) / count(*), 6) AS record_rate, round(coalesce(sum(n) FILTER (WHERE seen), 0) / sum(n), 6) AS phone_rate FROM m""")
def fold_leakage(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    held = rows.where("fold = 0").groupBy("utterance_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(leakage.overlap(rows.where("fold = 1"), held, "utterance_id", "n"))


@query(SOURCE + "SELECT count(*)::BIGINT AS kept FROM p WHERE fold <> 0 AND utterance_id NOT IN (SELECT utterance_id FROM p WHERE fold = 0)")
def purged_fit_rows(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    return leakage.purge(rows.where("fold <> 0"), rows.where("fold = 0"), "utterance_id").agg(F.count(F.lit(1)).alias("kept"))


def label_counts(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("speaker").agg(*(F.count(F.when(F.col("label") == i, 1)).alias(f"n_{i}") for i in (0, 1, 2)))


@query()
def stratified_group_folds(spark, sf_dir):
    return leakage.assign_group_folds(label_counts(spark, sf_dir), "speaker", 5)


@query()
def speaker_split(spark, sf_dir):
    return leakage.speaker_split(label_counts(spark, sf_dir), "speaker")


@query()
def duration_batches(spark, sf_dir):
    rows = tokens(spark, sf_dir).groupBy("utterance_id").agg((F.sum("score_b") / 10).alias("seconds"))
    return rounded(ranking.pack_batches(rows, "utterance_id", "seconds", 120.0, 8, 128, F.floor("seconds")))


@query()
def balanced_review_queue(spark, sf_dir):
    rows = tokens(spark, sf_dir).withColumn("priority", F.abs(F.col("score") - F.col("label") * 50.0))
    return rounded(ranking.balanced_queue(rows, "label", "utterance_id", "speaker", "phone", "phone_index", "priority", 50).select("label", "utterance_id", "phone", "position"))


@query(SOURCE + "SELECT count(*)::BIGINT AS n_phones, count(DISTINCT utterance_id)::BIGINT AS n_utterances, [count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 2)]::VARCHAR AS label_counts, (SELECT string_agg(phone, ',' ORDER BY phone) FROM (SELECT DISTINCT phone FROM p)) AS phones FROM p")
def dataset_audit(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    counts = F.concat(F.lit("["), F.concat_ws(", ", *(F.count(F.when(F.col("label") == i, 1)) for i in (0, 1, 2))), F.lit("]"))
    phones = F.array_join(F.transform(F.array_sort(F.collect_set("phone")), lambda x: x.cast("string")), ",")  # a fixed vocabulary
    return rows.agg(F.count(F.lit(1)).alias("n_phones"), F.countDistinct("utterance_id").alias("n_utterances"), counts.alias("label_counts"), phones.alias("phones"))


@query(SOURCE + """SELECT fold, CASE WHEN score < 15 THEN 'low' WHEN score < 65 THEN 'medium' ELSE 'high' END AS band, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def score_bands(spark, sf_dir):
    from ..functions.arrays import score_band

    return tokens(spark, sf_dir).groupBy("fold", score_band(F.col("score"), "lenient").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(SOURCE + """, t AS (SELECT *, score / 50 AS teacher FROM p), d AS (SELECT label, teacher - label AS delta FROM t)
SELECT label, CASE WHEN abs(delta) < 0.5 THEN 'agreement' WHEN abs(delta) < 1.5 THEN 'moderate' ELSE 'severe' END || CASE WHEN abs(delta) < 0.5 THEN '' WHEN delta < 0 THEN ' teacher_lower' ELSE ' teacher_higher' END AS kind, count(*)::BIGINT AS n FROM d GROUP BY ALL""")
def teacher_disagreement(spark, sf_dir):
    delta = F.least(F.greatest(F.col("score") / 50, F.lit(0.0)), F.lit(2.0)) - F.col("label")
    size = F.when(F.abs(delta) < 0.5, "agreement").when(F.abs(delta) < 1.5, "moderate").otherwise("severe")
    side = F.when(F.abs(delta) < 0.5, "").when(delta < 0, " teacher_lower").otherwise(" teacher_higher")
    return tokens(spark, sf_dir).groupBy("label", F.concat(size, side).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(SOURCE + """, r AS (SELECT fold, label, utterance_id, 1 / (1 + exp(-(score - 50) / 25)) AS q1, 1 / (1 + exp(-(score - 75) / 25)) AS q2 FROM p)
SELECT fold, round(avg(-(CASE WHEN label >= 1 THEN ln(q1) ELSE ln(1 - q1) END + CASE WHEN label >= 2 THEN ln(q2) ELSE ln(1 - q2) END) / 2), 6) AS loss, round(avg(50 * (q1 + q2)), 6) AS mean_score FROM r GROUP BY fold""")
def ordinal_loss(spark, sf_dir):
    q = [1 / (1 + F.exp(-(F.col("score") - c) / 25)) for c in (50, 75)]
    term = [F.when(F.col("label") >= k + 1, F.ln(p)).otherwise(F.ln(1 - p)) for k, p in enumerate(q)]
    return rounded(tokens(spark, sf_dir).groupBy("fold").agg(F.avg(-(term[0] + term[1]) / 2).alias("loss"), F.avg(50 * (q[0] + q[1])).alias("mean_score")))


@query(SOURCE + "SELECT classify AS predicted, count(*)::BIGINT AS n FROM (SELECT CASE WHEN score_b < 25 THEN 0 WHEN score_b < 75 THEN 1 ELSE 2 END AS classify FROM p) GROUP BY ALL")
def class_counts(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy(classify(F.col("score_b")).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
