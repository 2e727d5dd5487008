"""Queries over models, blocks, audit joins, gates and consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews
from ..operators.metrics import classify
from .assessment import SOURCE, metric_sql, rounded, tokens
from .registry import query

KEY = ("utterance_id", "phone_index")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(SOURCE + ", m AS (SELECT 'a' AS model, label, predicted, error FROM c UNION ALL SELECT 'b', label, CASE WHEN score_b < 25 THEN 0 WHEN score_b < 75 THEN 1 ELSE 2 END, abs(score_b - label * 50.0) FROM p), " + metric_sql("model", "m"))
def models_compared(spark, sf_dir):
    return rounded(reviews.models_compared(tokens(spark, sf_dir), {"a": "score", "b": "score_b"}))


@query(SOURCE + ", m AS (SELECT 'all' AS block, label, predicted, error FROM c UNION ALL SELECT 'label ' || label, label, predicted, error FROM c), " + metric_sql("block", "m"))
def metric_blocks(spark, sf_dir):
    return rounded(reviews.metric_blocks(tokens(spark, sf_dir)))


@query(SOURCE + "SELECT label, CASE WHEN score / 50 < 0.5 THEN 0 WHEN score / 50 < 1.5 THEN 1 ELSE 2 END AS bin, count(*) AS n FROM p GROUP BY ALL")
def score_bins(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy("label", reviews.score_to_bin(F.col("score") / 50).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(SOURCE + "SELECT utterance_id, count(*) FILTER (WHERE phone_index % 2 = 1) AS test, count(*) FILTER (WHERE phone_index % 2 = 0) AS calibration FROM p GROUP BY utterance_id HAVING test <> 1 OR calibration <> 1")
def role_violations(spark, sf_dir):
    role = F.when(F.col("phone_index") % 2 == 1, "test").otherwise("calibration")
    return reviews.role_violations(tokens(spark, sf_dir).withColumn("role", role), "utterance_id", "role")


@query(SOURCE + ", d AS (SELECT DISTINCT speaker, utterance_id, phone_index, label, predicted, round(abs(score - 50), 6) AS confidence FROM c) SELECT speaker, utterance_id, phone_index, label, predicted, confidence, row_number() OVER (PARTITION BY speaker ORDER BY confidence DESC, utterance_id, phone_index, label)::INTEGER AS position FROM d WHERE label <> predicted QUALIFY position <= 3")
def confident_disagreements(spark, sf_dir):
    rows = rounded(tokens(spark, sf_dir).select("speaker", *KEY, "label", classify(F.col("score")).alias("predicted"), F.abs(F.col("score") - 50).alias("confidence"))).distinct()
    return reviews.confident_disagreements(rows, ("speaker",), "label", "predicted", "confidence", (*KEY, "label"), 3)


@query(SOURCE + """, d AS (SELECT l_orderkey AS utterance_id, l_linenumber AS phone_index, min(l_linestatus) AS own FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
o AS (SELECT o_orderkey AS utterance_id, min(o_orderstatus) AS old FROM orders GROUP BY ALL),
s AS (SELECT c.*, coalesce(own, old, 'pending') AS status FROM c LEFT JOIN d USING (utterance_id, phone_index) LEFT JOIN o USING (utterance_id))
SELECT status, phone, count(*) AS n FROM s WHERE label = 0 AND status = 'F' AND (error >= 50 OR label <> predicted) GROUP BY ALL""")
def filtered_items(spark, sf_dir):
    error = F.abs(F.col("score") - F.col("label") * 50.0)
    flags = F.array_compact(F.array(F.when(error >= 50, F.lit("far")), F.when(F.col("label") != classify(F.col("score")), F.lit("disagreement"))))
    decisions = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias(KEY[0]), F.col("l_linenumber").alias(KEY[1])).agg(F.min("l_linestatus").alias("status"))
    legacy = table(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias(KEY[0])).agg(F.min("o_orderstatus").alias("status"))
    items = reviews.review_status(tokens(spark, sf_dir).withColumn("flags", flags), decisions, legacy, KEY, KEY[0])
    return reviews.filter_items(items, label=0, flags=["far", "disagreement"], status="F").groupBy("status", "phone").agg(F.count(F.lit(1)).alias("n"))


AUDIT = SOURCE + """, k AS (SELECT utterance_id, phone_index, min(label) AS label, max(score) AS judged, max(score_b) AS modelled FROM p GROUP BY ALL)
SELECT label, count(*) AS n, count(r.again) AS rechecked, round(avg(abs(s.judged - s.modelled)), 6) AS gap, round(avg(r.again - s.judged), 6) AS drift
FROM k s LEFT JOIN (SELECT utterance_id, phone_index, modelled AS again FROM k WHERE phone_index = 1) r USING (utterance_id, phone_index) WHERE s.label <> 1 GROUP BY label"""


@query(AUDIT)
def audit_join(spark, sf_dir):
    each = tokens(spark, sf_dir).groupBy(*KEY).agg(F.min("label").alias("label"), F.max("score").alias("judged"), F.max("score_b").alias("modelled"))
    part = lambda c, name: each.select(*KEY, F.col(c).alias(name))
    rows = reviews.audit_rows(part("label", "label"), each.where("label <> 1").select(*KEY), part("judged", "judged"), part("modelled", "modelled"), part("modelled", "again").where("phone_index = 1"), KEY)
    gap, drift = F.avg(F.abs(F.col("judged") - F.col("modelled"))), F.avg(F.col("again") - F.col("judged"))
    return rounded(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("again").alias("rechecked"), gap.alias("gap"), drift.alias("drift")))


@query("""WITH r AS (SELECT c_mktsegment AS reviewer, c_nationkey AS item, (max(c_acctbal) > 9000)::INTEGER AS rating FROM customer GROUP BY ALL),
m AS (SELECT reviewer, count(*) AS rated, avg((rating = n_regionkey % 2)::INTEGER) AS rate FROM r JOIN nation ON item = n_nationkey GROUP BY reviewer)
SELECT reviewer, rated, (SELECT count(*) FROM nation) - rated AS missing, CASE WHEN rated = (SELECT count(*) FROM nation) THEN round(rate, 6) END AS agreement FROM m""")
def unblinded_ratings(spark, sf_dir):
    ratings = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("reviewer"), F.col("c_nationkey").alias("item")).agg((F.max("c_acctbal") > 9000).cast("int").alias("rating"))
    key = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("item"), (F.col("n_regionkey") % 2).cast("int").alias("truth"))
    return rounded(reviews.unblinded(ratings, key, "reviewer", "item", "rating", "truth"))


@query(SOURCE + """, g AS (SELECT speaker, count(*) FILTER (WHERE score_b > 10) / count(*) AS transcripts, quantile_cont(error / 100, 0.5) AS median_error, count(*) FILTER (WHERE score >= 2) / count(*) AS valid,
count(DISTINCT label) AS labels, greatest(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1), count(*) FILTER (WHERE label = 2)) / count(*) AS largest FROM c GROUP BY speaker)
SELECT speaker, round(transcripts, 6) AS transcripts, round(median_error, 6) AS median_error, round(valid, 6) AS valid, labels, round(largest, 6) AS largest,
transcripts >= 0.8 AND median_error <= 0.5 AND valid >= 0.9 AND labels >= 2 AND largest <= 0.95 AS passed FROM g""")
def preflight_gates(spark, sf_dir):
    rows = tokens(spark, sf_dir).withColumn("word_error", F.abs(F.col("score") - F.col("label") * 50.0) / 100)
    return rounded(reviews.preflight(rows, ("speaker",), F.col("score_b") > 10, "word_error", F.col("score") >= 2, "label"))


@query(SOURCE + "SELECT label, count(*) AS n, round(sum(1 / (1 + phone)), 6) AS total_weight, round(avg(1 / (1 + phone)), 6) AS mean_weight, round(sum(score / (1 + phone)) / sum(1 / (1 + phone)), 6) AS weighted_mean FROM p GROUP BY label")
def weighting_report(spark, sf_dir):
    return rounded(reviews.weighting_report(tokens(spark, sf_dir).withColumn("weight", 1 / (1 + F.col("phone"))), ("label",), "weight", "score"))


@query(SOURCE + """, a AS (SELECT t AS threshold, utterance_id // t AS cluster, fold = 0 AS held FROM p, (VALUES (1), (10), (100)) v(t)),
s AS (SELECT threshold, cluster, count(*) FILTER (WHERE held) AS held, count(*) FILTER (WHERE NOT held) AS fit FROM a GROUP BY ALL)
SELECT threshold, count(*) AS clusters, count(*) FILTER (WHERE held > 0 AND fit > 0) AS shared_clusters, coalesce(sum(held) FILTER (WHERE fit > 0), 0)::BIGINT AS leaked_records, sum(held)::BIGINT AS held_records FROM s GROUP BY threshold""")
def leakage_by_threshold(spark, sf_dir):
    rows = tokens(spark, sf_dir).select("utterance_id", (F.col("fold") == 0).alias("held"), F.explode(F.array(F.lit(1), F.lit(10), F.lit(100))).alias("threshold"))
    return reviews.leakage_by_threshold(rows.select("threshold", F.expr("utterance_id div threshold").alias("cluster"), "held"))


@query(SOURCE + """, r AS (SELECT speaker, count(*) + (speaker % 7 = 0)::INTEGER AS total, count(*) FILTER (WHERE label = 0) AS a, count(*) FILTER (WHERE label <> 0) AS b,
count(*) FILTER (WHERE label = 0) / count(*) AS rate, CASE WHEN speaker % 5 = 0 THEN 200 ELSE min(score) END AS low, max(score) AS high FROM p GROUP BY speaker)
SELECT speaker, list_aggregate(list_filter([CASE WHEN a + b <> total THEN 'sum' END, CASE WHEN abs(rate - a / total) > 1e-9 THEN 'rate' END, CASE WHEN low > high THEN 'order' END], lambda x: x IS NOT NULL), 'string_agg', ' ') AS problems
FROM r WHERE a + b <> total OR abs(rate - a / total) > 1e-9 OR low > high""")
def inconsistent_reports(spark, sf_dir):
    zero = F.count(F.when(F.col("label") == 0, 1))
    reports = tokens(spark, sf_dir).groupBy("speaker").agg(
        (F.count(F.lit(1)) + (F.col("speaker") % 7 == 0).cast("int")).alias("total"), zero.alias("a"), F.count(F.when(F.col("label") != 0, 1)).alias("b"),
        (zero / F.count(F.lit(1))).alias("rate"), F.when(F.col("speaker") % 5 == 0, F.lit(200.0)).otherwise(F.min("score")).alias("low"), F.max("score").alias("high"),
    )
    found = reviews.inconsistent_reports(reports, "total", ("a", "b"), ("rate", "a"), ("low", "high"))
    return found.select("speaker", F.array_join("problems", " ").alias("problems"))


@query(SOURCE + """, u AS (SELECT utterance_id, min(speaker) AS speaker, min(label) AS label, min(fold) AS fold FROM p GROUP BY utterance_id),
f AS (SELECT *, row_number() OVER (PARTITION BY label, fold ORDER BY utterance_id) = 1 AS first FROM u),
s AS (SELECT *, CASE WHEN first THEN 0 WHEN NOT bool_or(first) OVER (PARTITION BY speaker) AND row_number() OVER (PARTITION BY speaker ORDER BY utterance_id) = 1 THEN 1 ELSE 2 END AS step FROM f)
SELECT utterance_id, speaker, label, fold, step FROM s ORDER BY step, utterance_id LIMIT 200""")
def quick_selection(spark, sf_dir):
    records = tokens(spark, sf_dir).groupBy("utterance_id").agg(*(F.min(c).alias(c) for c in ("speaker", "label", "fold")))
    return reviews.quick_selection(records, ("label", "fold"), "speaker", ("utterance_id",), 200)
