import math

import numpy as np
import pytest

from assaykit.operators import agreement, bootstrap, calibration, gates, metrics, weights
from pyspark.sql import functions as F

SCHEMA = "utterance_id string, phone string, label int, score double"


def frame(spark, labels, scores):
    return spark.createDataFrame([(f"u{i}", "h", a, float(b)) for i, (a, b) in enumerate(zip(labels, scores, strict=True))], SCHEMA)


def test_perfect_and_constant_scores(spark):
    good = metrics.ordinal_metrics(frame(spark, [0, 1, 2], [0, 50, 100])).first()
    assert (good.balanced_mae, good.mae, good.qwk, good.macro_f1, good.balanced_accuracy) == (0, 0, 1, 1, 1)
    flat = metrics.ordinal_metrics(frame(spark, [0, 1, 2], [100, 100, 100])).first()
    assert (flat.balanced_mae, flat.mae, flat.qwk) == (50, 50, 0)
    assert flat.balanced_accuracy == pytest.approx(1 / 3) and flat.macro_f1 == pytest.approx(1 / 6)
    assert metrics.spearman(frame(spark, [0, 1, 2], [100, 100, 100]), "label", "score").first().spearman is None
    assert metrics.spearman(frame(spark, [0, 1, 2], [0, 50, 100]), "label", "score").first().spearman == pytest.approx(1)


def test_missing_class_is_left_out_of_means_but_not_of_f1(spark):
    row = metrics.ordinal_metrics(frame(spark, [0, 2], [0, 100])).first()
    assert row.balanced_mae == 0 and row.balanced_accuracy == 1 and row.macro_f1 == pytest.approx(2 / 3) and row.class_recall_1 is None


def test_class_thresholds(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 24.999, 25.0, 74.999, 75.0, 100.0)], "x double")
    assert [r.c for r in rows.select(metrics.classify(F.col("x")).alias("c")).collect()] == [0, 0, 1, 1, 2, 2]
    with pytest.raises(ValueError):
        metrics.classify(F.lit(1.0), 80, 20)


@pytest.mark.parametrize(("edge", "same", "empty"), [("nan", 1.0, "nan"), ("zero", 1.0, "nan"), ("null", 1.0, None), ("always_nan", "nan", "nan")])
def test_kappa_edges(spark, edge, same, empty):
    def kappa(rows):
        wide = rows.agg(*metrics.cells(F.col("label"), metrics.classify(F.col("score"))))
        value = wide.fillna(0).select(metrics.weighted_kappa(edge).alias("k")).first().k
        return "nan" if value is not None and math.isnan(value) else value

    assert kappa(frame(spark, [1, 1], [50, 50])) == same
    assert kappa(frame(spark, [1, 1], [50, 50]).where("false")) == empty


def test_midranks_and_partitions_do_not_matter(spark):
    rows = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0, 3.0)], "x double")
    for n in (1, 7):
        got = sorted((r.x, r.r) for r in metrics.with_midranks(rows.repartition(n), "x", "r").collect())
        assert got == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]


def test_empty_frames(spark):
    none = frame(spark, [], [])
    assert metrics.ordinal_metrics(none).first().n_phones == 0
    assert metrics.ordinal_metrics(none, ("phone",)).count() == 0
    assert calibration.errors(calibration.score_calibration(none)).first().ece is None


def test_calibration_bins(spark):
    points = calibration.score_calibration(frame(spark, [0, 2, 2], [10, 100, 99])).orderBy("bin").collect()
    assert len(points) == 10 and points[1].n == 1 and points[9].n == 2 and points[0].gap is None
    assert points[9].gap == pytest.approx(0.005)


def test_paired_bootstrap_of_a_constant_difference(spark):
    rows = spark.createDataFrame([(g, lab, 50.0 * lab, 100.0) for g in range(4) for lab in (0, 1, 2)], "g int, label int, good double, bad double")
    got = {r.metric: r for r in bootstrap.paired_bootstrap(rows, "g", ("good", "bad"), 200).collect()}
    assert (got["balanced_mae"].delta, got["balanced_mae"].low, got["balanced_mae"].high) == (-50, -50, -50)
    assert got["balanced_mae"].n_valid == 200


def test_bootstrap_equals_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(int(g), int(lab), float(s), float(t)) for g, lab, s, t in zip(rng.integers(0, 9, 300), rng.integers(0, 3, 300), rng.uniform(0, 100, 300), rng.uniform(0, 100, 300), strict=True)]
    rows = spark.createDataFrame(data, "g int, label int, a double, b double")
    got = {r.metric: r for r in bootstrap.paired_bootstrap(rows, "g", ("a", "b"), 64, seed=3).collect()}
    draws, table, deltas = bootstrap.draw_counts(9, 64, 3), np.array(data), []
    for d in draws:
        sample = np.concatenate([np.repeat(table[table[:, 0] == g], d[g], axis=0) for g in range(9)])
        mae = [np.abs(sample[:, c] - 50 * sample[:, 1]).mean() for c in (2, 3)]
        deltas.append(mae[0] - mae[1])
    assert [got["mae"].low, got["mae"].high] == pytest.approx(np.quantile(deltas, [0.025, 0.975]).tolist())


def test_wilson(spark):
    row = spark.range(1).select(*(c.alias(n) for c, n in zip(agreement.wilson(F.lit(10.0), F.lit(10.0)), ("low", "high"), strict=True))).first()
    assert row.low == pytest.approx(0.7224672, abs=1e-7) and row.high == 1.0
    assert spark.range(1).select(agreement.wilson(F.lit(0.0), F.lit(0.0))[0]).first()[0] is None


def test_alpha_and_consensus(spark):
    same = spark.createDataFrame([(i, r, i % 3) for i in range(6) for r in "ab"], "item int, rater string, rating int")
    assert agreement.krippendorff_ordinal(same).first().alpha == pytest.approx(1.0)
    votes = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (1, "c", 0), (2, "a", 1), (2, "b", 0)], "item int, rater string, rating int")
    assert {r.item: r.consensus for r in agreement.consensus(votes, 3).collect()} == {1: 2, 2: None}


def test_phone_baseline(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 2), ("b", 2), ("b", 2)], "phone string, label int")
    plain = {r.phone: r.baseline for r in weights.phone_baseline(rows, "phone").collect()}
    assert plain == {"a": 50, "b": 100, None: 75}
    even = {r.phone: r.baseline for r in weights.phone_baseline(rows, "phone", balanced=True).collect()}
    assert even["b"] == pytest.approx(100) and even[None] == pytest.approx(50) and even["a"] == pytest.approx(100 * (0.5 + 0.25) / 2.25)


def test_power_law_weights_average_one(spark):
    rows = spark.createDataFrame([(0,)] * 2 + [(1,)] * 3 + [(2,)] * 15, "label int")
    w = weights.power_law_weights(rows, 0.5).collect()
    assert sum(r.n * r.weight for r in w) == pytest.approx(20)
    assert weights.power_law_weights(rows.where("label < 2"), 0.5).first().weight is None


def test_gates(spark):
    rows = spark.createDataFrame([("balanced_mae", 1.0, 2.0, -1.0), ("mae", 3.0, 2.0, 1.0), ("qwk", 0.5, 0.5, None), ("class_recall_0", 0.5, 0.5, 0.0), ("class_recall_1", 0.6, 0.5, 0.1), ("ece", 0.1, 0.09, 0.01)], "metric string, candidate double, baseline double, delta double")
    passed = {r.gate: r.passed for r in gates.gates(rows).collect()}
    assert passed == {"mae": False, "qwk": False, "class_recall_0": False, "class_recall_1": True, "ece": True}
    assert gates.verdict(gates.gates(rows)).first().accepted is False
    for high, accepted in ((-0.1, True), (0.0, False), (float("nan"), False), (None, False)):
        interval = spark.createDataFrame([("balanced_mae", high), ("mae", -5.0)], "metric string, high double")
        assert gates.interval_gate(interval).first().passed is accepted
    for seeds, accepted in (([(1, 1.0, 2.0), (2, 1.0, 1.5)], True), ([(1, 1.0, 2.0), (2, 2.0, 2.0)], False), ([(1, 1.0, float("nan"))], False), ([], False)):
        frame = spark.createDataFrame(seeds, "seed int, c double, b double")
        assert gates.every_seed_gate(frame, "seed", "c", "b").first().passed is accepted
