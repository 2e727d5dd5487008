"""Edges of the review reports."""

from pyspark.sql import functions as F

from assaykit.operators import reviews


def test_score_to_bin(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.49, 0.5, 1.49, 1.5, 2.0, -0.1, 2.1, float("nan"), None)], "x double")
    assert [r.b for r in rows.select(reviews.score_to_bin(F.col("x")).alias("b")).collect()] == [0, 0, 1, 1, 2, 2, None, None, None, None]


def test_roles_and_leakage(spark):
    roles = spark.createDataFrame([(1, "test"), (1, "calibration"), (2, "test"), (3, "test"), (3, "test"), (3, "calibration")], "r int, role string")
    assert sorted(tuple(x) for x in reviews.role_violations(roles, "r", "role").collect()) == [(2, 1, 0), (3, 2, 1)]
    assigned = spark.createDataFrame([(1, 1, True), (1, 1, False), (1, 2, True), (2, 1, True), (2, 2, False)], "threshold int, cluster int, held boolean")
    assert sorted(tuple(x) for x in reviews.leakage_by_threshold(assigned).collect()) == [(1, 2, 1, 1, 2), (2, 2, 0, 0, 1)]
    assert reviews.leakage_by_threshold(assigned.limit(0)).count() == 0


def test_status_prefers_the_whole_key(spark):
    items = spark.createDataFrame([(1, 1, 0, ["far"]), (1, 2, 0, []), (2, 1, 0, ["far", "x"]), (3, 1, 1, ["far"])], "u int, i int, label int, flags array<string>")
    own = spark.createDataFrame([(1, 1, "kept")], "u int, i int, status string")
    old = spark.createDataFrame([(1, "changed")], "u int, status string")
    got = reviews.review_status(items, own, old, ("u", "i"), "u")
    assert {(r.u, r.i): r.status for r in got.collect()} == {(1, 1): "kept", (1, 2): "changed", (2, 1): "pending", (3, 1): "pending"}
    assert [(r.u, r.i) for r in reviews.filter_items(got, label=0, flags=["x", "y"], status="pending").collect()] == [(2, 1)]
    assert reviews.filter_items(got).count() == 4


def test_unblinding_waits_for_all_items(spark):
    key = spark.createDataFrame([(1, 0), (2, 1)], "item int, truth int")
    ratings = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 1, 0), ("b", 9, 1)], "who string, item int, rating int")
    assert sorted(tuple(r) for r in reviews.unblinded(ratings, key, "who", "item", "rating", "truth").collect()) == [("a", 2, 0, 0.5), ("b", 1, 1, None)]


def test_preflight_and_consistency(spark):
    rows = spark.createDataFrame([(1, "a", 0.1, 0), (1, "b", 0.2, 1), (2, "", 0.9, 0), (2, "c", None, 0)], "g int, t string, e double, label int")
    assert {r.g: r.passed for r in reviews.preflight(rows, ("g",), F.col("t") != "", "e", F.col("e").isNotNull(), "label").collect()} == {1: True, 2: False}
    reports = spark.createDataFrame([(1, 4, 1, 3, 0.25, 0.0, 1.0), (2, 4, 1, 2, 0.5, 2.0, 1.0), (3, 0, 0, 0, None, 0.0, 1.0)], "k int, n int, a int, b int, r double, q1 double, q2 double")
    got = reviews.inconsistent_reports(reports, "n", ("a", "b"), ("r", "a"), ("q1", "q2"))
    assert {r.k: r.problems for r in got.collect()} == {2: ["sum", "rate", "order"], 3: ["rate"]}


def test_quick_selection_steps(spark):
    rows = spark.createDataFrame([(1, "x", "g"), (2, "x", "g"), (3, "x", "h"), (4, "y", "g")], "i int, cell string, grp string")
    got = reviews.quick_selection(rows, ("cell",), "grp", ("i",), 3).collect()
    assert [(r.i, r.step) for r in got] == [(1, 0), (4, 0), (3, 1)]
