"""Edges of the record operators."""

from pyspark.sql import functions as F

from assaykit.operators import records


def test_first_mismatch(spark):
    rows = [(["a", "b"], ["a", "b"]), (["a"], ["a", "b"]), ([], []), ([], ["x"]), (["a", None], ["a", None]), (["a", None], ["a", "b"])]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = {r.i: r.m for r in frame.select("i", records.first_mismatch(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {0: None, 1: 1, 2: None, 3: 0, 4: None, 5: 1}


def test_suffix_matches_and_first_known(spark):
    paths = spark.createDataFrame([("a/b/c.wav",), ("b/d.wav",), ("e.wav",), ("ab/c.wav",)], "path string")
    keys = spark.createDataFrame([("c.wav",), ("b/c.wav",), ("d.wav",), ("d.wav",)], "key string")
    got = {r.path: (r.status, r.matched) for r in records.suffix_matches(paths, "path", keys, "key").collect()}
    assert got == {"a/b/c.wav": ("ambiguous", None), "b/d.wav": ("matched", "d.wav"), "e.wav": ("missing", None), "ab/c.wav": ("matched", "c.wav")}


def test_sets_and_means(spark):
    left, right = (spark.createDataFrame([(k,) for k in ks], "k long") for ks in ([1, 1, 2, None], [1, 2, 2, None]))
    assert sorted(tuple(r) for r in records.multiset_difference(left, right, "k").collect()) == [(1, 2, 1), (2, 1, 2)]
    assert records.multiset_difference(left, left, "k").count() == 0
    assert records.same_rows(left.na.drop(), right.na.drop(), "k").first().equal is True
    seeds = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, None), (1, 3.0), (2, float("inf"))], "g int, x double")
    assert {r.g: (r.x, r.seeds) for r in records.mean_over_seeds(seeds, ("g",), ("x",)).collect()} == {1: (2.0, 4), 2: (None, 1)}
    bad = records.domain_violations(spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (101.0,), (5.0,)], "s double"), "s", 0.0, 100.0).first()
    assert tuple(bad) == (5, 1, 1, 1, 1)
    assert [r.k for r in records.selection(left.na.drop().distinct(), "k", [2, 9, 1]).orderBy("place").collect()] == [2, 9, 1]
