"""Registered queries do the whole job: whole texts, whole tables, all candidates, all replicates."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.functions import text as texts
from assaykit.operators import bootstrap, ranking, vectors
from assaykit.plans import registry
from assaykit.plans.assessment import rounded, tokens


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(90))] for _ in "ab")
        assert texts.edit_distance(a, b) == plain_distance(a, b)


def test_phone_error_rate_takes_whole_texts(spark, tmp_path):
    r = random.Random(6)
    made = ["".join(r.choice("abC d") for _ in range(r.randint(60, 200))) for _ in range(6)] + [""]
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["phone_error_rate"](spark, str(tmp_path)).first()
    letters = [t.lower().replace(" ", "") for t in made]
    edits = sum(plain_distance(a, b) for a, b in zip(letters, letters[1:]))
    assert (got.pairs, got.edits, got.error_rate) == (6, edits, round(edits / sum(map(len, letters[:-1])), 6))


def test_linkage_clusters_take_every_label(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = registry.QUERIES["linkage_clusters"](spark, sf_dir).collect()
    assert sorted(r.vec_id for r in got) == sorted(r.vec_id for r in rows.select("vec_id").collect())


def test_z_scores_of_every_row(spark, sf_dir):
    rows = tokens(spark, sf_dir).toPandas()
    z = ((rows.score - rows.score.mean()) / rows.score.std(ddof=0)).round(5) + 0.0
    got = registry.QUERIES["z_scores"](spark, sf_dir).toPandas()
    expected = sorted(zip(rows.speaker, rows.phone_index, rows.label, z, strict=True))
    found = sorted(zip(got.speaker, got.phone_index, got.label, got.z, strict=True))
    assert np.array(found, float) == pytest.approx(np.array(expected, float), abs=2e-5)


def greedy(rows, per_label):
    """The reference's rule on (label, utterance, speaker, phone, index, priority)."""
    out = []
    for label in sorted({x[0] for x in rows}):
        ordered = sorted((x for x in rows if x[0] == label), key=lambda x: (-x[5], x[3], x[1], x[4]))
        used, counts = set(), collections.Counter()
        for position in range(1, per_label + 1):
            left = [x for x in ordered if x[1] not in used]
            if not left:
                break
            x = min(left, key=lambda x: (counts[x[2], x[3]], -x[5], x[1], x[4]))
            used.add(x[1])
            counts[x[2], x[3]] += 1
            out.append((label, x[1], x[3], x[4], position))
    return sorted(out)


@pytest.mark.parametrize("cells", [2, 6, 40])
def test_balanced_queue_keeps_all_candidates(spark, cells):
    r = random.Random(cells)
    rows = [(label, u, u % 3 if cells > 2 else 0, r.randrange(cells), i, float(r.randrange(30))) for label in (0, 1) for u in range(60) for i in range(5)]
    frame = spark.createDataFrame(rows, "label int, u int, s int, p int, i int, priority double")
    for per_label in (1, 4, 25):
        got = ranking.balanced_queue(frame, "label", "u", "s", "p", "i", "priority", per_label)
        assert sorted(got.select("label", "u", "p", "i", "position").toPandas().itertuples(index=False, name=None)) == greedy(rows, per_label)


def test_paired_bootstrap_has_ten_thousand_replicates(spark, sf_dir):
    got = registry.QUERIES["paired_bootstrap"](spark, sf_dir).toPandas()
    whole = rounded(bootstrap.paired_bootstrap(tokens(spark, sf_dir), "speaker", ("score_b", "score"), 10_000)).toPandas()
    assert got.equals(whole)


def test_impostor_pairs_of_more_rows_than_ranges_are_sampled_from(spark):
    n = 30_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.array(F.col("id") * 0.0, F.lit(1.0)).alias("v")).repartition(3)
    pairs = vectors.impostor_pairs(rows, "k", "v").where(F.col("other") == (F.col("k") + F.col("stride")) % n)
    assert pairs.count() == pairs.distinct().count() == n * len(vectors.STRIDES)


def test_impostor_pairs_of_equal_and_missing_keys(spark):
    rows = spark.createDataFrame([(k, [float(i), 1.0]) for i, k in enumerate([5, None, 5, 2, None])], "k long, v array<double>")
    got = vectors.impostor_pairs(rows, "k", "v", (1, 5)).select("k", "other", "stride").collect()
    assert sorted((str(r.k), str(r.other)) for r in got) == sorted([("2", "5"), ("5", "5"), ("5", "None"), ("None", "None"), ("None", "2")])


def plain_linkage(x, similarity):
    """Average linkage by the whole matrix of distances, one join at a time."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[k] for k in range(len(x))]
    d = np.clip(1 - x @ x.T, 0, 2)
    while len(groups) > 1:
        between = [(d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        least, i, j = min(between)
        if least > 1 - similarity:
            break
        groups[i] += groups.pop(j)
    groups = sorted((sorted(g) for g in groups), key=lambda g: (-len(g), g[0]))
    return {k: c for c, g in enumerate(groups) for k in g}


@pytest.mark.parametrize("at_once", [0, 120, 10**6])
def test_linkage_clusters_on_executors_and_driver(spark, at_once):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(12, 6)), 5, axis=0) + rng.normal(0, 0.4, (60, 6))
    x[7] = x[3]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(60, None), (61, [0.0] * 6), (62, [float("nan")] + [1.0] * 5)], "k int, v array<double>")
    for similarity in (0.35, 0.8):
        got = {r.k: r.cluster for r in vectors.linkage_clusters(rows, "k", "v", similarity, at_once).collect()}
        plain = plain_linkage(x, similarity)
        assert {k: got[k] for k in plain} == plain
        assert len(got) == 63 and sorted(got[k] for k in (60, 61, 62)) == [max(plain.values()) + i for i in (1, 2, 3)]


def test_linkage_clusters_of_many_rows_and_ties(spark):
    """More rows than the whole matrix was made for; all distances in a group are alike."""
    n, group = 5_400, 18
    ids = spark.range(n).withColumn("g", F.floor(F.col("id") / group))
    spike = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda d: F.when(d == 22 + F.pmod("id", F.lit(group)), 0.2).otherwise(F.when(F.abs(d) < 22, F.sin(F.col("g") * (d + 1.0) + d * d)).otherwise(0.0)))
    got = vectors.linkage_clusters(ids.select("id", spike.alias("v")), "id", "v", 0.9).toPandas()
    assert len(got) == n and (got.groupby(got.id // group).cluster.nunique() == 1).all()
