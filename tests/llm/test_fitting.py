"""Models are fitted by a task: labelled texts do not come to the driver."""

import os

import pytest
from pyspark.sql import functions as F

pytest.importorskip("zstandard")

from assaykit.llm import common, quality, toxicity  # noqa: E402


@pytest.mark.parametrize("module, score, label", [(toxicity, toxicity.score_toxicity, "toxic"), (quality, quality.score_quality, "quality")])
def test_no_fit_on_the_driver(spark, monkeypatch, module, score, label):
    rows = [(i, ("awful nasty " if i % 2 else "kind calm ") * 20 + f"w{i}", i % 2) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], f"doc_id long, {label} int")
    held = common.held_out(4, 2)
    plain = module.fit(common.fit_rows(docs, labels, label, held, module.PER_CLASS), common.label_share(labels, label, held))
    driver, real = os.getpid(), module.fit

    def elsewhere(texts, share):
        assert os.getpid() != driver
        return real(texts, share)

    monkeypatch.setattr(module, "fit", elsewhere)
    got = {r.doc_id: r.score for r in score(docs, labels, held).collect()}
    assert len(got) == 80
    assert (got[1] > got[0]) and plain[2].fitted


def test_fit_of_no_rows(spark):
    table = spark.createDataFrame([], "text string, y int").where(F.lit(False))
    assert common.fitted(table, len) == 0
