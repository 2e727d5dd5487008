"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is cut
into blocks and each is compressed with either dictionary; the normalised difference of
the sizes, (good - bad) / (good + bad), tells which dictionary knows the text better, and
their sum over the length tells how repetitive it is. A logistic curve, fitted on labelled
documents that the dictionaries have not seen, turns the two into a score.

Bounds: the model is fitted on the whole texts of at most ``PER_CLASS`` documents of each class;
every row is scored on its whole text. Where zstandard cannot train a dictionary, as there are too
few blocks, the blocks themselves are the dictionary. Defined results:
null counts as empty, and empty texts get the curve's value at size 0; without labels of
both classes every score is the share of good labels (0.5 with none); repeated rows repeat;
an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Calibrated, fit_table, fitted, held_out, label_share, lean, read, text_of

PER_CLASS = 1500
BLOCK, DICTIONARY, LEVEL = 4096, 131_072, 3
THRESHOLD = 0.3


def blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


def dictionary(texts: list[str], seed: int) -> bytes:
    """A dictionary trained on the blocks of the texts; raw content where there are too few to train on."""
    samples = [b for t in texts for b in blocks(t)]
    random.Random(seed).shuffle(samples)
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


class Sizes:
    """Compressed sizes with the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compress = []
        for data in (good, bad):
            known = zstandard.ZstdCompressionDict(data) if data else None
            if known:
                known.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress)

    def features(self, text: str) -> tuple[float, float]:
        good = bad = size = 0
        for block in blocks(text):
            good += len(self.compress[0](block))
            bad += len(self.compress[1](block))
            size += len(block)
        return (good - bad) / (good + bad), (good + bad) / (2 * size + 64)


def fit(rows: list[tuple[str, int]], share: float = 0.5) -> tuple[bytes, bytes, Calibrated]:
    """Labelled texts to (good dictionary, bad dictionary, curve); every second text of a class calibrates."""
    by = [[t for t, y in rows if y == k] for k in (0, 1)]
    good, bad = dictionary(by[1][::2], 1), dictionary(by[0][::2], 2)
    sizes = Sizes(good, bad)
    seen = [(t, y) for y in (0, 1) for t in by[y][1::2]]
    return good, bad, Calibrated([sizes.features(t) for t, _ in seen] or np.empty((0, 2)), [y for _, y in seen] or [y for _, y in rows], share if seen else None)


def score_quality(docs: DataFrame, labels: DataFrame, held: Column, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document with score (higher: good likelier) and predicted."""
    share = label_share(labels, "quality", held)
    good, bad, curve = fitted(fit_table(docs, labels, "quality", held, PER_CLASS), lambda rows: fit(rows, share))

    def run(batches):
        sizes = Sizes(good, bad)
        for batch in batches:
            score = curve.score([sizes.features(t) for t in batch.column("text").fill_null("").to_pylist()] or np.empty((0, 2)))
            columns = [*batch.columns[: len(keep)], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    source = docs.select(*keep) if "text" in keep else docs.select(*keep, text_of(docs).alias("text"))
    return source.mapInArrow(lean(run), f"{kinds}, score double, predicted int")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; learnt only from rows that are not held out."""
    held = held_out(5, 0)
    scored = score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
