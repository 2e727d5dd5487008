"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import pickle
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


FILE_ROWS = 50_000  #: rows of a checkpoint file of a narrow table, where there are more files than cores


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage: the rows go to the shared checkpoint folder, which outlives executors.

    ``rows``, the count of a narrow table (or a bound of it), spares it small files: partitions join, without
    a shuffle, as far as there are more than one for FILE_ROWS rows and one for each core. Rows do not change.
    """
    return _written(df if rows is None else fewer(df, rows))


JOINED = 8  #: input partitions that are read by one task, where there are more than four for each core


def joined(df: DataFrame) -> DataFrame:
    """A table as read or cut, in fewer partitions where it has many: JOINED join into one, without a shuffle, but four for each core stay.

    What is written of them then has fewer files. To write a file to a local folder Hadoop starts processes, and
    until each has begun the executor's memory counts twice.
    """
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-df.rdd.getNumPartitions() // JOINED)))


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """A narrow table of so many rows (or a bound of them), in no more partitions than one for FILE_ROWS rows or one for each core."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def _written(df: DataFrame) -> DataFrame:
    """An eager checkpoint.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, one is made up on a
    single machine, as in tests; on a cluster, whose machines share no such folder, it is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="assaykit-checkpoint-"))
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """A function for mapInArrow that keeps no freed memory when a task ends, as Python workers outlive their tasks."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def lean_group(run):
    """The same for a function for applyInArrow, after each group."""

    @functools.wraps(run)
    def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = run(key, table)
        give_back()
        return out

    return whole


class TwoGenerations:
    """A bounded memo: when the young half is full it becomes the old half.

    ``get`` is total: ``make(key)`` fills a miss. Frequent keys survive because a hit in
    the old half moves the entry to the young half.
    """

    def __init__(self, make, limit: int):
        owner = self

        class Young(dict):
            def __missing__(self, key):
                value = owner.old.pop(key, None)
                if value is None:
                    value = make(key)
                if len(self) >= limit:
                    owner.old = dict(self)
                    self.clear()
                self[key] = value
                return value

        self.old: dict = {}
        self.young = Young()
        self.get = self.young.__getitem__


def fit_table(docs: DataFrame, labels: DataFrame, label: str, held: Column, per_class: int) -> DataFrame:
    """Labelled texts to fit on, in one ordered partition: text (whole), y. At most ``per_class`` documents of each class.

    Documents come in the order of a hash of their id; ``held`` marks rows that may not be learnt
    from. Rows without a label, and ids whose labels differ, are left out. An id that has several
    texts gives the smallest.
    """
    sure = labels.where(~held).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z AND y IN (0, 1)")
    order = F.xxhash64("doc_id")
    some = [sure.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class).select("doc_id", F.col("y").cast("int").alias("y")) for y in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # per_class ids a class
    rows = docs.select("doc_id", text_of(docs).alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return rows.repartition(1).sortWithinPartitions(order, "doc_id").select("text", "y")


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, held: Column, per_class: int) -> list[tuple[str, int]]:
    """The rows of ``fit_table``."""
    return [(r["text"], r["y"]) for r in fit_table(docs, labels, label, held, per_class).collect()]


def fitted(table: DataFrame, fit):
    """``fit`` of the rows of a ``fit_table``, worked out by a task: only the model comes to the driver, no text does."""

    def run(batches):
        rows = [pair for batch in batches for pair in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    models = table.mapInArrow(lean(run), "model binary").collect()  # one partition, so one row; none where Spark knows there are no rows
    return pickle.loads(bytes(models[0]["model"])) if models else fit([])


def label_share(labels: DataFrame, label: str, held: Column) -> float:
    """The share of label 1 among the rows that may be learnt from, which scores are calibrated to."""
    share = labels.where(~held & F.col(label).isin(0, 1)).agg(F.avg(label).alias("s")).first()["s"]
    return min(0.95, max(0.05, share if share is not None else 0.5))


def held_out(modulus: int, remainder: int) -> Column:
    """Rows whose CRC-32 of the id as text has this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


class Calibrated:
    """A logistic curve over a few features, fitted by Newton steps with a light ridge."""

    def __init__(self, x, y, share: float | None = None):
        import numpy as np

        x, y = np.asarray(x, float), np.asarray(y, float)
        self.constant = float(y.mean()) if len(y) else 0.5
        self.fitted = 0 < y.sum() < len(y)
        if not self.fitted:
            return
        share = y.mean() if share is None else share
        w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        b = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
            h = (z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-2 * np.eye(len(b))
            b += np.clip(np.linalg.solve(h, z.T @ (w * (y - p)) - 1e-2 * b), -5, 5)
        self.weights = b

    def score(self, x):
        import numpy as np

        if not self.fitted:
            return np.full(len(x), self.constant)
        z = np.c_[(np.asarray(x, float).reshape(-1, len(self.mean)) - self.mean) / self.scale, np.ones(len(x))]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -40, 40)))
