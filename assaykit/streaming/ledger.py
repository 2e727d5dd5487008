"""Streams of decisions and of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..schemas import DECISION
from ..sources.manifest import requests


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """A folder of JSON lines as a stream of decisions."""
    return spark.readStream.schema(DECISION).json(path)


def latest_decisions(stream: DataFrame, key: str = "audit_id", order: str = "reviewed_at") -> DataFrame:
    """Keyed state: the last decision of each key (complete or update mode)."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of request files as a stream of parsed requests, bad lines with their error."""
    lines = spark.readStream.text(path).select(F.lit(0).alias("line"), "value").where(F.trim("value") != "")
    return requests(lines)


def judge_once(stream: DataFrame, key: str, judge: Callable[[DataFrame], DataFrame], ledger: str, checkpoint: str) -> StreamingQuery:
    """Each key is judged once, over restarts too: keys in the ledger are left out of a batch, results are appended."""

    def one_batch(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(ledger).select(key), key, "left_anti")
        judge(new).write.mode("append").parquet(ledger)

    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
