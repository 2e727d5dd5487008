"""Sinks: write-once tables, staged publication, ledgers and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ranking import latest


def write_once(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Fails if the path exists."""
    rows.write.mode("errorifexists").format(kind).save(path)


def publish(spark: SparkSession, outputs: dict[str, DataFrame], path: str) -> None:
    """Several outputs that appear together: all are written to a staging folder, which is renamed last.

    Nothing is left behind on failure, and an existing path is never replaced.
    """
    jvm = spark.sparkContext._jvm
    target, staging = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".staging")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    fs.delete(staging, True)
    try:
        for name, rows in outputs.items():
            rows.write.mode("errorifexists").parquet(f"{path}.staging/{name}")
        if not fs.rename(staging, target):
            raise OSError(f"cannot publish {path}")
    except Exception:
        fs.delete(staging, True)
        raise


def append_ledger(rows: DataFrame, path: str, key: tuple[str, ...], unique: bool = False) -> None:
    """Append decisions; with ``unique`` a key that is there already, or twice in the batch, is an error."""
    if unique:
        if not rows.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError("a key occurs twice")
        spark = rows.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
        if there and not rows.join(spark.read.parquet(path).select(*key), list(key), "left_semi").isEmpty():
            raise ValueError("a key is in the ledger already")
    rows.write.mode("append").parquet(path)


def ledger_view(spark: SparkSession, path: str, key: tuple[str, ...], order: str) -> DataFrame:
    """The last decision of each key."""
    return latest(spark.read.parquet(path), key, order)


def manifest_lines(records: DataFrame) -> DataFrame:
    """Records back to manifest lines, in record order."""
    line = F.to_json(F.struct("audio_path", "text", F.transform("phonemes", lambda p: F.struct(p["phoneme"].alias("phoneme"), p["label"].alias("label"))).alias("phonemes")))
    return records.orderBy("record_index").select(line.alias("value"))


def blind_packet(items: DataFrame, hidden: tuple[str, ...], key: str) -> tuple[DataFrame, DataFrame]:
    """What reviewers see, without the hidden columns, and the private key."""
    return items.drop(*hidden), items.select(key, *hidden)


def report_line(rows: DataFrame) -> DataFrame:
    """A small report as JSON lines; values that are not finite become null."""
    def clean(name: str, kind: str):
        c = F.col(name)
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c).alias(name) if kind in ("double", "float") else c

    return rows.select(F.to_json(F.struct(*(clean(n, k) for n, k in rows.dtypes)), {"ignoreNullFields": "false"}).alias("value"))
