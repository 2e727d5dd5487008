"""A training-corpus pipeline over the documents table.

Quality classifier, toxicity classifier, near-duplicate classes (one document of each stays),
removal of byte strings that repeat across documents, and packing into sequences. Each stage
works on all that the one before kept. SQL cannot express the stages, so there is no ORACLE_SQL;
tests hold them against brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assaykit.llm import near_dup, packing, quality, suffix_dedup, toxicity
from assaykit.llm.common import cut, held_out, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REPEATED_BYTES = 200  #: passages of over 50 words are longer
MEMO = 50_000  #: chunks in a worker's memo of ids; workers outlive a stage, and so does the memo
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality.score_quality(docs, read(spark, sf_dir, "labels"), held_out(5, 0), keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    scored = toxicity.score_toxicity(docs, read(spark, sf_dir, "labels"), held_out(4, 2), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that of the smallest doc_id (rows without one come last), then text hash.

    Documents without words are classes of their own; of rows with equal ids and texts one stays.
    """
    classes = near_dup.near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"))
    first = classes.where("class_number IS NOT NULL").groupBy("class_number").agg(F.min(order).alias("f")).select("f.*")
    alone = classes.where("class_number IS NULL").select(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    stay = first.unionByName(alone).select("none", F.coalesce("doc_id", F.lit(0)).alias("id"), "mark").distinct()
    rows = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    return rows.join(stay, ["none", "id", "mark"], "left_semi").dropDuplicates(["none", "id", "mark"]).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the strings of REPEATED_BYTES bytes that start elsewhere too; those of which nothing is left go."""
    split = suffix_dedup.split_repeats(docs, REPEATED_BYTES, keep=("doc_id", "lang", "source", "n_chars", "text"))
    cut_out = F.size("removed") > 0
    out = split.withColumn("text", F.when(cut_out, F.col("kept")).otherwise(F.col("text"))).where(~cut_out | (F.trim("text") != ""))
    return out.select("doc_id", "text", "lang", "source", F.when(cut_out, F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 1024 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), payload="ids_crc32", chunks=MEMO)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; each stage's rows are kept in the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
