"""Keyed text formats of speech toolkits: tables, lexicons, matrices and paired scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .manifest import numbered_lines


def tokens(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def keyed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``key v1 v2 ...`` to key, values."""
    t = tokens(F.col("value"))
    return numbered_lines(spark, path).select("line", t[0].alias("key"), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))).alias("values"))


def duplicate_keys(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``utt.idx tokens...`` grouped: utterance_id, items (in index order), contiguous (indices run from 0)."""
    rows = keyed_lines(spark, path).select(F.regexp_extract("key", r"^(.*)\.(\d+)$", 1).alias("utterance_id"), F.regexp_extract("key", r"^(.*)\.(\d+)$", 2).cast("int").alias("i"), "values")
    out = rows.groupBy("utterance_id").agg(F.array_sort(F.collect_list(F.struct("i", "values"))).alias("items"), F.countDistinct("i").alias("d"), F.count(F.lit(1)).alias("n"), F.max("i").alias("m"))
    return out.select("utterance_id", "items", ((F.col("d") == F.col("n")) & (F.col("m") + 1 == F.col("n"))).alias("contiguous"))


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """``utt.idx [ v1 v2 ... ]`` rows: key, vector array<float>; a row with a value that is not finite has null."""
    numbers = F.transform(tokens(F.regexp_extract("value", r"\[\s*([^\[\]]*?)\s*\]", 1)), lambda x: x.try_cast("float"))
    sound = F.forall(numbers, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return numbered_lines(spark, path).select("line", tokens(F.col("value"))[0].alias("key"), F.when(sound, numbers).alias("vector"))


def paired_scores(spark: SparkSession, path: str) -> DataFrame:
    """``utt [ id score ] [ id score ] ...``: utterance_id, index, id, score."""
    pair = F.regexp_extract_all("value", F.lit(r"\[\s*(\S+)\s+(\S+)\s*\]"), F.lit(0))
    rows = numbered_lines(spark, path).select(tokens(F.col("value"))[0].alias("utterance_id"), F.posexplode(pair).alias("index", "p"))
    part = tokens(F.regexp_replace("p", r"[\[\]]", " "))
    return rows.select("utterance_id", "index", part[0].try_cast("int").alias("id"), part[1].try_cast("double").alias("score"))


def symbol_table(spark: SparkSession, path: str) -> DataFrame:
    """``symbol id`` with whether each is unique both ways."""
    rows = keyed_lines(spark, path).select(F.col("key").alias("symbol"), F.col("values")[0].try_cast("int").alias("id"))
    by_id = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_id"))
    by_symbol = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_symbol"))
    return rows.join(by_id, "id").join(by_symbol, "symbol").select("symbol", "id", ((F.col("n_id") == 1) & (F.col("n_symbol") == 1)).alias("unique"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``WORD WORD P1_B P2_E``: word, phones (position and stress taken off), sound (the word repeats and positions fit)."""
    t = tokens(F.col("value"))
    phones = F.slice(t, F.lit(3), F.greatest(F.size(t) - 2, F.lit(0)))
    last = F.transform(phones, lambda p: F.regexp_extract(p, r"_([BIES])$", 1))
    shape = F.array_join(last, "").rlike(r"^(S|BI*E)$")
    plain = F.transform(phones, lambda p: F.regexp_replace(p, r"[012]?_[BIES]$", ""))
    rows = numbered_lines(spark, path).where(~F.col("value").rlike(r"^[<!#]"))
    return rows.select("line", t[0].alias("word"), plain.alias("phones"), ((t[0] == t[1]) & shape & F.forall(phones, lambda p: p.rlike(r"^[A-Z]+[012]?_[BIES]$"))).alias("sound"))


def speaker_lists(rows: DataFrame, speaker: str, utterance: str) -> DataFrame:
    """One line per speaker: the speaker, then its utterances in order."""
    return rows.groupBy(speaker).agg(F.concat_ws(" ", F.col(speaker), F.array_join(F.array_sort(F.collect_set(utterance)), " ")).alias("value"))
