"""Strict JSONL sources: every problem of a line is found in the JVM, with the line's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..schemas import LABELS, MANIFEST, PHONES, REQUEST


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: file, line (from 1), value; blank lines are counted but left out."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    line = F.row_number().over(Window.partitionBy("file").orderBy("__b", "__i"))
    return raw.withColumn("line", line).where(F.trim("value") != "").select("file", "line", "value")


def strict_json(lines: DataFrame, schema: T.StructType, required: tuple[str, ...] | None = None) -> DataFrame:
    """Lines with ``record`` and ``problems``: bad JSON (duplicate keys and NaN included), missing or extra keys."""
    sound = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    keys = F.json_object_keys("value")
    wanted = list(required or schema.fieldNames())
    problems = F.when(~sound, F.array(F.lit("invalid JSON"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.size(F.array_except(F.array(*map(F.lit, wanted)), keys)) > 0, F.lit("missing key")),
                F.when(F.size(F.array_except(keys, F.array(*map(F.lit, schema.fieldNames())))) > 0, F.lit("extra key")),
            )
        )
    )
    return lines.withColumn("record", F.from_json("value", schema)).withColumn("problems", problems)


def safe_relative(path: Column, suffix: str) -> Column:
    """A relative POSIX path inside the root with the right suffix."""
    return path.isNotNull() & path.rlike(rf"^[^/\\\x00-\x1f][^\\\x00-\x1f]*{suffix}$") & ~path.rlike(r"(^|/)\.{1,2}(/|$)") & ~path.contains("//")


def manifest(spark: SparkSession, path: str, strict: bool = True, phones: tuple[str, ...] = PHONES) -> DataFrame:
    """Utterances of a manifest: record_index (from 0 over non-blank lines), audio_path, text, phonemes, line, problems.

    Strict scans fail on the first row that has a problem, naming the line; others return the problems.
    """
    rows = strict_json(numbered_lines(spark, path), MANIFEST)
    known = F.array(*map(F.lit, phones))
    p = F.col("record.phonemes")
    text = F.col("record.text")
    bad = {
        "unsafe audio path": ~safe_relative(F.col("record.audio_path"), r"\.wav"),
        "text not trimmed or empty": text.isNull() | (text == "") | (F.trim(text, F.lit(" \t\r\n")) != text),
        "no phonemes": p.isNull() | (F.size(p) == 0),
        "unknown phone": F.exists(p, lambda x: x.isNull() | x["phoneme"].isNull() | ~F.array_contains(known, x["phoneme"])),
        "label outside the scale": F.exists(p, lambda x: x.isNull() | x["label"].isNull() | ~x["label"].isin(*LABELS)) | F.col("value").rlike(r'"label"\s*:\s*(true|false|"|\d+\.)'),
    }
    more = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in bad.items())))
    twice = F.count(F.lit(1)).over(Window.partitionBy("record.audio_path")) > 1
    rows = rows.withColumn("problems", F.when(F.size("problems") > 0, F.col("problems")).otherwise(F.concat(more, F.when(twice, F.array(F.lit("duplicate audio path"))).otherwise(F.array().cast("array<string>")))))
    index = (F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1).cast("long")
    rows = rows.withColumn("record_index", index).select("record_index", "record.*", "file", "line", "problems")
    if strict:
        message = F.concat(F.lit("line "), F.col("line"), F.lit(": "), F.array_join("problems", "; "))
        rows = rows.where(F.when(F.size("problems") > 0, F.raise_error(message).cast("boolean")).otherwise(True))  # a filter is never pruned
    return rows


def phones_of(records: DataFrame) -> DataFrame:
    """One row per phone: utterance_id (the file name without suffix), record_index, phone_index, phoneme, label, target."""
    stem = F.regexp_extract("audio_path", r"([^/]+)\.wav$", 1)
    flat = records.select(stem.alias("utterance_id"), "record_index", F.posexplode("phonemes").alias("phone_index", "p"))
    return flat.select("utterance_id", "record_index", "phone_index", "p.phoneme", "p.label", (F.col("p.label") * 50.0).alias("target"))


def requests(lines: DataFrame) -> DataFrame:
    """Request lines to request_id, fields and error; a bad line has its error and, where it can be read, its id."""
    rows = strict_json(lines, REQUEST, ("request_id", "audio_paths", "prompt", "max_tokens", "response_format"))
    r = F.col("record")
    checks = [
        F.when(F.size("problems") > 0, F.array_join("problems", "; ")),
        F.when(r["request_id"].isNull(), F.lit("request_id is missing")),
        F.when(~F.coalesce(r["max_tokens"].between(1, 8192), F.lit(False)), F.lit("max_tokens is out of range")),
        F.when(~F.coalesce(r["response_format"].isin("text", "judge_json"), F.lit(False)), F.lit("unknown response_format")),
    ]
    name = F.coalesce(r["request_id"], F.get_json_object("value", "$.request_id"))
    return rows.select("line", name.alias("request_id"), "record.audio_paths", "record.prompt", "record.max_tokens", "record.response_format", F.coalesce(*checks).alias("error"))


def tolerant_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A ledger whose last line may be cut off: that line is left out, any other bad line fails."""
    rows = strict_json(numbered_lines(spark, path), schema, ())
    last = F.max("line").over(Window.partitionBy("file")) == F.col("line")
    bad = F.array_contains("problems", "invalid JSON")
    kept = rows.withColumn("last", last).where(~(bad & F.col("last")))
    kept = kept.where(F.when(bad, F.raise_error(F.concat(F.lit("bad line "), F.col("line"))).cast("boolean")).otherwise(True))
    return kept.select("line", "record.*")
