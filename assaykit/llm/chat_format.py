"""Chat formatting with Spark expressions only.

The turns of a conversation are collected and sorted, adjacent turns of one role are
merged by an array aggregation, and the template is filled in by concatenation. Control
strings inside texts are escaped so that the formatted string can be parsed back exactly.

Defined results: a null role or text counts as empty; turns with the same number are
ordered by role, then text (null turn numbers first); repeated rows are repeated turns; a
null conversation id is a conversation of its own; an empty table gives no rows. Columns
other than the four named are ignored. A conversation is one output string, so its turns
meet in one row; nothing larger than a conversation is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read

START, TEXT, TURN, END = "<|start|>", "<|text|>", "<|turn|>", "<|end|>"
LEARNED_ROLE = "assistant"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    """Put one more backslash between each ``<`` and the ``|`` after it, past any there already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """Take that backslash out again."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _merged(turns: Column) -> Column:
    """Sorted turns to blocks of one role: array<struct<role, texts>>."""

    def step(blocks, turn):
        last = F.element_at(blocks, -1)
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(grown))).otherwise(F.concat(blocks, F.array(fresh)))

    return F.aggregate(turns, F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)"), step)


def _pieces(blocks: Column) -> Column:
    """Blocks to the template's pieces in order: array<struct<s, learned>>."""

    def piece(s, learned):
        return F.struct(s.alias("s"), learned.alias("learned"))

    no = F.lit(False)

    def block(b):
        learned = b["role"] == LEARNED_ROLE
        texts = F.transform(
            b["texts"],
            lambda t, i: F.when(i == 0, F.array(piece(escape(t), learned))).otherwise(F.array(piece(F.lit(TURN), no), piece(escape(t), learned))),
        )
        head = F.concat(F.lit(START), escape(b["role"]), F.lit(TEXT))
        return F.concat(F.array(piece(head, no)), F.flatten(texts), F.array(piece(F.lit(END), no)))

    return F.flatten(F.transform(blocks, block))


def _spans(pieces: Column) -> Column:
    """Where learned pieces lie in the whole string: array<struct<start, length>>, start from 1."""

    def step(acc, p):
        n = F.char_length(p["s"])
        span = F.struct(acc["at"].alias("start"), n.alias("length"))
        return F.struct((acc["at"] + n).alias("at"), F.when(p["learned"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    zero = F.expr("named_struct('at', 1, 'spans', cast(array() as array<struct<start:int,length:int>>))")
    return F.aggregate(pieces, zero, step, lambda acc: acc["spans"])


def format_chats(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to one formatted row per conversation.

    Returns conv_id, n_blocks, formatted, loss_mask: array<struct<start int, length int>> in
    code points of ``formatted`` (start from 1), which covers the learned role's texts alone.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv_id", _merged(F.col("turns")).alias("blocks"))
    chats = chats.select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), _pieces(F.col("blocks")).alias("pieces"))
    return chats.select(
        "conv_id",
        "n_blocks",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        _spans(F.col("pieces")).alias("loss_mask"),
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Formatted rows back to (turns array<struct<role, text>>, learned: the text under the mask)."""

    def block(b):
        head_body = F.split(F.regexp_replace(b, r"<\|end\|>\z", ""), r"<\|text\|>", -1)
        role = unescape(head_body[0])
        return F.transform(F.split(head_body[1], r"<\|turn\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(F.col("formatted"), r"<\|start\|>", -1)
    blocks = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))
    learned = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    return formatted.select(
        "*",
        F.flatten(F.transform(blocks, block)).alias("turns"),
        F.array_join(learned, "").alias("learned"),
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a probe conversation -7, formatted and read back into digests."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    back = parse_chats(format_chats(rows.unionByName(probe)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


OP6_SQL = r"""
WITH probe AS (
  SELECT -7::BIGINT AS conv_id, i AS turn, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
         '</s>[INST] ok [/INST]' AS text FROM range(2) r(i)
), t AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT conv_id, turn, role, text FROM probe
), e AS (
  SELECT *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS erole, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS etext,
         coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), false) AS same
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(etext) + CASE WHEN same THEN 8 ELSE length(erole) + 24 END)::BIGINT AS formatted_chars,
       (count(*) FILTER (WHERE NOT same))::BIGINT AS n_blocks
FROM e GROUP BY conv_id
"""
