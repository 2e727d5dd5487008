"""Language-model scoring by stupid backoff over the corpus' own n-gram counts.

Documents are dealt to blocks. Each block explodes its n-grams (64-bit hashes of words in
order) and sends every different one once, with its count, to the part of the count table
that its hash belongs to; the parts add up the blocks' counts and answer each block in the
order it asked; the block joins the answers to its documents' n-grams and sums per document.
So an n-gram crosses the network once a block, however often it occurs, and a frequent one
is a single number in each block. Blocks and parts have a bounded size and their number
grows with the corpus. Keys travel sorted, their upper bits as steps, cut to the bytes that keep a
clash of two n-grams under one in a million, and numbers as byte planes.

A document is scored by the rest of the corpus: its own occurrences are taken from every
count. For a token with history, the longest n-gram that still occurs elsewhere gives
count(n-gram) / count(its history), times ``BACKOFF`` for each order given up; a word alone
has count / (tokens elsewhere), a word that occurs nowhere else 1 / (tokens elsewhere + 1).

Defined results: tokens are lower-cased text between white space; null or empty text has no
tokens, score 0 and a null mean; repeated rows are documents each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, read, text_of
from .words import ODD, Powers, mix, word_hashes

MAX_ORDER, BACKOFF = 3, 0.4
BLOCK_CHARS, PART_CHARS = 8_000_000, 8_000_000


class Exploded:
    """The n-grams of a block's documents, order by order."""

    def __init__(self, texts: list[str], max_order: int, width: int = 8):
        word, self.sizes = word_hashes(texts, Powers())
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        gram = mix(word + ODD)
        self.at, grams = [np.arange(len(word))], [gram]
        for order in range(2, max_order + 1):
            longer = gram.copy()
            longer[1:] = mix(gram[:-1] * ODD + mix(word[1:] + np.uint64(order)))
            gram = longer
            self.at.append(np.flatnonzero(place >= order - 1))
            grams.append(gram[self.at[-1]])
        self.ends = np.cumsum([0, *map(len, grams)])
        spare = np.uint64(64 - 8 * width)
        self.keys = np.concatenate(grams) >> spare << spare

    def own(self) -> np.ndarray:
        """How often each n-gram occurs in its own document."""
        doc = np.concatenate([self.doc[at] for at in self.at])
        _, place, count = np.unique(mix(self.keys + mix(doc.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
        return count[place]


def slices(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """Sorted keys by the part they belong to: (part, from, to), empty ones left out."""
    edges = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)
    cuts = [0, *np.searchsorted(keys, edges, side="left").tolist(), len(keys)]
    return [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, so that upper bytes of zero cost nothing."""
    planes = np.ascontiguousarray(values).view("u1").reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[4:], n * width, "zstd", asbytes=True), "u1").reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def key_bytes(grams: int) -> int:
    """Upper bytes of a 64-bit hash that keep the chance of a clash under one in a million for each of so many n-grams."""
    return next((b for b in (6, 7) if grams * 1e6 < 1 << 8 * b), 8)


def pack_keys(keys: np.ndarray, width: int = 8) -> bytes:
    """Ascending keys of so many upper bytes: all but three as they are, then the steps of the three upper ones."""
    steps = np.diff(keys >> np.uint64(40), prepend=np.uint64(0))
    return np.ascontiguousarray(keys.astype("<u8").view("u1").reshape(-1, 8)[:, 8 - width : 5]).tobytes() + pack(steps.astype("<u4"))


def unpack_keys(data: bytes, n: int, width: int = 8) -> np.ndarray:
    out, some = np.zeros((n, 8), "u1"), width - 3
    out[:, 8 - width : 5] = np.frombuffer(data, "u1", some * n).reshape(n, some)
    return out.view("<u8").ravel() | np.cumsum(unpack(data[some * n :], "<u4").astype(np.uint64)) << np.uint64(40)


def score_documents(docs: DataFrame, max_order: int = MAX_ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_tokens, score (sum of natural logarithms), mean_score."""
    source = docs.select("doc_id", F.lower(text_of(docs)).alias("text"))
    size = source.agg(F.coalesce(F.sum(F.char_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks, parts = max(1, math.ceil(size / BLOCK_CHARS)), max(1, math.ceil(size / PART_CHARS))
    width = key_bytes(max_order * size // 2)  # a word takes two characters at least
    dealt = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition("block")

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        keys, count = np.unique(Exploded(table.column("text").to_pylist(), max_order, width).keys, return_counts=True)
        rows = [(p, block, pack_keys(keys[a:b], width), pack(count[a:b].astype("<u4"))) for p, a, b in slices(keys, parts)]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "block", "keys", "counts"])

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        counts = [unpack(c, "<u4") for c in table.column("counts").to_pylist()]
        keys = [unpack_keys(k, len(c), width) for k, c in zip(table.column("keys").to_pylist(), counts, strict=True)]
        count = np.concatenate(counts)
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, count).astype("<i8")[place]
        ends = np.cumsum([len(k) for k in keys])
        found = [pack(total[e - len(k) : e]) for k, e in zip(keys, ends, strict=True)]
        return pa.table([table.column("block"), table.column("part"), pa.array(found, pa.binary())], names=["block", "part", "totals"])

    def join(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        grams = Exploded(table.column("text").to_pylist(), max_order, width)
        order = np.argsort(np.asarray(answers.column("part")), kind="stable")
        texts = answers.column("totals").to_pylist()
        total = np.concatenate([np.empty(0, "<i8"), *(unpack(texts[i], "<i8") for i in order)])
        _, place = np.unique(grams.keys, return_inverse=True)
        left = total[place] - grams.own()  # what the rest of the corpus has
        n = len(grams.doc)
        value, open_, dropped = np.zeros(n), np.ones(n, bool), np.zeros(n, np.int64)
        for k in range(max_order, 1, -1):
            at, count = grams.at[k - 1], left[grams.ends[k - 1] : grams.ends[k]]
            history = np.zeros(n, np.int64)
            history[grams.at[k - 2]] = left[grams.ends[k - 2] : grams.ends[k - 1]]
            hit = open_[at] & (count > 0)
            value[at[hit]] = np.log(count[hit] / history[at[hit] - 1]) + dropped[at[hit]] * math.log(backoff)
            dropped[at] += open_[at] & ~hit
            open_[at[hit]] = False
        alone = left[: grams.ends[1]]
        seen, never = open_ & (alone > 0), open_ & (alone <= 0)
        value[seen] = np.log(alone[seen])
        value[open_] += dropped[open_] * math.log(backoff)
        sums = [np.bincount(grams.doc, w, minlength=len(grams.sizes)) for w in (value, seen, never)]
        made = [table.column("doc_id"), pa.array(grams.sizes), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2].astype(np.int64))]
        return pa.table(made, names=["doc_id", "n_tokens", "logs", "seen", "never"])

    asked = dealt.groupBy("block").applyInArrow(ask, "part int, block int, keys binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(answer, "block int, part int, totals binary")
    joined = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, "doc_id long, n_tokens long, logs double, seen long, never long")
    scored = cut(joined)
    elsewhere = F.lit(scored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]) - F.col("n_tokens")
    score = F.col("logs") - F.when(F.col("seen") > 0, F.col("seen") * F.log(elsewhere.cast("double"))).otherwise(0.0) - F.col("never") * F.log(elsewhere + 1.0)
    return scored.select("doc_id", "n_tokens", score.alias("score"), F.try_divide(score, F.col("n_tokens")).alias("mean_score"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the rest of the corpus."""
    scored = score_documents(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", F.round("score", 4).alias("score"), F.round("mean_score", 6).alias("mean_score"))


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS words FROM documents
), x AS (
  SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM d
), t AS (
  SELECT r, i, w, lag(w) OVER o AS p, lag(w, 2) OVER o AS pp, count(*) OVER (PARTITION BY r) AS m, count(*) OVER () AS n FROM x WINDOW o AS (PARTITION BY r ORDER BY i)
), c AS (
  SELECT r, i, n - m AS rest,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS one,
    count(*) OVER (PARTITION BY p, w) - count(*) OVER (PARTITION BY r, p, w) AS two,
    count(*) OVER (PARTITION BY pp, p, w) - count(*) OVER (PARTITION BY r, pp, p, w) AS three
  FROM t
), s AS (
  SELECT r, CASE
      WHEN i > 2 AND three > 0 THEN ln(three::DOUBLE / lag(two) OVER o)
      WHEN i > 1 AND two > 0 THEN ln(two::DOUBLE / lag(one) OVER o) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
      WHEN one > 0 THEN ln(one::DOUBLE / rest) + least(i - 1, 2) * ln(0.4)
      ELSE ln(1 / (rest + 1.0)) + least(i - 1, 2) * ln(0.4) END AS s
  FROM c WINDOW o AS (PARTITION BY r ORDER BY i)
), g AS (SELECT r, sum(s) AS score FROM s GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_tokens, round(coalesce(score, 0.0), 4) AS score, round(score / nullif(len(words), 0), 6) AS mean_score
FROM d LEFT JOIN g USING (r)
"""
