"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so the whole corpus is described by one count
per length. The plan is made on these counts alone: bins are filled greedily from the
longest piece down; then a bin's smallest piece is given back if two unpacked pieces fill
the widened gap better; the finished pattern is repeated while the counts allow. Pieces
find their places by rank among the pieces of their length, in parallel, whatever the
corpus' size: the driver sees at most ``capacity`` counts, and the plan it sends out is
bounded by the capacity too (every pattern uses up at least one length).

Defined results: null or empty text is a document of its end mark alone; repeated rows are
packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .byte_bpe import chunks_of
from .common import TwoGenerations, cut, fewer, joined, lean, read, text_of

CAPACITY, END_ID, CHUNKS = 1024, 2, 250_000
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE file of the tokenizers library, with a memo for whole chunks.

    Where the file's merges are in the order of the ids they make, and its pre-tokenizer is the
    usual one, the ids are those of a rank encoder on the same vocabulary, which is several
    times faster on single chunks. Any other file, and any text that holds the content of one of the
    file's added tokens, is read by the tokenizers library itself, with its defaults.
    """

    def __init__(self, path: str, chunks: int = CHUNKS):
        self.path, self.own = path, None
        with open(path) as f:
            spec = json.load(f)
        model, pre, alphabet = spec["model"], spec.get("pre_tokenizer") or {}, byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        usual = (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
        if usual and not spec.get("normalizer") and made == sorted(made) and len(made) + 256 == len(made) + sum(len(t) == 1 for t in model["vocab"]):
            special = {t["content"] for t in spec.get("added_tokens", ())}
            ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
            self.encode_ids = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.added = re.compile("|".join(map(re.escape, sorted(special))), re.IGNORECASE) if special else None
        else:
            usual, self.added, self.encode_ids = False, None, self.library
        self.chunked = usual
        self.chunk = TwoGenerations(lambda s: np.array(self.encode_ids(" " + s), "<u4").tobytes(), chunks).get

    def library(self, text: str) -> list[int]:
        if self.own is None:
            import tokenizers

            self.own = tokenizers.Tokenizer.from_file(self.path)
        return self.own.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.added and self.added.search(text):
            return np.array(self.library(text), "<u4").tobytes()
        parts = chunks_of(text) if self.chunked else None
        if parts is None:
            return np.array(self.encode_ids(text), "<u4").tobytes()
        return np.array(self.encode_ids(parts[0]), "<u4").tobytes() + b"".join(map(self.chunk, parts[1:]))


_TOKENIZERS: dict[tuple[str, int], Tokenizer] = {}


def tokenizer(path: str, chunks: int = CHUNKS) -> Tokenizer:
    if (path, chunks) not in _TOKENIZERS:
        _TOKENIZERS[path, chunks] = Tokenizer(path, chunks)
    return _TOKENIZERS[path, chunks]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, payload: str = "ids", chunks: int = CHUNKS) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids; only longer documents are cut, the first piece being the short one.

    Columns: doc_id, piece, start, length, the payload (``ids`` array<int> or ``ids_crc32``), and
    the piece's rank among those of its length in its partition (part, rank).
    """

    def run(batches):
        encode, seen, end = tokenizer(path, chunks).ids, np.zeros(capacity + 1, np.int64), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(own) if payload == "ids_crc32" else np.frombuffer(own, "<i4"), part, int(seen[b - a])))
                    seen[b - a] += 1
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if payload == "ids_crc32" else pa.list_(pa.int32()), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", payload, "part", "rank"])

    kind = "long" if payload == "ids_crc32" else "array<int>"
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(lean(run), f"doc_id long, piece int, start long, length long, {payload} {kind}, part int, rank long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Counts by length to patterns: (how many sequences, the lengths in each)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    at = np.arange(capacity + 1)
    while left.any():
        free, bin_, gap = left.copy(), [], capacity
        while gap > 0 and (fits := np.flatnonzero(free[: gap + 1])).size:
            bin_.append(int(fits[-1]))
            free[bin_[-1]] -= 1
            gap -= bin_[-1]
        if gap > 0 and len(bin_) > 1:
            smallest, room = bin_[-1], gap + bin_[-1]
            largest = np.maximum.accumulate(np.where(free > 0, at, 0))  # the longest free piece up to each length
            first = np.flatnonzero(free[: room + 1])
            second = largest[np.minimum(first, room - first)]
            twin = (second == first) & (free[first] < 2)
            second = np.where(twin, largest[np.maximum(first - 1, 0)], second)
            both = np.where(second > 0, first + second, 0)
            if both.size and (best := int(both.argmax())) >= 0 and smallest < both[best] <= room:
                bin_[-1:] = sorted((int(first[best]), int(second[best])), reverse=True)
        used = np.bincount(bin_, minlength=capacity + 1)
        n = int((left[used > 0] // used[used > 0]).min())
        left -= n * used
        out.append((n, bin_))
    return out


def places(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of each length go: sorted keys (length << 40 | first rank), first sequence, offset."""
    rows, first, taken = [], 0, {}
    for n, bin_ in patterns:
        offset = 0
        for length in bin_:
            rank = taken.get(length, 0)
            rows.append((length << 40 | rank, first, offset))
            taken[length] = rank + n
            offset += length
        first += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, payload: str = "ids", chunks: int = CHUNKS) -> DataFrame:
    """Pieces with the sequence and the offset they go to; a worker's memo holds twice ``chunks`` chunks."""
    cut_pieces = cut(pieces(joined(docs), path, capacity, end_id, payload, chunks))
    by_part = cut_pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    totals = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    keys, sequences, offsets = places(plan(totals, capacity))

    def run(batches):
        for batch in batches:
            key = np.asarray(batch.column("length")).astype(np.int64) << 40 | (np.asarray(batch.column("rank")) + np.asarray(batch.column("before")))
            at = np.searchsorted(keys, key, side="right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", payload)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequences[at] + (key - keys[at])), pa.array(offsets[at])],
                ["doc_id", "piece", "start", "length", payload, "sequence_id", "offset"],
            )

    kind = "long" if payload == "ids_crc32" else "array<int>"
    ranked = cut_pieces.join(before.select("part", "length", "before"), ["part", "length"])
    if payload == "ids_crc32":
        ranked = fewer(ranked, sum(totals.values()))
    return ranked.mapInArrow(lean(run), f"doc_id long, piece int, start long, length long, {payload} {kind}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces (payload ids) to one row per sequence: sequence_id, ids array<int>; a group is one capacity at most."""
    part = F.struct("offset", "ids")
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["ids"])).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 1024 ids."""
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), payload="ids_crc32")
