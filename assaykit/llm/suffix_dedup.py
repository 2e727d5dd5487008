"""Removal of long repeated byte strings, by suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else as well.

1. Every window of ``length`` bytes is assigned to its smallest half-length fingerprint (the
   leftmost of equals). Equal windows have equal anchors at equal places, so what repeats
   meets by the anchor's fingerprint. Neighbouring windows with one anchor form a run; a
   run's bytes are its context.
2. Runs whose anchor occurs once are dropped. Equal contexts are counted: a context that
   occurs twice repeats whole, however many copies there are, and is known by its hash.
3. Of anchors with several different contexts, each different context is taken once. What follows
   the anchor is one string, what precedes it, reversed, another; strings are cut into phrases
   at places that depend on the three bytes before them, and a suffix array of all phrases puts the
   strings of each side in order. From the order, the bytes that neighbours in it share tell which
   contexts share any stretch on either side, byte for byte: two contexts share the window that starts
   d bytes before the anchor if they are in one class of d bytes before it and in one of
   ``length`` - d bytes after it.
4. Contexts of an anchor that has more than ``MANY`` different ones are dealt to two halves of the
   places d, keyed by all bytes that the windows of a half have in common, and so on while a key has
   too many; at one place the key is the window itself. So no group grows with the corpus.
5. The covered bytes of a document are merged and cut out.

The suffix array is built by linear grouping: suffixes start in groups of equal first
symbols, and groups are taken in descending order; the previous smaller suffix of each member
is found by pointers, and those that are pointed at move to a new group just above their own,
the more pointers the higher. When all are done every group is one Lyndon prefix, and one
ascending pass over the pointers emits each group's order; nothing is renamed or sorted again.

Defined results: null or empty text has no bytes; documents shorter than ``length`` keep all;
repeated rows are each other's copies; an empty table gives no rows; extra columns are ignored
by the digests. Texts are whole, at any length; a document's spans meet in one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, lean, lean_group, read, text_of
from .words import ODD, Powers, mix

LENGTH = 400
PHRASE_MASK, LONGEST = 15, 64  #: a cut in 16 on average; every byte past 64 without one
BUCKET_BYTES, MANY = 2_000_000, 2048


def suffix_array(symbols: list[int]) -> list[int]:
    """The suffixes of whole numbers in order; the last symbol must be the only smallest."""
    n = len(symbols)
    order = np.argsort(np.asarray(symbols), kind="stable")
    by = np.asarray(symbols)[order]
    first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
    ends = np.r_[first[1:], n]
    start = [0] * n  # a group is known by the place of its first member, which also orders groups
    size = [0] * n
    members: list[list[int] | None] = [None] * n
    listed = order.tolist()
    for a, b in zip(first.tolist(), ends.tolist(), strict=True):
        members[a] = group = listed[a:b]
        size[a] = b - a
        for i in group:
            start[i] = a
    smaller = [-1] * n
    for s in range(n - 1, -1, -1):
        group = members[s]
        if group is None:
            continue
        pointed: dict[int, int] = {}
        for i in group:
            if start[i] == s:  # others have moved up since
                j = i - 1
                while j >= 0 and start[j] >= s:
                    j = smaller[j]
                smaller[i] = j
                pointed[j] = pointed.get(j, 0) + 1
        pointed.pop(-1, None)
        if len(pointed) == 1:
            (j,) = pointed
            old = start[j]
            if size[old] > 1:
                size[old] -= 1
                new = old + size[old]
                start[j], size[new], members[new] = new, 1, [j]
            continue
        by_count: dict[int, dict[int, list[int]]] = {}
        for j, count in pointed.items():
            by_count.setdefault(count, {}).setdefault(start[j], []).append(j)
        for count in sorted(by_count, reverse=True):
            for old, moved in by_count[count].items():
                if len(moved) == size[old]:
                    continue
                size[old] -= len(moved)
                new = old + size[old]
                size[new], members[new] = len(moved), moved
                for j in moved:
                    start[j] = new
    out = [-1] * n
    placed = bytearray(n)
    front = list(range(n))
    out[0], placed[n - 1] = n - 1, 1
    front[0] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            group = start[j]
            out[front[group]] = j
            front[group] += 1
            placed[j] = 1
            j = smaller[j]
    return out


def leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of each ``width`` neighbours is, the leftmost of equals."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        values_right, values = values[step:], values[: len(values) - step]
        right = values_right < values
        at = np.where(right, at[step:], at[: len(at) - step])
        values = np.where(right, values_right, values)
        span += step
    return at


def runs_of(data: bytes, length: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first start, last start, anchor's place, its fingerprint, the context's."""
    bytes_ = np.frombuffer(data, np.uint8)
    half = length // 2
    prefix = powers.prefix(bytes_)
    starts = np.arange(len(data) - half + 1)
    prints = powers.stretch(prefix, starts, starts + half)
    anchor = leftmost_smallest(prints, length - half + 1)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(anchor)] - 1
    place = anchor[first]
    context = np.fromiter((xxhash.xxh3_64_intdigest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
    return first, last, place, prints[place], mix(context + (place - first).astype(np.uint64))


def phrases_of(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where phrases start in contexts laid end to end, of which ``begins`` has the starts."""
    wide = data.astype(np.uint64)
    three = np.zeros(len(data), np.uint64)
    three[3:] = wide[:-3] << np.uint64(16) | wide[1:-2] << np.uint64(8) | wide[2:-1]
    natural = (mix(three) & np.uint64(PHRASE_MASK)) == 0
    natural[:3] = False
    for k in range(3):
        natural[np.minimum(begins + k, len(data) - 1)] = False
    natural[begins] = True
    cuts = np.flatnonzero(natural)
    gap = np.diff(np.r_[cuts, len(data)])
    long = np.flatnonzero(gap > LONGEST)
    extra = [np.arange(cuts[i] + LONGEST + 1, cuts[i] + gap[i]) for i in long]
    return np.sort(np.concatenate([cuts, *extra])) if extra else cuts


def ordered(strings: list[bytes]) -> np.ndarray:
    """The strings in an order in which those that start with the same bytes stand together, by a suffix array of phrases.

    Phrases are cut alike in strings as far as these are alike, and ranked as strings of bytes.
    """
    sizes = np.array([len(x) for x in strings], np.int64)
    full = np.flatnonzero(sizes)
    data = np.frombuffer(b"".join(strings), np.uint8)
    if not len(data):
        return np.arange(len(strings))
    begins = (np.cumsum(sizes) - sizes)[full]
    cuts = phrases_of(data, begins)
    long = np.diff(np.r_[cuts, len(data)])
    wide = np.zeros((len(cuts), int(long.max())), np.uint8)
    row = np.repeat(np.arange(len(cuts)), long)
    wide[row, np.arange(len(data)) - np.repeat(cuts, long)] = data + np.uint8(1)  # UTF-8 has no byte 255; 0 fills up
    _, rank = np.unique(wide.view(f"S{wide.shape[1]}").ravel(), return_inverse=True)
    # Symbols: 0 at the very end, 1 after each string, phrases from 2.
    owner = np.searchsorted(begins, cuts, side="right") - 1
    at = np.arange(len(cuts)) + owner
    symbols = np.ones(len(cuts) + len(full) + 1, np.int64)
    symbols[-1], symbols[at] = 0, rank + 2
    head = np.full(len(symbols), -1)
    head[at[np.searchsorted(cuts, begins)]] = full
    order = head[np.asarray(suffix_array(symbols.tolist()))]
    return np.r_[np.flatnonzero(sizes == 0), order[order >= 0]]


def shared_by_neighbours(strings: list[bytes], order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many bytes each string shares with the one before it in the order; -1 where the key changes."""
    sizes = np.array([len(x) for x in strings], np.int64)[order]
    out = np.full(len(order), -1)
    width = max(1, int(sizes.max(initial=0)))
    for a in range(0, len(order), 4096):
        part = order[max(0, a - 1) : a + 4096]
        wide = np.frombuffer(b"".join(strings[k].ljust(width, b"\0") for k in part), np.uint8).reshape(len(part), width)
        differ = wide[1:] != wide[:-1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        out[a + (a == 0) : a + 4096] = first
    out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    out[np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])] = -1
    return out


def repeated_windows(contexts: list[bytes], keys: np.ndarray, anchors: np.ndarray, length: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of contexts that occur in another context of their key: (context, start within it).

    ``anchors`` has each context's anchor place within it; equal windows lie equally far from it, ``low`` to ``high`` bytes before.
    """
    n = len(contexts)
    right = [c[a : a + length] for c, a in zip(contexts, anchors.tolist(), strict=True)]
    left = [c[:a][::-1][:length] for c, a in zip(contexts, anchors.tolist(), strict=True)]
    every = ordered(right + left)
    sides = []
    for strings, order in ((right, every[every < n]), (left, every[every >= n] - n)):
        order = order[np.argsort(keys[order], kind="stable")]
        sides.append((order, shared_by_neighbours(strings, order, keys)))
    sizes = np.array([len(c) for c in contexts], np.int64)
    least, most = np.maximum(low, anchors - (sizes - length)), np.minimum(high, anchors)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    after, before = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        own = np.flatnonzero((least <= d) & (d <= most))
        for (order, shared), number, out in ((sides[0], length - d, after), (sides[1], d, before)):
            out[order] = np.cumsum(shared < number)
        _, where, count = np.unique(before[own] * (n + 1) + after[own], return_inverse=True, return_counts=True)
        again = own[count[where] > 1]
        found.append((again, anchors[again] - d))
    context, start = map(np.concatenate, zip(*found, strict=True))
    by = np.lexsort((start, context))
    return context[by], start[by]


MEMBER = np.dtype([("id", "<i8"), ("mark", "<i8"), ("first", "<i4"), ("last", "<i4"), ("place", "<i4")])
CONTEXT = ["id", "mark", "key", "k", "n", "first", "anchor", "low", "high", "bytes"]
CONTEXT_SCHEMA = "id long, mark long, key long, k long, n long, first int, anchor int, low int, high int, bytes binary"
KINDS = (*[pa.int64()] * 5, *[pa.int32()] * 4, pa.binary())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(keyed: DataFrame, placed: DataFrame, length: int) -> DataFrame:
    """Rows (__id, __mark, __text, others) to (id, mark, spans: array<struct<a, b>>), bytes a to b being repeated; only rows that have any.

    ``placed`` has the same rows, dealt by __id and __mark.
    """

    def fingerprint(batches):
        powers = Powers()
        for batch in batches:
            ids, marks, who, columns = *(np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1)), [], [[] for _ in range(5)]
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = (text or "").encode("utf-8")
                if len(data) >= length:
                    found = runs_of(data, length, powers)
                    who.append(np.full(len(found[0]), i))
                    for c, v in zip(columns, found, strict=True):
                        c.append(v)
            if not who:
                continue
            who = np.concatenate(who)
            first, last, place, seed, context = (np.concatenate(c) for c in columns)
            order = np.lexsort((context, seed))
            member = np.rec.fromarrays([ids[who], marks[who], first, last, place], dtype=MEMBER)[order]
            seed, context = seed[order], context[order]
            begin = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (context[1:] != context[:-1])])
            ends = np.r_[begin[1:], len(order)]
            members = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((np.r_[begin, len(order)] * MEMBER.itemsize).astype(np.int32)), pa.py_buffer(member.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(seed[begin].view(np.int64)), pa.array(context[begin].view(np.int64)), pa.array(ends - begin), members], ["seed", "context", "n", "members"])

    def told(batches):
        """Members as rows."""
        for batch in batches:
            blobs = batch.column("members").to_pylist()
            each = np.frombuffer(b"".join(blobs), MEMBER)
            row = pa.array(np.repeat(np.arange(len(blobs)), [len(b) // MEMBER.itemsize for b in blobs]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("seed", "k", "n")), *(pa.array(np.ascontiguousarray(each[c])) for c in MEMBER.names)], ["seed", "k", "n", *MEMBER.names])

    # Equal contexts of a batch travel as one row, so a stretch that a third of the texts share is a row a batch.
    runs = keyed.select("__id", "__mark", "__text").mapInArrow(lean(fingerprint), "seed long, context long, n long, members binary")
    often = cut(runs.withColumn("k", F.sum("n").over(Window.partitionBy("seed"))).where("k > 1").drop("k"))
    flat = "seed long, k long, n long, id long, mark long, first int, last int, place int"
    classes = often.groupBy("seed", "context").agg(F.sum("n").alias("n"), F.min(F.substring("members", 1, MEMBER.itemsize)).alias("members"))
    several = classes.groupBy("seed").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    edges = cut(classes.join(several, "seed").select("seed", "k", "n", "members").mapInArrow(lean(told), flat))
    twice = often.select("seed", "context", "members").join(classes.where("n > 1").select("seed", "context", "n"), ["seed", "context"])
    whole = twice.select("seed", F.lit(0).cast("long").alias("k"), "n", "members").mapInArrow(lean(told), flat).select("id", "mark", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    facts = edges.agg(F.coalesce(F.sum(F.col("last") - F.col("first") + length), F.lit(0)).alias("n"), F.coalesce(F.max("k"), F.lit(0)).alias("k")).first()
    asked = edges.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_list(F.struct("seed", "k", "n", "first", "last", "place")).alias("edges"))  # of one document

    def contexts(batches):
        for batch in batches:
            rows = []
            for i, m, text, own in zip(*(batch.column(c).to_pylist() for c in ("__id", "__mark", "__text", "edges")), strict=True):
                data = (text or "").encode("utf-8")
                rows += [(i, m, e["seed"], e["k"], e["n"], e["first"], e["place"] - e["first"], 0, length - length // 2, data[e["first"] : e["last"] + length]) for e in own]
            columns = list(zip(*rows, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], CONTEXT)

    def halves(batches):
        for batch in batches:
            rows = []
            for i, m, key, k, n, first, anchor, low, high, data in zip(*(batch.column(c).to_pylist() for c in CONTEXT), strict=True):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    if max(a, anchor - (len(data) - length)) <= min(b, anchor):
                        shared = xxhash.xxh3_64_intdigest(data[anchor - a : anchor + length - b], key & (2**64 - 1) ^ a)
                        rows.append((i, m, shared - (shared >> 63 << 64), k, n, first, anchor, a, b, data))
            columns = list(zip(*rows, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], CONTEXT)

    def match(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, keys = np.unique(np.asarray(table.column("key")), return_inverse=True)
        anchors, low, high = (np.asarray(table.column(c)).astype(np.int64) for c in ("anchor", "low", "high"))
        context, start = repeated_windows(table.column("bytes").to_pylist(), keys, anchors, length, low, high)
        single = np.asarray(table.column("n"))[context] == 1  # the others are repeated whole
        context, start = context[single], start[single]
        begin = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (start[1:] != start[:-1] + 1)][: len(context)])
        stop = np.r_[begin[1:], len(context)] - 1 if len(begin) else begin
        first = np.asarray(table.column("first")).astype(np.int64)
        ids, marks = np.asarray(table.column("id"))[context[begin]], np.asarray(table.column("mark"))[context[begin]]
        a, b = first[context[begin]] + start[begin], first[context[begin]] + start[stop] + length
        return pa.table([pa.array(ids), pa.array(marks), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["id", "mark", "a", "b"])

    def matched(rows: DataFrame, size: int) -> DataFrame:
        bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-size // BUCKET_BYTES)))).alias("bucket")
        return rows.select("*", bucket).groupBy("bucket").applyInArrow(lean_group(match), "id long, mark long, a int, b int")

    rows = placed.join(asked, ["__id", "__mark"]).mapInArrow(lean(contexts), CONTEXT_SCHEMA)
    found = whole.unionByName(matched(rows.where(F.col("k") <= MANY), facts["n"]))
    level = rows.where(F.col("k") > MANY).drop("k") if facts["k"] > MANY else None
    while level is not None:  # ends, as places are halved each time
        level = cut(level.withColumn("k", F.lit(0).cast("long")).mapInArrow(lean(halves), CONTEXT_SCHEMA).drop("k"))
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        level = cut(level.join(sizes, "key"))
        alone = F.col("low") == F.col("high")  # the key is the window: all that have it repeat it
        at = F.col("first") + F.col("anchor") - F.col("low")
        found = found.unionByName(level.where(alone).select("id", "mark", at.cast("int").alias("a"), (at + length).cast("int").alias("b")))
        few = level.where(~alone & (F.col("k") <= MANY))
        size = few.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0)).alias("n")).first()["n"]
        if size:
            found = found.unionByName(matched(few, size))
        level = level.where(~alone & (F.col("k") > MANY)).drop("k")
        if level.isEmpty():
            break
    return found.groupBy("id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def split_repeats(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """The columns ``keep`` of every document with the text left (``kept``) and the removed spans of bytes; or their digests and the text left (``text``).

    A character that a span cuts in two is left out of the text; digests take bytes.
    """
    # What repeats in a text depends on the text alone, so rows with equal keys and texts may share spans.
    text = text_of(docs)
    others = [c for c in keep if c != "text"]
    keyed = docs.select(*others, F.coalesce(docs["doc_id"].cast("long"), F.lit(0)).alias("__id"), F.xxhash64(text).alias("__mark"), docs["text"].cast("string").alias("__text"))
    placed = keyed.repartition("__id", "__mark")  # the texts cross the network once, for both joins
    spans = repeated_spans(keyed, placed, length).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("spans").alias("__spans"))

    def run(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("__text").to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                data = (text or "").encode("utf-8")
                spans = merged([(s["a"], s["b"]) for s in found or ()])
                kept = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(data)], strict=True))
                left = kept.decode("utf-8", "ignore")
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), left) if digests else (left, [{"a": a, "b": b} for a, b in spans]))
            columns = list(zip(*rows, strict=True)) or [()] * (5 if digests else 2)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()) if digests else (pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text"] if digests else ["kept", "removed"]
            yield pa.RecordBatch.from_arrays([*(batch.column("__text" if c == "text" else c) for c in keep), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [*keep, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    out = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string" if digests else "kept string, removed array<struct<a:int,b:int>>"
    return placed.join(spans, ["__id", "__mark"], "left").mapInArrow(lean(run), f"{kinds}, {out}")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that occur elsewhere, as digests."""
    return split_repeats(read(spark, sf_dir, "documents"), LENGTH, digests=True)
