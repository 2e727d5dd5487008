"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is a bag of five-word shingles (all its words where there are fewer), each weighing
its count times an inverse document frequency. Samples of the bag are drawn by improved consistent
weighted sampling and joined to bands; documents with an equal band are candidates, and a pair is
linked if its weighted Jaccard similarity, worked out on whole bags, is ``SIMILARITY`` or more.
Classes are the connected components of the links.

Inverse document frequency: 1 + ln(1 / share) / ln(1 / RARE), share being the part of the
documents that have the shingle, from 1 (all have it) to 2 (a share of RARE or less), in eighths.
Shares over RARE are exact: first each block of documents names the shingles in more than
RARE / 2 of it, of which at most 2 / RARE times a document's mean shingles can matter; then these are counted.

Equal bags are one node, however many copies there are. Inside a bucket nobody is compared with
everybody. First each node meets one node, the likeliest of the first members of its buckets; that
joins most of what belongs together. Then, in each bucket whose nodes are in several classes, those
outside its largest class meet the others of other classes; a pair inside one class needs no
comparison. A bucket is dealt to a grid of slices of bounded bytes, so a task holds two slices of it
at most, and only links leave a task. There, ``DRAWS`` more samples, a byte each, are compared: fewer
than ``ALIKE`` equal ones rule a pair out (at similarity 0.8 that goes wrong for one pair in a
hundred million, where banding misses two in ten thousand), and so do total weights too far apart.
The pairs left are verified on whole bags, the most alike first, each in the first bucket that both
nodes are in; one that other links have joined meanwhile needs no more.

Defined results: words are lower-cased text between white space; documents without words
(null, empty) are classes of their own; equal texts and repeated rows share a class; a class is
named by its smallest doc_id (null if all are null); an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, lean, lean_group, read, text_of
from .words import ODD, Powers, mix, word_hashes

WORDS, SIMILARITY, RARE = 5, 0.8, 1e-3
BANDS, ROWS = 16, 4
DRAWS, ALIKE = 256, 166
TABLE = 1 << 14
EIGHTHS = 8  #: weights are whole numbers of eighths
BLOCK_DOCS, BLOCK_SHINGLES = 8192, 4_000_000  #: of a block that names its common shingles
SLICE, GROUP = 4_000_000, 16_000_000  #: bytes of a bucket's slice, and of the slices that share a group

Bag = tuple[np.ndarray, np.ndarray]


def bags(texts: list[str], powers: Powers) -> list[Bag]:
    """Each text's different shingles (64-bit hashes, ascending) and their counts."""
    word, sizes = word_hashes(texts, powers)
    long = mix(word[: max(0, len(word) - WORDS + 1)] + ODD)
    for k in range(1, WORDS):
        long = mix(long * ODD + word[k : k + len(long)])
    out, at = [], 0
    for n in sizes.tolist():
        own = long[at : at + n - WORDS + 1] if n >= WORDS else np.empty(0, np.uint64)
        if 0 < n < WORDS:
            whole = word[at : at + 1].copy()
            for k in range(1, n):
                whole = mix(whole * ODD + word[at + k : at + k + 1])
            own = mix(whole + np.uint64(n))
        own = np.sort(own)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
        out.append((own[first], np.diff(np.r_[first, len(own)])))
        at += n
    return out


def chunks(texts: list[str], most: int = 1_000_000):
    """Index ranges of about ``most`` characters."""
    a = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield a, k + 1
            a, size = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def all_bags(column: pa.Array, powers: Powers, rows: int = 512):
    """The bags of a column of texts, of which few are Python strings at a time."""
    for k in range(0, len(column), rows):
        texts = column.slice(k, rows).to_pylist()
        for a, b in chunks(texts):
            yield from bags(texts[a:b], powers)


def name_of(bag: Bag) -> bytes:
    """Equal bags have equal names."""
    return xxhash.xxh3_128_digest(bag[0].tobytes() + bag[1].astype("<i8").tobytes())


class Weights:
    """Inverse document frequencies in eighths: those of common shingles, 16 for all others."""

    def __init__(self, common: dict[int, int], documents: int):
        keys = np.array(sorted(common), np.uint64)
        share = np.array([common[int(k)] for k in keys], float) / max(1, documents)
        value = 1 + np.log(1 / np.clip(share, RARE, 1)) / math.log(1 / RARE)
        self.keys, self.value = keys, np.round(value * EIGHTHS).astype(np.int64)

    def of(self, bag: Bag) -> np.ndarray:
        """The weight of each shingle of a bag, in eighths."""
        hashes, count = bag
        out = np.full(len(hashes), 2 * EIGHTHS)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            out[hit] = self.value[at[hit]]
        return out * count


class Sampler:
    """Consistent samples of weighted bags: each draw takes an element and a weight step of it.

    The random numbers of a shingle and a draw (two gamma variables and a uniform one) come from
    the row of a table that its hash names. At the commonest weight the order of the rows' costs
    is worked out once for each draw, so that a bag's winner is the smallest of its rows' places.
    """

    def __init__(self, draws: int, seed: int):
        rng = np.random.default_rng(seed)
        self.r, self.c, self.beta = (np.empty((TABLE, draws), np.float32) for _ in range(3))
        self.row_at, self.place = (np.empty((TABLE, draws), np.uint16) for _ in range(2))  # by draw: rows from the cheapest, and each row's place among them
        self.usual, self.draws, rows = 2 * EIGHTHS, np.arange(draws), np.arange(TABLE)
        for d in range(draws):
            self.r[:, d], self.c[:, d], self.beta[:, d] = rng.gamma(2, 1, TABLE), rng.gamma(2, 1, TABLE), rng.uniform(0, 1, TABLE)
            order = np.argsort(self.at(rows, self.usual, d)[0], kind="stable")
            self.row_at[:, d], self.place[order, d] = order, rows

    def at(self, row: np.ndarray, weight: np.ndarray | int, draw: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Costs and steps of rows at a weight in eighths."""
        r, beta = self.r[row, draw], self.beta[row, draw]
        step = np.floor(np.log(np.float32(weight) / np.float32(EIGHTHS)) / r + beta)
        return np.log(self.c[row, draw]) - r * (step - beta) - r, step.astype(np.int32)

    def samples(self, hashes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One hash for each draw, of the element and the step that win."""
        row = (mix(hashes) % np.uint64(TABLE)).astype(np.int64)
        plain = weight == self.usual
        n = len(self.draws)
        cost, step, best = np.full(n, np.inf, np.float32), np.zeros(n, np.int32), np.zeros(n, np.int64)
        if (usual := np.flatnonzero(plain)).size:
            own = row[usual]
            least = np.min([self.place[own[a : a + 8192]].min(0) for a in range(0, len(own), 8192)], axis=0)
            won = self.row_at[least, self.draws].astype(np.int64)
            order = np.argsort(own, kind="stable")  # of several elements of a row the smallest hash
            best = usual[order[np.searchsorted(own[order], won)]]
            cost, step = self.at(won, self.usual, self.draws)
        odd = np.flatnonzero(~plain)
        for a in range(0, len(odd), 2048):
            part = odd[a : a + 2048]
            costs, steps = self.at(row[part][:, None], weight[part][:, None], self.draws[None, :])
            least = costs.argmin(0)
            found = costs[least, self.draws]
            better = (found < cost) | ((found == cost) & (part[least] < best))
            cost, step, best = np.where(better, found, cost), np.where(better, steps[least, self.draws], step), np.where(better, part[least], best)
        return mix(hashes[best] + mix(step.astype(np.int64).astype(np.uint64) + np.uint64(1)))


def band_keys(samples: np.ndarray) -> np.ndarray:
    key, by = mix(np.arange(BANDS).astype(np.uint64) + np.uint64(77)), samples.reshape(BANDS, ROWS)
    for k in range(ROWS):
        key = mix(key * ODD + by[:, k])
    return key


def similarity(a: Bag, b: Bag) -> float:
    """Weighted Jaccard similarity of two bags (keys, weights)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][ia], b[1][ib]).sum())
    all_ = int(a[1].sum()) + int(b[1].sum()) - both
    return both / all_ if all_ else 0.0


def packed(hashes: np.ndarray, weight: np.ndarray) -> bytes:
    """A bag for the way: the upper 48 bits of its keys, and its weights."""
    keys = np.ascontiguousarray(hashes.astype("<u8").view("u1").reshape(-1, 8)[:, 2:]).tobytes()
    return len(hashes).to_bytes(4, "little") + keys + pa.compress(weight.astype("<u4").tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> Bag:
    n = int.from_bytes(data[:4], "little")
    keys = np.zeros((n, 8), "u1")
    keys[:, 2:] = np.frombuffer(data, "u1", 6 * n, 4).reshape(n, 6)
    return keys.view("<u8").ravel(), np.frombuffer(pa.decompress(data[4 + 6 * n :], 4 * n, "zstd", asbytes=True), "<u4").astype(np.int64)


def common_shingles(texts: DataFrame) -> Weights:
    """The weights: exact document counts of every shingle in a share of RARE or more of the documents."""

    def named(batches):
        powers = Powers()

        def often(own, docs):
            own.sort()
            least = max(1, math.ceil(RARE / 2 * docs))
            begins = own[: max(0, len(own) - least + 1)] == own[least - 1 :]  # equal to the one that many places on
            begins[1:] &= own[1 : len(begins)] != own[: max(0, len(begins) - 1)]
            keys = own[: len(begins)][begins]
            count = np.searchsorted(own, keys, "right") - np.flatnonzero(begins)
            return pa.RecordBatch.from_arrays([pa.array(np.r_[keys.view(np.int64), 0]), pa.array(np.r_[count, 0]), pa.array(np.r_[np.zeros(len(keys), np.int64), docs])], ["h", "n", "docs"])

        # A full block waits for the next one: the few documents left at the end would name every shingle, so they join it.
        buffer, used, docs, full, full_docs = np.empty(2 * BLOCK_SHINGLES, np.uint64), 0, 0, 0, 0
        for batch in batches:
            for hashes, _ in all_bags(batch.column("text"), powers):
                if not len(hashes):
                    continue
                if used + len(hashes) > len(buffer):
                    buffer = np.concatenate([buffer[:used], np.empty(len(hashes) + BLOCK_SHINGLES, np.uint64)])
                buffer[used : used + len(hashes)] = hashes
                used, docs = used + len(hashes), docs + 1
                if docs >= BLOCK_DOCS or used - full >= BLOCK_SHINGLES:
                    if full:
                        yield often(buffer[:full], full_docs)
                        buffer[: used - full] = buffer[full:used]
                    used, full, full_docs, docs = used - full, used - full, docs, 0
        if used:
            yield often(buffer[:used], full_docs + docs)

    # Few large blocks, as a block of few documents would name every shingle; joining partitions moves no rows.
    blocks = max(1, texts.count() // BLOCK_DOCS)
    found = cut(texts.select("text").coalesce(blocks).mapInArrow(lean(named), "h long, n long, docs long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    total = found.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n")).first()["n"]
    wanted = found.where((F.col("n") >= RARE / 2 * total) & (F.col("n") > 1)).select("h").toArrow()  # bounded, see above
    wanted = np.sort(np.asarray(wanted.column("h")).view(np.uint64))
    if not len(wanted):
        return Weights({}, total)

    def exact(batches):
        powers, count = Powers(), np.zeros(len(wanted), np.int64)
        for batch in batches:
            for hashes, _ in all_bags(batch.column("text"), powers):
                at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                count[at[wanted[at] == hashes]] += 1
        hit = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[hit].view(np.int64)), pa.array(count[hit])], ["h", "n"])

    counted = texts.select("text").mapInArrow(lean(exact), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE * total).toArrow()
    return Weights(dict(zip(np.asarray(counted.column("h")).view(np.uint64).tolist(), counted.column("n").to_pylist(), strict=True)), total)


def components(links: DataFrame) -> DataFrame:
    """Links (u, v) to (node, label): the smallest node of each component, for all nodes that have a link.

    Large-star and small-star steps alternate until nothing changes.
    """
    edges, last = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    rows = edges.count()  # steps replace edges, and add at most one a node; it sizes files only
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct(), rows)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def equal_samples(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many samples each row of a shares with each row of b."""
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), DRAWS)


def bucket_links(table: pa.Table, threshold: float) -> pa.Table:
    """In each slice of a bucket, links between a row of the smaller classes (role 1) and a row of another class (role 0), as few as join them."""
    column = {c: np.asarray(table.column(c)) for c in ("band", "slice", "block", "role", "n", "label", "total")}
    every, packs, bands = sketches(table.column("sketch")), table.column("bag").to_pylist(), np.array(table.column("bands").to_pylist(), np.int64)
    order = np.lexsort((column["n"], column["role"], column["block"], column["slice"], column["band"]))
    keys = [column[c][order] for c in ("band", "slice", "block")]
    begins = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    parent: dict[int, int] = {}
    known: dict[int, Bag] = {}
    links: list[tuple[int, int]] = []

    def root(label: int) -> int:
        while (above := parent.get(label, label)) != label:
            parent[label] = label = parent.get(above, above)
        return label

    def bag(row: int) -> Bag:
        n = int(column["n"][row])
        if n not in known:
            known[n] = unpacked(packs[row])
        return known[n]

    for a, b in zip(begins, np.r_[begins[1:], len(order)], strict=True):
        own = order[a:b]
        low, all_ = own[column["role"][own] == 1], own[column["role"][own] == 0]
        pairs = []
        for c in range(0, len(low), 64):
            part = low[c : c + 64]
            x, y = column["total"][part][:, None], column["total"][all_][None, :]
            able = (column["label"][part][:, None] != column["label"][all_][None, :]) & (np.minimum(x, y) >= (threshold - 1e-9) * np.maximum(x, y))
            if able.any():
                same = equal_samples(every[part], every[all_])
                i, j = np.nonzero(able & (same >= ALIKE))
                common = bands[part[i]] == bands[all_[j]]
                here = bands[part[i], common.argmax(1)] == column["band"][own[0]]
                pairs.append((same[i, j][here], part[i][here], all_[j][here]))
        if not pairs:
            continue
        same, left, right = map(np.concatenate, zip(*pairs, strict=True))
        for k in np.argsort(-same.astype(np.int64), kind="stable").tolist():
            u, v = root(int(column["label"][left[k]])), root(int(column["label"][right[k]]))
            if u != v and similarity(bag(left[k]), bag(right[k])) >= threshold:
                parent[max(u, v)] = min(u, v)
                links.append((u, v))
        if len(known) > 100_000:
            known.clear()
    columns = list(zip(*links, strict=True)) or [(), ()]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, mark (a hash of the text) and class_number of every row.

    The number tells classes apart where an id that stands for several texts names more than one; it is null for rows without words.
    """
    texts = docs.select("doc_id", F.lower(text_of(docs)).alias("text"), F.xxhash64(text_of(docs)).alias("mark"))
    weights = common_shingles(texts)

    def sample(batches):
        sampler, powers = Sampler(BANDS * ROWS, 5), Powers()
        for batch in batches:
            rows = []
            for bag in all_bags(batch.column("text"), powers):
                if len(bag[0]):
                    weight = weights.of(bag)
                    rows.append((name_of(bag), band_keys(sampler.samples(bag[0], weight)).view(np.int64), int(weight.sum())))
                else:
                    rows.append((None, None, 0))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "mark", "node", "bands", "total"])

    def bag_of(batches):
        sampler, powers = Sampler(DRAWS, 6), Powers()
        for batch in batches:
            made = []
            for bag in all_bags(batch.column("text"), powers):
                if len(bag[0]):
                    weight = weights.of(bag)
                    made.append((name_of(bag), packed(bag[0], weight), (sampler.samples(bag[0], weight) >> np.uint64(56)).astype(np.uint8).tobytes()))
            columns = list(zip(*made, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["node", "bag", "sketch"])

    def likely(batches):
        for batch in batches:
            same = (sketches(batch.column("sketch")) == sketches(batch.column("other"))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(same.astype(np.int32))], ["u", "v", "same"]).filter(pa.array(same >= ALIKE))

    def compare(batches):
        for batch in batches:
            keep = [similarity(unpacked(a), unpacked(b)) >= threshold for a, b in zip(batch.column("bag").to_pylist(), batch.column("other").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    sampled = cut(texts.mapInArrow(lean(sample), f"doc_id {dict(docs.dtypes)['doc_id']}, mark long, node binary, bands array<long>, total long"))
    nodes = sampled.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("total").alias("total"))
    count = sampled.count()
    nodes = cut(nodes.withColumn("n", F.monotonically_increasing_id()), count)  # fixed from here on, as the rows are written
    places = nodes.select("n", F.explode("bands").alias("band"))
    shared = places.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("u")).where("k > 1").select("band", "u")
    buckets = cut(places.join(shared, "band"), BANDS * count)
    wanted = nodes.join(buckets.select("n").distinct(), "n", "left_semi")
    ids = cut(wanted.select("node", "doc_id"), count)
    rows = texts.join(ids.select("doc_id").distinct(), texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    made = rows.mapInArrow(lean(bag_of), "node binary, bag binary, sketch binary").join(ids.select("node"), "node", "left_semi")
    known = cut(made.groupBy("node").agg(F.first("bag").alias("bag"), F.first("sketch").alias("sketch")).join(nodes, "node").select("n", "bands", "total", "sketch", "bag"))

    # First each node meets one node.
    near = F.least("total", "all") >= (threshold - 1e-9) * F.greatest("total", "all")
    first = buckets.where("n <> u").select("u", F.col("n").alias("v")).distinct()
    first = first.join(known.select(F.col("n").alias("v"), "sketch", "total"), "v").join(known.select(F.col("n").alias("u"), F.col("sketch").alias("other"), F.col("total").alias("all")), "u")
    best = first.where(near).mapInArrow(lean(likely), "u long, v long, same int").groupBy("v").agg(F.max_by("u", F.struct("same", "u")).alias("u"))
    both = best.join(known.select(F.col("n").alias("v"), "bag"), "v").join(known.select(F.col("n").alias("u"), F.col("bag").alias("other")), "u")
    label = components(both.mapInArrow(lean(compare), "u long, v long"))

    # Then buckets of several classes are settled.
    member = buckets.select("band", "n").join(known.select("n", F.length("bag").alias("size")), "n").join(label.withColumnRenamed("node", "n"), "n", "left")
    member = cut(member.select("band", "n", F.col("size") + 500, F.coalesce("label", "n").alias("label")).toDF("band", "n", "size", "label"), BANDS * count)
    by = member.groupBy("band", "label").agg(F.sum("size").alias("size"))
    several = by.groupBy("band").agg(F.count(F.lit(1)).alias("labels"), F.sum("size").alias("size"), F.max(F.struct("size", "label")).alias("top")).where("labels > 1")
    grid = several.select("band", F.col("top.label").alias("major"), F.ceil(F.col("size") / SLICE).alias("slices"), F.ceil((F.col("size") - F.col("top.size")) / SLICE).alias("blocks"))
    open_ = member.join(grid, "band")
    deal = lambda column, parts: F.pmod(F.xxhash64("n", F.lit(column)), F.col(parts))
    whole = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    every = open_.select("band", "n", "size", "label", F.lit(0).alias("role"), deal("slice", "slices").alias("slice"), whole("blocks").alias("block"))
    few = open_.where("label <> major").select("band", "n", "size", "label", F.lit(1).alias("role"), whole("slices").alias("slice"), deal("block", "blocks").alias("block"))
    dealt = cut(every.unionByName(few))
    size = dealt.agg(F.sum("size").alias("n")).first()["n"]
    if size:
        groups = -(-size // GROUP)

        def settle(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            return bucket_links(table, threshold)

        group = F.pmod(F.xxhash64("band", "slice", "block"), F.lit(groups)).alias("group")
        joined = components(dealt.join(known, "n").select("*", group).groupBy("group").applyInArrow(lean_group(settle), "u long, v long"))
        renamed = label.withColumnRenamed("label", "old").join(joined.select(F.col("node").alias("old"), "label"), "old", "left").select("node", F.coalesce("label", "old").alias("label"))
        label = renamed.unionByName(joined.join(label, "node", "left_anti").select("node", "label"))
    classed = nodes.select("n", "node", "doc_id").join(label.withColumnRenamed("node", "n"), "n", "left").select("node", "doc_id", F.coalesce("label", "n").alias("label"))
    names = classed.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = classed.join(names, "label").select("node", "class_id", F.col("label").alias("class_number"))
    every = sampled.select("doc_id", "mark", "node").join(named, "node", "left")
    return every.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "mark", "class_number")


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id")
