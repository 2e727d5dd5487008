"""Byte-level BPE encoding and decoding by longest matches with backtracking.

The encoder walks from the longest vocabulary entry at a position and steps back to shorter
ones when two neighbours are not what the merges would leave side by side; each position fails
at most once, so the walk is linear. Whether two tokens may be neighbours is worked out once by
the merges themselves and memoised. Ranks are those of merges as they were learnt: an entry that
merges can make at all is made last, from two that rank before it.

Texts are taken many at a time. What the memo of chunks does not know is cut into pieces, and
the different pieces walk side by side, a step of all at once: a trie in a table finds the longest
entries from all their positions, and further tables hold what is shorter and which neighbours
go together. Pieces longer than ``SHORT`` bytes walk alone: their bytes become Latin-1
characters, so one Aho-Corasick pass finds the longest entry from every position.

Defined results: null or empty text has no ids and decodes to nothing; texts of any length
are whole; repeated rows repeat; an empty table gives no rows; columns other than the id
and text columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import TwoGenerations, read, text_of
from .words import ODD

#: A space between white space on both sides (or before the end): there the cut at spaces may differ from the pattern.
RUN_OF_SPACE = re.compile(r"\s (?=\s|\Z)")
CHUNKS, PAIRS, PAIR_BITS = 200_000, 200_000, 21
SHORT, TOGETHER = 60, 100_000  #: bytes of a piece that walks with others; pieces that walk together
SLICE = 2_000_000  #: characters of the texts that are encoded together, or one text
#: Chunks of these letters alone are one piece with their space.
LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
NONE = 0xFFFFF  #: stands before the first token; ids are smaller


def chunks_of(text: str) -> list[str] | None:
    """The text cut before its spaces, the space dropped; None where the cut could split a match of the pattern."""
    return None if RUN_OF_SPACE.search(text) else text.split(" ")


class Table:
    """Whole numbers from 0 up by keys from 0 up, in open addressing, many keys at a time."""

    def __init__(self, bits: int):
        self.shift, self.last, self.held = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * ODD >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self.places(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = place = (at[left] + 1) & self.last
            there = self.keys[place]
            hit = there == keys[left]
            out[left[hit]] = self.values[place[hit]]
            left = left[~hit & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys, not there yet; a table that would be over half full is emptied first."""
        if self.held + len(keys) > self.last // 2:
            self.keys.fill(-1)
            self.held = 0
        self.held += len(keys)
        at = self.places(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self.last


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """The merges of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.trie.add_word(token.decode("latin-1"), (i, len(token)))
        self.trie.make_automaton()
        self.pair = TwoGenerations(self._compatible, PAIRS).get
        self.alone = TwoGenerations(lambda i: self.merged(self.bytes_of[i]) == [self.bytes_of[i]], PAIRS).get
        self.last = TwoGenerations(lambda token: self._edges(token, -1), PAIRS).get
        self.first = TwoGenerations(lambda token: self._edges(token, 0), PAIRS).get
        self.shorter = TwoGenerations(self._shorter, PAIRS).get
        self.sizes = {i: len(token) for token, i in ranks.items()}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        size = max(self.bytes_of, default=-1) + 1
        if size > NONE:
            raise ValueError("ids are too large")
        self.length = np.zeros(size, np.int64)
        for i, token in self.bytes_of.items():
            self.length[i] = len(token)
        self.start = np.cumsum(self.length) - self.length
        self.table = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.names = [str(i) for i in range(size)]
        self.step, self.entry, self.less = self._tables(size)
        self.neighbours = Table(PAIR_BITS)

    def _tables(self, size: int) -> tuple[Table, np.ndarray, np.ndarray]:
        """The trie's steps (node << 8 | byte to node), the id at each node or -1, the next shorter entry of each id or -1."""
        steps: dict[int, int] = {}
        entry, less = [-1], np.full(size, -1, np.int32)
        for token in sorted(self.ranks):  # what a token starts with comes before it
            node, longest = 0, -1
            for byte in token:
                child = steps.setdefault(node << 8 | byte, len(entry))
                if child == len(entry):
                    entry.append(-1)
                node = child
                if entry[node] >= 0:
                    longest = entry[node]
            entry[node], less[self.ranks[token]] = self.ranks[token], longest
        table = Table(max(10, (4 * len(steps)).bit_length()))
        table.put(np.fromiter(steps.keys(), np.int64, len(steps)), np.fromiter(steps.values(), np.int32, len(steps)))
        return table, np.array(entry, np.int32), less

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[bytes]:
        """The merges carried out one by one, lowest rank first, while it is under ``below``; only for short strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: bytes, side: int) -> list[bytes]:
        """What stands at the token's last (side -1) or first (0) place while it is merged, from a byte up to itself."""
        out = [token]
        while len(token) > 1:
            token = self.merged(token, self.ranks[token])[side]
            out.append(token)
        return out[::-1]

    def _compatible(self, key: int) -> bool:
        """Whether merging both strings together leaves just these two tokens.

        Before a token is whole, shorter tokens stand at its edge, each until the merge that makes
        the next one. The two may be neighbours unless, at some time, the tokens at the boundary
        would merge before either of them changes (the left side goes first at equal ranks).
        """
        if not self.alone(key & 0xFFFFF):  # merges inside it make something else of the right one
            return False
        ranks, never = self.ranks, 1 << 60
        left, right = self.last(self.bytes_of[key >> 20]), self.first(self.bytes_of[key & 0xFFFFF])
        i = j = 0
        while True:
            next_left = ranks[left[i + 1]] if i + 1 < len(left) else never
            next_right = ranks[right[j + 1]] if j + 1 < len(right) else never
            both = ranks.get(left[i] + right[j], never)
            if both < next_left and both <= next_right and both < never:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _shorter(self, i: int) -> int:
        """The longest vocabulary entry that is a proper prefix, or -1."""
        token = self.bytes_of[i]
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, (i, n) in self.trie.iter(piece.decode("latin-1")):
            longest[end - n + 1] = i  # ends come in order, so the longest stays
        size, shorter, pair = self.sizes, self.shorter, self.pair
        out: list[int] = []
        dead: set[int] = set()
        at, stop, token = 0, len(piece), longest[0]
        while at < stop:
            while token >= 0:
                end = at + size[token]
                if end not in dead and (pair(out[-1] << 20 | token) if out else self.alone(token)):
                    break
                token = shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < stop else -1
                continue
            if not out:
                raise ValueError(f"the vocabulary cannot spell {piece!r}")
            dead.add(at)
            last = out.pop()
            at -= size[last]
            token = shorter(last)
        return out

    def _longest(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest entry from every byte, -1 where there is none; ``ends`` has the end of each byte's piece."""
        longest = np.full(len(data), -1, np.int32)
        at, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        to = at
        while len(at):
            node = self.step.get(node << 8 | data[to]).astype(np.int64)
            on = node >= 0
            at, node, to = at[on], node[on], to[on] + 1
            token = self.entry[node]
            longest[at[token >= 0]] = token[token >= 0]
            more = to < ends[at]
            at, node, to = at[more], node[more], to[more]
        return longest

    def _together(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each token may stand after the one before it."""
        keys = before.astype(np.int64) << 20 | tokens
        got = self.neighbours.get(keys)
        unknown = np.flatnonzero(got < 0)
        if len(unknown):
            new, where = np.unique(keys[unknown], return_inverse=True)
            found = np.array([self.alone(k & 0xFFFFF) if k >> 20 == NONE else self._compatible(k) for k in new.tolist()], np.int32)
            got[unknown] = found[where]
            self.neighbours.put(new, found)
        return got > 0

    def _walk(self, pieces: list[bytes]) -> list[str]:
        """The ids of short pieces, none of them an entry itself, in decimal, joined by commas."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        longest = self._longest(data, np.repeat(begin + sizes, sizes))
        n = len(pieces)
        out = np.full((n, int(sizes.max(initial=0)) + 1), NONE, np.int32)  # the first column stands before all tokens
        at, depth, dead, token = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), longest[begin]
        live = np.arange(n)
        while len(live):
            stuck = live[token[live] < 0]
            if len(stuck):
                if not depth[stuck].all():
                    raise ValueError(f"the vocabulary cannot spell {pieces[stuck[depth[stuck] == 0][0]]!r}")
                dead[stuck] |= np.int64(1) << at[stuck]
                last = out[stuck, depth[stuck]]
                depth[stuck] -= 1
                at[stuck] -= self.length[last]
                token[stuck] = self.less[last]
                live = live[token[live] >= 0]  # those that are stuck again come back below
                again = stuck[token[stuck] < 0]
            else:
                again = stuck
            tokens = token[live]
            end = at[live] + self.length[tokens]
            good = (dead[live] >> end & 1) == 0
            good[good] = self._together(out[live[good], depth[live[good]]], tokens[good])
            on, end = live[good], end[good]
            depth[on] += 1
            out[on, depth[on]] = tokens[good]
            at[on] = end
            more = end < sizes[on]
            token[on[more]] = longest[begin[on[more]] + end[more]]
            token[live[~good]] = self.less[tokens[~good]]
            live = np.concatenate([on[more], live[~good], again])
        ids = out[:, 1:][np.arange(out.shape[1] - 1) < depth[:, None]].tolist()
        names, stops = [self.names[i] for i in ids], np.cumsum(depth).tolist()
        return [",".join(names[a:b]) for a, b in zip([0, *stops], stops, strict=False)]

    def spell(self, pieces: list[str]) -> dict[str, str]:
        """The ids of different pieces, in decimal, joined by commas."""
        out, walking, walked = {}, [], []
        bytes_of = [p.encode() for p in pieces]
        for piece, data, whole in zip(pieces, bytes_of, map(self.ranks.get, bytes_of), strict=True):
            if whole is not None:
                out[piece] = self.names[whole]
            elif len(data) > SHORT:
                out[piece] = ",".join(map(str, self.encode_piece(data)))
            else:
                walking.append(piece)
                walked.append(data)
        for a in range(0, len(walking), TOGETHER):
            out.update(zip(walking[a : a + TOGETHER], self._walk(walked[a : a + TOGETHER]), strict=True))
        return out

    def encode_many(self, texts: list[str]) -> list[str]:
        """The ids of each text, in decimal, joined by commas."""
        if len(self.young) > CHUNKS:
            self.old, self.young = self.young, {}
        young, old, pieces_of = self.young, self.old, self.pattern.findall
        heads, rests, chunks, pieces = [], [], set(), set()
        for text in texts:
            parts = chunks_of(text)
            heads.append(pieces_of(text if parts is None else parts[0]))
            rests.append([] if parts is None else parts[1:])
            pieces.update(heads[-1])
            chunks.update(rests[-1])
        chunks.difference_update(young)
        known = [c for c in chunks if c in old]
        young.update(zip(known, map(old.pop, known), strict=True))
        chunks.difference_update(known)
        plain = list(filter(LETTERS.fullmatch, chunks))
        chunks.difference_update(plain)
        spaced, others = [" " + c for c in plain], [pieces_of(" " + c) for c in chunks]
        pieces.update(spaced, *others)
        spelled = self.spell(list(pieces))
        young.update(zip(plain, map(spelled.__getitem__, spaced), strict=True))
        young.update(zip(chunks, [",".join([spelled[p] for p in own]) for own in others], strict=True))
        return [",".join([*map(spelled.__getitem__, head), *map(young.__getitem__, rest)]) for head, rest in zip(heads, rests, strict=True)]

    def encode(self, text: str) -> str:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered from one table."""
        n = self.length[ids]
        total = int(n.sum())
        return self.table[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(total)].tobytes()


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def ids_of(joined: str) -> np.ndarray:
    return np.fromstring(joined, dtype=np.int64, sep=",") if joined else np.empty(0, np.int64)


def encode_table(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id with ids array<int> and the decoded bytes; with ``digests`` their count and SHA-256 instead.

    Digests are taken where the ids are, so long id lists need not leave the worker.
    """

    def run(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            stops = np.r_[np.flatnonzero(np.diff(ends // SLICE)) + 1, len(texts)].tolist()
            joined = [j for a, b in zip([0, *stops], stops, strict=False) for j in bpe.encode_many(texts[a:b])]
            ids = [ids_of(j) for j in joined]
            back = [bpe.decode(i) for i in ids]
            if digests:
                columns = [
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                columns = [pa.array([i.tolist() for i in ids], pa.list_(pa.int32())), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded binary"
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the multilingual ranks and decoded again, as digests."""
    import public_tokenizers

    return encode_table(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
