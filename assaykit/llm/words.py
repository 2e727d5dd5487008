"""Words of many texts as 64-bit hashes, worked out on whole columns of bytes."""

from __future__ import annotations

import re

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 20  #: longer texts are read in pieces of about so many characters, cut at white space
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
WIDE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WIDE_SPACE = re.compile("[" + "".join(map(chr, WIDE)) + "]")
WIDE_BYTES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")  #: one of these is in the UTF-8 of each of them
ANY_SPACE = re.compile(r"\s")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Polynomial fingerprints modulo 2**64 of any stretch of bytes, by prefix sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            for name, base in (("up", int(ODD)), ("down", pow(int(ODD), -1, 1 << 64))):
                setattr(self, name, np.cumprod(np.r_[np.uint64(1), np.full(n + n // 4, base, np.uint64)]))
        out = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: n - 1], out=out[1:])
        return out

    def stretch(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((prefix[b] - prefix[a]) * self.down[a])


def pieces(texts: list[str]):
    """The texts in order as (index, piece), long ones cut at white space."""
    for k, text in enumerate(texts):
        at = 0
        while len(text) - at > PIECE:
            found = ANY_SPACE.search(text, at + PIECE)
            stop = found.start() if found else len(text)
            yield k, text[at:stop]
            at = stop
        yield k, text[at:] if at else text


def word_hashes(texts: list[str], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (what stands between white space) in order, and how many words each text has."""
    sizes, found = np.zeros(len(texts), np.int64), [np.empty(0, np.uint64)]
    group: list[tuple[int, str]] = []
    size = 0

    def flush():
        nonlocal size
        encoded = [t.encode("utf-8", "replace") for _, t in group]
        data = b"\n".join(encoded)
        if not data.isascii() and any(w in data for w in WIDE_BYTES):
            encoded = [WIDE_SPACE.sub(" ", t).encode("utf-8", "replace") for _, t in group]
            data = b"\n".join(encoded)
        raw = np.frombuffer(data, np.uint8)
        edge = np.diff(np.r_[True, SPACE[raw], True].view(np.int8))
        start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        found.append(powers.stretch(powers.prefix(raw), start, stop))
        ends = np.cumsum([len(e) + 1 for e in encoded])
        np.add.at(sizes, [k for k, _ in group], np.diff(np.searchsorted(start, ends), prepend=0))
        group.clear()
        size = 0

    for k, text in pieces(texts):
        group.append((k, text))
        size += len(text)
        if size >= PIECE:
            flush()
    if group:
        flush()
    return np.concatenate(found), sizes
