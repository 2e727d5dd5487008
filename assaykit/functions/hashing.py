"""Hash-keyed folds, orders and fingerprints: the same on any partitioning."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, functions as F


def first_64_bits(text: Column) -> Column:
    """The first eight bytes of SHA-256, as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_fold(text: Column, folds: int) -> Column:
    """A fold of a canonical key."""
    if folds < 2:
        raise ValueError("folds must be 2 or more")
    return (first_64_bits(text) % folds).cast("int")


def stable_order(seed: int, *parts: Column) -> Column:
    """A pseudo-random but reproducible sort key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def derived_seed(seed: int, epoch: int, namespace: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{epoch}:{namespace}".encode()).digest()[:8], "big")


def key_set_digest(key: Column) -> Column:
    """An aggregate over a set of keys that does not depend on their order."""
    return F.sha2(F.to_json(F.array_sort(F.collect_set(key))), 256)


def canonical_json_sha256(value) -> str:
    """Of a small driver-side value: sorted keys, no spaces, no NaN."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()
