"""Sequence dynamic programs behind Arrow: constrained alignment, pooling, lexicon covers and matching."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def uniform(frames: int, phones: int) -> list[tuple[int, int]]:
    out = []
    for k in range(phones):
        a = min(k * frames // phones, frames - 1)
        out.append((a, max(a + 1, (k + 1) * frames // phones)))
    return out


def constrained_viterbi(log_probs: np.ndarray, targets: list[int], blank: int) -> tuple[list[tuple[int, int]], bool]:
    """The best monotone path of frames through the targets, blanks between: (spans, whether it fell back to even spans).

    A blank is forced between equal neighbours. Of equal scores staying comes before advancing, and
    advancing before skipping a blank. Where no path exists the spans are even.
    """
    frames, phones = len(log_probs), len(targets)
    if not phones:
        return [], False
    states = [blank if s % 2 == 0 else targets[s // 2] for s in range(2 * phones + 1)]
    score = np.full(len(states), -np.inf)
    if not frames:
        return uniform(1, phones), True
    score[:2] = log_probs[0, states[0]], log_probs[0, states[1]]
    back = np.zeros((frames, len(states)), np.int8)
    skip = np.array([s > 1 and s % 2 == 1 and states[s] != states[s - 2] for s in range(len(states))])
    for t in range(1, frames):
        one, two = np.r_[-np.inf, score[:-1]], np.r_[-np.inf, -np.inf, score[:-2]]
        choices = np.stack([score, one, np.where(skip, two, -np.inf)])
        back[t] = choices.argmax(0)
        score = choices.max(0) + log_probs[t, states]
    s = len(states) - 2 if score[-2] >= score[-1] else len(states) - 1
    if not np.isfinite(score[s]):
        return uniform(frames, phones), True
    spans: list[list[int]] = [[frames, 0] for _ in targets]
    for t in range(frames - 1, -1, -1):
        if s % 2:
            span = spans[s // 2]
            span[0], span[1] = t, max(span[1], t + 1)
        s -= int(back[t, s])
    return [(a, b) for a, b in spans], False


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SPANS = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("fallback", T.BooleanType())])


@F.pandas_udf(SPANS)
def align_phones(log_probs: pd.Series, targets: pd.Series) -> pd.DataFrame:
    """array<array<double>> of frames by symbols (blank 0) and target ids to spans."""
    rows = []
    for p, t in zip(log_probs, targets, strict=True):
        spans, fell = constrained_viterbi(np.stack([np.asarray(f, float) for f in p]) if len(p) else np.empty((0, 1)), [int(x) for x in t], 0)
        rows.append(([{"start": a, "end": b} for a, b in spans], fell))
    return pd.DataFrame(rows, columns=["spans", "fallback"])


def pool_span(hidden: np.ndarray, logits: np.ndarray, span: tuple[int, int], target: int, frames: int) -> dict:
    """Mean and population spread of the hidden states, posterior, margin over the best rival, entropy share and duration share."""
    a, b = span
    part = hidden[a:b]
    z = logits[a:b] - logits[a:b].max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    mean = p.mean(0)
    rival = np.delete(mean, target).max() if len(mean) > 1 else 0.0
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1).mean() / math.log(max(2, p.shape[1]))
    return {"mean": part.mean(0), "std": part.std(0), "posterior": mean[target], "margin": mean[target] - rival, "entropy": entropy, "duration": (b - a) / frames}


def lexicon_covers(words: list[str], target: list[str], lexicon: dict[str, list[list[str]]], most: int = 2) -> list[list[list[str]]]:
    """Choices of one pronunciation per word that spell the target exactly, ``most`` at most."""
    found: list[list[list[str]]] = []
    dead: set[tuple[int, int]] = set()

    def walk(w: int, at: int, chosen: list[list[str]]) -> bool:
        if w == len(words):
            if at == len(target):
                found.append(list(chosen))
                return True
            return False
        if (w, at) in dead:
            return False
        any_ = False
        for phones in lexicon.get(words[w], ()):
            if target[at : at + len(phones)] == phones and len(found) < most:
                any_ |= walk(w + 1, at + len(phones), [*chosen, phones])
        if not any_:
            dead.add((w, at))
        return any_

    walk(0, 0, [])
    return found


def bipartite_matching(edges: dict) -> dict:
    """A maximum matching slot -> choice by augmenting paths; earlier choices of a slot are tried first."""
    taken: dict = {}

    def place(slot, seen: set) -> bool:
        for choice in edges[slot]:
            if choice not in seen:
                seen.add(choice)
                if choice not in taken or place(taken[choice], seen):
                    taken[choice] = slot
                    return True
        return False

    for slot in edges:
        place(slot, set())
    return {slot: choice for choice, slot in taken.items()}
