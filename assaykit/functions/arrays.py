"""Array expressions: windows, runs, padding, spans and score bands, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..schemas import SCORE_BANDS


def index_windows(n: Column, size: int = 50, overlap: int = 10) -> Column:
    """Windows [start, end) over n items; the last one ends at n: array<struct<start, end>>."""
    step = size - overlap
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int")), lambda k: F.least(k * step, n - size))))
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), F.least(s + size, n).cast("int").alias("end"))))


def run_starts(values: Column) -> Column:
    """Repeats of a neighbour dropped."""
    return F.filter(values, lambda x, i: (i == 0) | ~F.element_at(values, F.greatest(i, F.lit(1))).eqNullSafe(x))


def ctc_greedy(frames: Column, blank: int = 0) -> Column:
    """Repeats dropped, then blanks."""
    return F.filter(run_starts(frames), lambda x: x != blank)


def pad(values: Column, size: Column, fill) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(size - F.size(values), F.lit(0))))


def uniform_spans(frames: Column, phones: Column) -> Column:
    """Half-open spans that cover the frames evenly, one frame each at least; they overlap where frames are few."""

    def span(k):
        start = F.least(F.floor(k * frames / phones), frames - 1)
        end = F.greatest(F.floor((k + 1) * frames / phones), start + 1)
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    return F.when((frames > 0) & (phones > 0), F.transform(F.sequence(F.lit(0), phones - 1), span))


def score_band(score: Column, profile: str) -> Column:
    low, high = SCORE_BANDS[profile]
    return F.when(score < low, "low").when(score < high, "medium").otherwise("high")


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def position_suffixes(size: Column) -> Column:
    """S for a single phone, else B, I ..., E."""
    middle = F.array_repeat(F.lit("I"), F.greatest(size - 2, F.lit(0)))
    return F.when(size == 1, F.array(F.lit("S"))).when(size > 1, F.concat(F.array(F.lit("B")), middle, F.array(F.lit("E"))))


def review_priority(score: Column, label: Column, posterior: Column, margin: Column, entropy: Column) -> Column:
    """Three quarters score disagreement, one quarter alignment uncertainty, in [0, 1]."""
    uncertain = ((1 - posterior) + (1 - margin) / 2 + entropy) / 3
    raw = 0.75 * F.abs(score - 50 * label) / 100 + 0.25 * uncertain
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def span_seconds(start: Column, end: Column, frame: float, duration: Column) -> Column:
    """Frames to seconds within the audio; an empty span becomes the audio's last frame."""
    a, b = F.least(start * frame, duration), F.least(end * frame, duration)
    back = F.greatest(duration - frame, F.lit(0.0))
    return F.struct(F.when(b > a, a).otherwise(back).alias("start"), F.when(b > a, b).otherwise(duration).alias("end"))


def flags(**tests: Column) -> Column:
    """The names of the tests that hold, in order."""
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)
