"""WAV contents: header checks, durations and samples, by Arrow over binary files."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RATE = 16_000
HEADER = T.StructType(
    [
        T.StructField("channels", T.IntegerType()),
        T.StructField("rate", T.IntegerType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("frames", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("problem", T.StringType()),
    ]
)


def files(spark: SparkSession, root: str, glob: str = "*.wav", content: bool = True) -> DataFrame:
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return rows if content else rows.drop("content")


@F.pandas_udf(HEADER)
def inspect(content: pd.Series) -> pd.DataFrame:
    """The header, and the first of what is wrong: mono, 16 kHz, 16 bits, not empty, not cut off."""
    rows = []
    for data in content:
        try:
            with wave.open(io.BytesIO(data)) as w:
                c, r, b, n = w.getnchannels(), w.getframerate(), 8 * w.getsampwidth(), w.getnframes()
                whole = len(w.readframes(n)) == n * c * b // 8
            problem = next((m for ok, m in ((c == 1, "not mono"), (r == RATE, "not 16 kHz"), (b == 16, "not 16 bits"), (n > 0, "empty"), (whole, "cut off")) if not ok), None)
            rows.append((c, r, b, n, n / r if r else None, problem))
        except (wave.Error, EOFError, TypeError) as e:
            rows.append((None, None, None, None, None, f"not a WAV file: {e}"[:80]))
    return pd.DataFrame(rows, columns=["channels", "rate", "bits", "frames", "seconds", "problem"]).astype({"channels": "Int32", "rate": "Int32", "bits": "Int32", "frames": "Int64"})


@F.pandas_udf(T.ArrayType(T.FloatType()))
def samples(content: pd.Series) -> pd.Series:
    """Mono samples in [-1, 1); channels are averaged."""
    out = []
    for data in content:
        with wave.open(io.BytesIO(data)) as w:
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
            out.append(x.reshape(-1, w.getnchannels()).mean(1))
    return pd.Series(out)


def quality(x):
    """Duration, peak and clipped share of a sample array, with a verdict."""
    n, loud = F.size(x), F.array_max(F.transform(x, F.abs))
    clipped = F.try_divide(F.size(F.filter(x, lambda v: F.abs(v) >= 0.999)), n)
    seconds = n / RATE
    verdict = F.when((seconds < 0.5) | (seconds > 30), "duration").when(F.coalesce(loud, F.lit(0.0)) < 1e-4, "silent").when(clipped > 0.01, "clipped").otherwise("ok")
    return F.struct(seconds.alias("seconds"), loud.alias("peak"), clipped.alias("clipped"), verdict.alias("verdict"))
