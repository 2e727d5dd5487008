"""Schemas and constants of token-level assessment data."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data format: the label scale, class thresholds and split constants.
LABELS = (0, 1, 2)
LABEL_SCORE = {0: 0.0, 1: 50.0, 2: 100.0}
CLASS_THRESHOLDS = (25.0, 75.0)
SCORE_BANDS = {"lenient": (15.0, 65.0), "standard": (25.0, 75.0), "strict": (35.0, 85.0)}
PROMPT_FOLDS, DEV_FOLD = 10, 1
CALIBRATION_BINS = 10
WILSON_Z = 1.959963984540054
PROFILE_PRIOR = 12.0
CALIBRATOR_PSEUDO_COUNT = 200.0
SPLIT_FRACTION, SPLIT_SLACK = 0.10, 1.15

# The phone vocabulary, in its order.
PHONES = (
    "aar", "aor", "aɪ", "aʊ", "b", "d", "dʒ", "eyr", "eɪ", "f", "h", "i", "iyr", "j", "k", "l", "m", "n", "oʊ", "p", "s", "t",
    "tʃ", "u", "v", "w", "z", "æ", "ð", "ŋ", "ɑ", "ɔ", "ɔɪ", "ɛ", "ɝ", "ɡ", "ɪ", "ɹ", "ɾ", "ʃ", "ʊ", "ʌ", "ʒ", "θ",
)

MANIFEST = T.StructType(
    [
        T.StructField("audio_path", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("phonemes", T.ArrayType(T.StructType([T.StructField("phoneme", T.StringType()), T.StructField("label", T.IntegerType())]))),
    ]
)
# Schemas as DDL text, which needs no session to import.
PREDICTIONS = "utterance_id string, record_index long, phone_index int, phoneme string, label int, score double, q1 double, q2 double"
DECISION = "audit_id string, disposition string, notes string, reviewed_at string, utterance_id string, phone_index int, phoneme string, dataset_label int"
REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("audio_paths", T.ArrayType(T.StringType())),
        T.StructField("prompt", T.StringType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("response_format", T.StringType()),
    ]
)
