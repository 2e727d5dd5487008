import io
import json
import struct
import wave

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assaykit.sources import audio, keyed_text, manifest, sinks
from assaykit.streaming import ledger

GOOD = [
    {"audio_path": "audio/one.wav", "text": "hello", "phonemes": [{"phoneme": "h", "label": 2}, {"phoneme": "oʊ", "label": 1}]},
    {"audio_path": "audio/two.wav", "text": "short", "phonemes": [{"phoneme": "h", "label": 0}]},
]


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + "\n")
    return str(path)


def test_manifest_round_trip(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", [GOOD[0], "", GOOD[1]])
    records = manifest.manifest(spark, path)
    phones = [(r.utterance_id, r.phone_index, r.phoneme, r.label, r.target) for r in manifest.phones_of(records).orderBy("record_index", "phone_index").collect()]
    assert phones == [("one", 0, "h", 2, 100.0), ("one", 1, "oʊ", 1, 50.0), ("two", 0, "h", 0, 0.0)]
    assert [json.loads(r.value) for r in sinks.manifest_lines(records).collect()] == GOOD


BAD = [
    '{"audio_path":"a.wav","text":"x","phonemes":[{"phoneme":"??","label":1}]}',
    '{"audio_path":"a.wav","text":"x","phonemes":[{"phoneme":"h","label":3}]}',
    '{"audio_path":"a.wav","text":"x","phonemes":[{"phoneme":"h","label":true}]}',
    '{"audio_path":"a.wav","text":"x","phonemes":[]}',
    '{"audio_path":"../a.wav","text":"x","phonemes":[{"phoneme":"h","label":1}]}',
    '{"audio_path":"a.wav","text":" x","phonemes":[{"phoneme":"h","label":1}]}',
    '{"audio_path":"a.wav","text":"x","phonemes":[{"phoneme":"h","label":1}],"more":1}',
    '{"audio_path":"a.wav","audio_path":"b.wav","text":"x","phonemes":[{"phoneme":"h","label":1}]}',
    '{"audio_path":"a.wav","text":NaN,"phonemes":[{"phoneme":"h","label":1}]}',
    '{"audio_path":"a.wav","text":"x"',
]


@pytest.mark.parametrize("line", BAD)
def test_manifest_rejects(spark, tmp_path, line):
    path = write(tmp_path / "m.jsonl", [GOOD[0], line])
    rows = manifest.manifest(spark, path, strict=False).orderBy("line").collect()
    assert rows[0].problems == [] and rows[1].problems
    with pytest.raises(PySparkException, match="line 2"):
        manifest.manifest(spark, path).collect()


def test_duplicate_paths(spark, tmp_path):
    rows = manifest.manifest(spark, write(tmp_path / "m.jsonl", [GOOD[0], GOOD[0]]), strict=False).collect()
    assert all("duplicate audio path" in r.problems for r in rows)


def test_requests(spark, tmp_path):
    lines = [{"request_id": "a", "audio_paths": [], "prompt": "p", "max_tokens": 5, "response_format": "text"}, {"request_id": "b", "audio_paths": [], "prompt": "p", "max_tokens": 0, "response_format": "text"}, "not json"]
    rows = manifest.requests(manifest.numbered_lines(spark, write(tmp_path / "r.jsonl", lines))).orderBy("line").collect()
    assert rows[0].error is None and rows[1].request_id == "b" and "max_tokens" in rows[1].error and rows[2].error == "invalid JSON"


def test_truncated_ledger(spark, tmp_path):
    path = write(tmp_path / "l.jsonl", ['{"audit_id":"a"}', '{"audit_id":'])
    assert [r.audit_id for r in manifest.tolerant_jsonl(spark, path, manifest.T.StructType([manifest.T.StructField("audit_id", manifest.T.StringType())])).collect()] == ["a"]


def test_keyed_text(spark, tmp_path):
    rows = keyed_text.indexed_lines(spark, write(tmp_path / "g", ["u.1 b", "u.0 a", "v.1 x"])).collect()
    assert {r.utterance_id: r.contiguous for r in rows} == {"u": True, "v": False}
    m = {r.key: r.vector for r in keyed_text.matrices(spark, write(tmp_path / "f", ["u.0 [ 1 2.5 ]", "u.1 [ 1 nan ]"])).collect()}
    assert m["u.0"] == [1.0, 2.5] and m["u.1"] is None
    p = keyed_text.paired_scores(spark, write(tmp_path / "p", ["u [ 3 0.5 ] [ 4 -1 ]"])).orderBy("index").collect()
    assert [(r.id, r.score) for r in p] == [(3, 0.5), (4, -1.0)]
    lex = {r.word: (r.phones, r.sound) for r in keyed_text.lexicon(spark, write(tmp_path / "x", ["CAT CAT K_B AE1_I T_E", "BAD BAD B_B", "<eps> 0"])).collect()}
    assert lex["CAT"] == (["K", "AE", "T"], True) and lex["BAD"][1] is False
    t = {r.symbol: r.unique for r in keyed_text.symbol_table(spark, write(tmp_path / "s", ["<eps> 0", "a 1", "b 1"])).collect()}
    assert t == {"<eps>": True, "a": False, "b": False}


def wav_bytes(values, rate=16000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack(f"<{len(values)}h", *values))
    return out.getvalue()


def test_audio(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav_bytes([0, 16384] * 8000))
    (tmp_path / "b.wav").write_bytes(wav_bytes([0] * 100, 8000))
    (tmp_path / "c.wav").write_bytes(b"nothing")
    rows = audio.files(spark, str(tmp_path)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("f"), audio.inspect("content").alias("h")).select("f", "h.*").collect()
    found = {r.f: r.problem for r in rows}
    assert found["a.wav"] is None and found["b.wav"] == "not 16 kHz" and found["c.wav"].startswith("not a WAV")
    one = audio.files(spark, str(tmp_path), "a.wav").select(audio.quality(audio.samples("content")).alias("q")).first().q
    assert one.seconds == 1.0 and one.verdict == "ok" and one.peak == 0.5


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "key string, seq int, v string")
    path = str(tmp_path / "ledger")
    with pytest.raises(ValueError):
        sinks.append_ledger(rows, path, ("key",), unique=True)
    sinks.append_ledger(rows.where("seq = 1"), path, ("key",), unique=True)
    with pytest.raises(ValueError):
        sinks.append_ledger(rows.where("seq = 2"), path, ("key",), unique=True)
    sinks.append_ledger(rows.where("seq = 2"), path, ("key",))
    assert [(r.key, r.v) for r in sinks.ledger_view(spark, path, ("key",), "seq").collect()] == [("k", "y")]
    out = str(tmp_path / "out")
    sinks.publish(spark, {"a": rows, "b": rows.limit(1)}, out)
    assert spark.read.parquet(f"{out}/a").count() == 2
    with pytest.raises(FileExistsError):
        sinks.publish(spark, {"a": rows}, out)
    line = sinks.report_line(spark.createDataFrame([(1.0, float("nan"))], "a double, b double")).first().value
    assert json.loads(line) == {"a": 1.0, "b": None}


def test_judged_once_over_restarts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "done")
    source.mkdir()
    write(source / "1.json", [{"audit_id": "a", "reviewed_at": "1"}, {"audit_id": "b", "reviewed_at": "1"}])

    def judge(batch):
        return batch.select("audit_id", F.lit("ok").alias("verdict"))

    for k in (1, 2):
        q = ledger.judge_once(ledger.decisions(spark, str(source)), "audit_id", judge, out, str(tmp_path / "cp"))
        q.awaitTermination(60)
        write(source / "2.json", [{"audit_id": "b", "reviewed_at": "2"}, {"audit_id": "c", "reviewed_at": "2"}])
    assert sorted(r.audit_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    table = spark.read.schema(ledger.DECISION).json(str(source))
    assert {r.audit_id: r.reviewed_at for r in ledger.latest_decisions(table).collect()} == {"a": "1", "b": "2", "c": "2"}
