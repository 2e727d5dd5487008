"""Chat formatting, encoding, packing and the classifiers."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import byte_bpe, chat_format, packing, quality, toxicity
from assaykit.llm.common import fit_rows, held_out

P = pytest.importorskip("public_tokenizers")
ODD_TEXTS = [None, "", " ", "a", "</s>[INST] ok [/INST]", "<|end|>", "<\\|turn|>", "é中文 🙂", "a  b\n\n c\t", "x" * 30_000, " ".join(["the cat's 12 %%"] * 3000)]


def docs(spark, texts, **extra):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1] + [(None, "no id", "clash")], "doc_id long, text string, score string")


def test_chat_round_trip(spark):
    rows = [(1, k, ("user", "assistant", "assistant", None)[k % 4], t) for k, t in enumerate(ODD_TEXTS[:9])]
    rows += [(2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (None, None, "user", "<"), (3, 0, "ass<|", "|>")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    back = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(frame)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted([(r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        assert [(t.role, t.text) for t in back[conv].turns] == [(a, b) for _, a, b in own]
        assert back[conv].learned == "".join(b for _, a, b in own if a == "assistant")
    assert back[2].n_blocks == 1
    assert chat_format.format_chats(frame.limit(0)).count() == 0


def test_chat_plan_has_no_python(spark, sf_dir):
    plan = chat_format.op6_chat_formatting(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encoder(path, P.PATTERN), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})


def test_encoder_equals_library(encoders):
    own, library = encoders
    r = random.Random(5)
    texts = [t or "" for t in ODD_TEXTS] + ["".join(r.choice("ab cdé中\n \t\x1c\x85'st1%") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        joined = own.encode(t)
        assert joined == ",".join(map(str, library.encode_ordinary(t)))
        assert own.decode(byte_bpe.ids_of(joined)) == t.encode()


def test_short_pieces_walk_side_by_side(encoders, monkeypatch):
    """Texts taken together give the library's ids; only pieces of over ``SHORT`` bytes walk alone; small memos and tables turn over."""
    _, library = encoders
    own, alone = byte_bpe.Encoder(library._mergeable_ranks, P.PATTERN), []
    one = own.encode_piece
    monkeypatch.setattr(own, "encode_piece", lambda piece: alone.append(len(piece)) or one(piece))
    monkeypatch.setattr(own, "neighbours", byte_bpe.Table(9))
    monkeypatch.setattr(byte_bpe, "CHUNKS", 150)
    monkeypatch.setattr(byte_bpe, "TOGETHER", 40)
    r = random.Random(7)
    word = lambda most: "".join(r.choice(("th", "ei", "ñ", "sch", "ung", "a", "ß", "中", "on", ".\n", "'ll")) for _ in range(r.randint(1, most)))
    for most in (6, 6, 90):
        texts = [" ".join(word(most) for _ in range(r.randint(0, 30))) + r.choice(("", "  ", "\n \n")) for _ in range(60)]
        assert own.encode_many(texts) == [",".join(map(str, library.encode_ordinary(t))) for t in texts]
        assert (alone != []) == (most > 6) and all(n > byte_bpe.SHORT for n in alone)
    assert own.encode_many([]) == [] and own.encode_many(["", "a"]) == ["", own.encode("a")]


@pytest.mark.parametrize("seed", range(6))
def test_other_ranks(seed):
    """Vocabularies of random merges, some of whose entries other merges forestall."""
    import tiktoken

    r = random.Random(seed)
    entries = [c.encode() for c in "abc "]
    for _ in range(r.randint(3, 60)):
        made = r.choice(entries) + r.choice(entries)
        if made not in entries and b" " not in made[1:]:
            entries.append(made)
    ranks = {token: i for i, token in enumerate(entries)}
    own, library = byte_bpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 70))) for _ in range(r.randint(1, 9))) for _ in range(80)]
    assert own.encode_many(texts) == [",".join(map(str, library.encode_ordinary(t))) for t in texts]
    with pytest.raises(ValueError):
        own.encode("aabd")


def test_encode_table(spark, encoders):
    frame = docs(spark, ODD_TEXTS)
    got = byte_bpe.encode_table(frame, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(ODD_TEXTS) + 2
    assert all(bytes(r.decoded) == ((ODD_TEXTS[r.doc_id] or "") if r.doc_id is not None else "no id").encode() for r in got)
    digest = byte_bpe.encode_table(frame, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digests=True).where("doc_id = 3").first()
    assert digest.n_tokens == 1 and digest.decoded_sha256 == hashlib.sha256(b"a").hexdigest()
    assert byte_bpe.encode_table(frame.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    frame = docs(spark, [*ODD_TEXTS, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|ENDOFTEXT|> z", *("word " * k for k in range(0, 400, 7))])
    packed = packing.pack(frame.repartition(3), path, capacity=64)
    rows = packed.collect()
    texts = {r.doc_id: r.text for r in frame.collect()}
    by_doc, places = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert 0 < r.length <= 64 and len(r.ids) == r.length
    for doc_id, own in by_doc.items():
        if doc_id == 0:
            continue  # two equal rows
        own.sort(key=lambda r: r.piece)
        ids = [i for r in own for i in r.ids]
        assert ids == [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(r.length == 64 for r in own[1:])
    for own in places.values():
        own.sort()
        assert [a for a, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 64
    crc = packing.pack(frame, path, capacity=64, payload="ids_crc32").where("doc_id = 3").first()
    assert crc.ids_crc32 == zlib.crc32(np.array([*library.encode("a").ids, 2], "<u4").tobytes())
    assert packing.sequences(packed).count() == len(places)
    assert packing.pack(frame.limit(0), path).count() == 0


def test_packing_writes_few_files(spark, tmp_path):
    """A small table in many partitions gives four files for each core at most, checkpoint and result, and the same pieces."""
    from pathlib import Path

    path = P.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(i, "word " * (i % 90)) for i in range(400)], "doc_id long, text string")
    pieces = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    whole = packing.pack(frame.coalesce(1), path, capacity=64, payload="ids_crc32")
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = set(folder.rglob("part-*"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = packing.pack(frame.repartition(99), path, capacity=64, payload="ids_crc32")
        many.write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(set(folder.rglob("part-*")) - before) <= 16 and len([*(tmp_path / "out").glob("part-*")]) <= 4
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert pieces(rows) == pieces(whole.collect())
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_piece_once_and_wastes_little(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(n) for k, n in zip(*np.unique(np.clip(rng.lognormal(5.5, 1, 5000), 1, 1024).astype(int), return_counts=True), strict=True)}
    patterns = packing.plan(counts)
    used = {}
    for n, bin_ in patterns:
        assert sum(bin_) <= 1024
        for k in bin_:
            used[k] = used.get(k, 0) + n
    assert used == counts
    assert sum(n for n, _ in patterns) <= 1.01 * sum(k * n for k, n in counts.items()) / 1024 + 1


def test_best_two_fit_replaces_the_smallest():
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [(1, [6, 2, 2]), (1, [3])]


@pytest.fixture(scope="module")
def labelled(spark):
    path = "/root/testdata/sf0.1"
    try:
        return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    except Exception:
        pytest.skip("driver tables are not here")


@pytest.mark.parametrize(("fit", "label", "mod", "rest", "least"), [(quality.score_quality, "quality", 5, 0, 0.97), (toxicity.score_toxicity, "toxic", 4, 2, 0.96)])
def test_held_out_accuracy(spark, labelled, fit, label, mod, rest, least):
    frame, labels = labelled
    held = held_out(mod, rest)
    scored = fit(frame.join(labels.select("doc_id"), "doc_id", "left_semi"), labels, held).join(labels, "doc_id").where(held)
    row = scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert row.a >= least and 0 <= row.low and row.high <= 1


@pytest.mark.parametrize(("fit", "label"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifier_edges(spark, fit, label):
    frame, none = docs(spark, ODD_TEXTS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in fit(frame, none, held_out(5, 0)).collect()} == {0.5}
    assert fit(frame.limit(0), none, held_out(5, 0)).count() == 0
    few = spark.createDataFrame([(i, i % 2, i % 2) for i in (3, 4, 5, 6, 7, 8)] + [(9, None, None), (10, 1, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")
    got = fit(frame, few, held_out(500, 0)).collect()
    assert len(got) == len(ODD_TEXTS) + 2 and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize(("fit", "label"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_held_out_labels_are_never_learnt(spark, fit, label):
    frame = spark.createDataFrame([(i, "good text here" if i % 2 else "%%% bad ###") for i in range(60)], "doc_id long, text string")
    labels = frame.select("doc_id", (F.col("doc_id") % 2).cast("int").alias(label))
    held = held_out(5, 0)
    wrong = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    a, b = (sorted(map(tuple, fit(frame, x, held).collect())) for x in (labels, wrong))
    assert a == b


def test_whole_texts_are_fitted_on_and_hot_ids_count_once(spark):
    long = "x " * 60_000 + "end"
    frame = spark.createDataFrame([(1, long)] * 50 + [(1, "y" + long), (2, None), (3, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    assert sorted(fit_rows(frame, labels, "quality", F.lit(False), 10)) == [("", 0), (long, 1), ("z", 0)]
