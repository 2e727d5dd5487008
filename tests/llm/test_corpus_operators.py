"""Language-model scores, near duplicates, repeated strings, searches and the pipeline."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from assaykit.llm import hilbert_ann, near_dup, ngram_lm, suffix_dedup, top_k, words as words_


def words(r, n, alphabet="abcdeé"):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 7))) for _ in range(n))


def brute_scores(texts, order, backoff=0.4):
    split = [(t or "").lower().split() for t in texts]
    count = [collections.Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    total, out = sum(map(len, split)), []
    for w in split:
        own = [collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
        left = lambda g, own=own: count[len(g) - 1][g] - own[len(g) - 1][g]
        score = 0.0
        for i in range(len(w)):
            drop = 1.0
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k > 1 and left(g) > 0:
                    score += math.log(drop * left(g) / left(g[:-1]))
                    break
                if k == 1:
                    score += math.log(drop * (left(g) / (total - len(w)) if left(g) > 0 else 1 / (total - len(w) + 1)))
                drop *= backoff
        out.append((len(w), round(score, 6)))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(spark, order, monkeypatch):
    r = random.Random(order)
    texts = [words(r, r.randint(0, 60), "abc") for _ in range(40)] + [None, "", "one", "A a a a", "A a a a", " \n"]
    monkeypatch.setattr(ngram_lm, "BLOCK_CHARS", 700)
    monkeypatch.setattr(ngram_lm, "PART_CHARS", 900)
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = [(x.n_tokens, round(x.score, 6)) for x in sorted(ngram_lm.score_documents(frame, order).collect(), key=lambda x: x.doc_id)]
    expected = brute_scores(texts, order)
    assert [n for n, _ in got] == [n for n, _ in expected]
    assert [x for _, x in got] == pytest.approx([x for _, x in expected], abs=1e-5)
    assert ngram_lm.score_documents(frame.limit(0)).count() == 0


def test_lm_query_has_two_words_of_context(spark, tmp_path):
    r = random.Random(8)
    texts = [words(r, r.randint(0, 60), "ab") for _ in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [x.score for x in sorted(ngram_lm.op1_lm_scoring(spark, str(tmp_path)).collect(), key=lambda x: x.doc_id)]
    assert got == pytest.approx([x for _, x in brute_scores(texts, 3)], abs=1e-3)
    assert got != pytest.approx([x for _, x in brute_scores(texts, 2)], abs=1e-3)


def test_lm_keys_packed():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**64, 5000, np.uint64, endpoint=False))
    for some in (keys, keys[:1], keys[-3:], np.array([0, 1, 2**64 - 1], np.uint64)):
        for width in (6, 7, 8):
            short = np.unique(some >> np.uint64(64 - 8 * width) << np.uint64(64 - 8 * width))
            assert ngram_lm.unpack_keys(ngram_lm.pack_keys(short, width), len(short), width).tolist() == short.tolist()
    assert [ngram_lm.key_bytes(n) for n in (10**8, 10**10, 10**12)] == [6, 7, 8]
    values = np.array([0, 1, 255, 256, 2**40, 2**62], "<i8")
    assert ngram_lm.unpack(ngram_lm.pack(values), "<i8").tolist() == values.tolist()


def test_suffix_array():
    r = random.Random(3)
    for _ in range(1500):
        x = [r.randint(1, r.choice([1, 2, 3, 6])) for _ in range(r.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count, out = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1)), []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_strings_in_order():
    """Strings that start with the same bytes stand together, and the suffix array is what puts them there."""
    r = random.Random(5)
    for _ in range(30):
        stems = [words(r, r.randint(1, 40)).encode() for _ in range(3)]
        strings = [s[: r.randint(0, len(s))] + words(r, r.randint(1, 20)).encode() for s in stems for _ in range(8)] + [b"", b"a" * 90, b"a" * 200]
        order = suffix_dedup.ordered(strings).tolist()
        assert sorted(order) == list(range(len(strings)))
        for k in range(len(strings)):
            for n in range(0, len(strings[k]) + 1, 7):
                places = [i for i, j in enumerate(order) if strings[j][:n] == strings[k][:n] and len(strings[j]) >= n]
                assert places == list(range(places[0], places[-1] + 1))


@pytest.mark.parametrize(("length", "many"), [(60, 2048), (200, 2048), (400, 2048), (60, 2), (200, 3)])
def test_repeated_strings(spark, length, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    r = random.Random(length)
    base = [words(r, r.randint(1, 250)) for _ in range(8)]
    texts = [*base, None, "", "x" * 1500, "y" * (length - 1), "z" * length, "ab" * 700, "abc" * 300 + "q" + "abc" * 300, "no cuts" + "é" * 900]
    for b in base:
        for _ in range(3):
            w = b.split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = words(r, 1)
            texts.append(" ".join(w))
    texts += [base[0], base[1] + base[2], base[3][50:] + base[4][:600]]
    frame = spark.createDataFrame([(i if i % 7 else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    rows = suffix_dedup.split_repeats(frame.repartition(5), length, digests=True).collect()
    assert sorted(tuple(x)[1:5] for x in rows) == brute_repeats(texts, length)
    assert all(hashlib.sha256(x.text.encode()).hexdigest() == x.kept_sha256 or "é" in x.text for x in rows if x.n_spans == 0)
    assert suffix_dedup.split_repeats(frame.limit(0), length).count() == 0


def brute_classes(texts, threshold=0.8):
    own = near_dup.bags([(t or "").lower() for t in texts], words_.Powers())
    n = sum(len(h) > 0 for h, _ in own)
    df = collections.Counter(x for h, _ in own for x in h.tolist())
    weights = near_dup.Weights({k: c for k, c in df.items() if c >= near_dup.RARE * n and c > 1}, n)
    weighed = [(h, weights.of((h, c))) for h, c in own]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(own[i][0]) and len(own[j][0]) and near_dup.similarity(weighed[i], weighed[j]) >= threshold:
                parent[root(i)] = root(j)
    return [min(k for k in range(len(texts)) if root(k) == root(i)) for i in range(len(texts))]


def test_near_duplicates(spark):
    r = random.Random(11)
    texts = [None, "", "short one", "Short  one", "x y z"]
    for _ in range(12):
        base = words(r, r.randint(40, 200)).split()
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 3, 9, 25):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = words(r, 1)
            texts.append(" ".join(w))
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, class_id int")
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(frame.repartition(4)).collect()}
    expected = brute_classes(texts)
    wrong = sum(got[i] != expected[i] for i in range(len(texts)))
    assert wrong <= 1  # a pair at the threshold is missed about once in five thousand
    assert got[2] == got[3] == 2 and got[0] == 0 and got[1] == 1
    assert near_dup.near_duplicates(frame.limit(0)).count() == 0


def test_near_duplicates_in_slices(spark, monkeypatch):
    """Buckets whose members stay in several classes are settled, into however many slices they are dealt."""
    for name, value in {"SLICE": 9_000, "GROUP": 20_000, "ALIKE": 1}.items():
        monkeypatch.setattr(near_dup, name, value)
    r = random.Random(4)
    shared = words(r, 100)
    texts = [shared + " " + words(r, 35) for _ in range(14)]
    texts += [" ".join(w if r.random() > 0.01 else "other" for w in t.split()) for t in texts for _ in range(2)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dup.near_duplicates(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


@pytest.mark.parametrize("documents", [3, 20, 57])
def test_common_shingles_in_blocks(spark, monkeypatch, documents):
    """Weights are exact however the documents fall into blocks, the few left after the last full block included."""
    for name, value in {"BLOCK_DOCS": 10, "RARE": 0.1}.items():
        monkeypatch.setattr(near_dup, name, value)
    r = random.Random(documents)
    passages = [words(r, 9) for _ in range(12)]
    texts = [" ".join([words(r, 6), *(p for k, p in enumerate(passages) if r.random() < k / 40)]) for _ in range(documents)]
    count = collections.Counter(h for keys, _ in near_dup.bags(texts, words_.Powers()) for h in keys.tolist())
    expected = near_dup.Weights({h: n for h, n in count.items() if n >= near_dup.RARE * documents and n > 1}, documents)
    got = near_dup.common_shingles(spark.createDataFrame([(t,) for t in [*texts, ""]], "text string").coalesce(1))
    assert got.keys.tolist() == expected.keys.tolist() and got.value.tolist() == expected.value.tolist()


def test_samples_are_consistent():
    """Samples agree as often as bags are similar, in short and long bags and with odd weights; a band as often as four samples."""
    rng, sampler = np.random.default_rng(9), near_dup.Sampler(64, 5)
    for n in (30, 300, 5000):
        same = bands = 0
        for _ in range(60):
            keys = np.unique(rng.integers(0, 2**64, n + n // 8, np.uint64, endpoint=False))
            weight = rng.choice([8, 11, 16, 16, 16, 32], len(keys))
            own = [np.sort(rng.permutation(len(keys))[:n]) for _ in range(2)]
            drawn = [sampler.samples(keys[i], weight[i]) for i in own]
            same += (drawn[0] == drawn[1]).mean() / 60 / near_dup.similarity(*((keys[i], weight[i]) for i in own))
            bands += (near_dup.band_keys(drawn[0]) == near_dup.band_keys(drawn[1])).mean() / 60
        assert same == pytest.approx(1, abs=0.03) and 0.3 < bands < 0.7


def test_words_hashed_in_columns(monkeypatch):
    r = random.Random(6)
    texts = [words(r, 50), "", "a\x85b\xa0c d e f", " x ", "\x1cq\x1fz", "é\u3000ü\u2003ä\u2029" * 3, "a" * 30, words(r, 200, "aé ")]
    plain = [t.split() for t in texts]
    for piece in (1 << 20, 5):
        monkeypatch.setattr(words_, "PIECE", piece)
        hashes, sizes = words_.word_hashes(texts, words_.Powers())
        assert sizes.tolist() == [len(p) for p in plain]
        of = {}
        assert all(of.setdefault(w, h) == h for w, h in zip((w for p in plain for w in p), hashes.tolist(), strict=True))
        assert len(set(of.values())) == len(of)


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102)]
    links = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in chain], "u binary, v binary")
    got = {int.from_bytes(x.node, "big"): int.from_bytes(x.label, "big") for x in near_dup.components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def vector_rows(spark, x):
    odd = [(9_000, None), (9_050, [None, 1.0]), (9_100, [float("nan"), 1.0]), (9_150, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + odd + [(0, [float(v) for v in x[0]])]
    return spark.createDataFrame([(*row, "clash") for row in rows], "vec_id long, embedding array<float>, score string")


@pytest.mark.parametrize("kind", ["gauss", "ties", "large"])
def test_top_k(spark, kind, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 150)
    monkeypatch.setattr(top_k, "QUERIES", 3)
    rng = np.random.default_rng(2)
    x = {"gauss": rng.normal(0, 0.2, (400, 16)), "ties": rng.integers(-2, 3, (400, 3)) / 256, "large": rng.normal(0, 1e9, (120, 4))}[kind].astype(np.float32)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k.top_k(vector_rows(spark, x), lambda i: i % 50 == 0, 5).collect())
    whole = [[math.floor(256 * float(v)) for v in row] for row in x]
    expected = []
    for q in range(0, len(x), 50):
        top = 2**63 - 1
        scored = sorted((-max(-top, min(top, sum(a * b for a, b in zip(whole[q], whole[j], strict=True)))), j) for j in range(len(x)) if j != q)
        expected += [(q, k + 1, j, -s) for k, (s, j) in enumerate(scored[:5])]
    assert got == expected


def test_top_k_small(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k.top_k(rows, lambda i: i % 50 == 0, 5).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k.top_k(rows.limit(0), lambda i: i % 50 == 0, 5).count() == 0


def test_ranges_follow_the_data():
    """Vectors near a line need short ranges, the shorter the more rows; vectors alike in all directions long ones."""
    rng = np.random.default_rng(3)
    line = np.cumsum(np.full((1024, 8), 0.01), axis=0)[rng.permutation(1024)] + rng.normal(0, 1e-4, (1024, 8))
    ball = rng.normal(size=(1024, 32))
    counts = [[hilbert_ann.ranges_for(x, hilbert_ann.Curves(x), 5, n) for n in (1024, 100_000)] for x in (line, ball)]
    assert counts[0][0] > 20 > counts[1][0] / 2 and counts[0][1] > 3 * counts[0][0]
    rows = np.zeros((60, 2))
    assert [i for _, i in hilbert_ann.nearest_in(np.zeros((1, 2)), rows, [[i] for i in range(59, -1, -1)], 5)[0]] == [0, 1, 2, 3, 4]


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "QUERIES", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[700:1000] = x[700]  # a large group of copies
    rows = vector_rows(spark, x).unionByName(spark.createDataFrame([(9_200, [0.0, 0.0], "")], "vec_id long, embedding array<float>, score string"))
    got = collections.defaultdict(list)
    for r in hilbert_ann.nearest(rows, lambda i: i % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits, wide = 0, x.astype(float)
    assert sorted(got) == list(range(0, 1500, 100))
    for q in got:
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        hits += len(set(best.tolist()) & {v for v, _ in got[q]})
        assert all(s == pytest.approx(d[v]) for v, s in got[q]) and [s for _, s in got[q]] == sorted(s for _, s in got[q])
    assert hits / (10 * len(got)) >= 0.9
    assert [v for v, _ in got[700]] == [*range(701, 711)]
    assert hilbert_ann.nearest(rows.limit(0), lambda i: i % 100 == 0, 10).count() == 0


def test_hilbert_keys_are_a_path():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(hilbert_ann.hilbert_keys(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_one_document_of_each_class_stays(spark):
    a, b, c, d = ("one two three four five six seven eight", "another text of several words to be kept apart", "a third text that has nothing in common with others", "and a fourth")
    rows = [(5, a), (3, b), (5, b), (9, c), (9, c), (None, c), (None, d), (None, d), (7, None), (8, ""), (7, None), (5, a)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, class_id string")
    kept = corpus_pipeline.one_of_each(spark, frame, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter([(5, a), (3, b), (9, c), (None, d), (7, None), (8, "")])
    assert corpus_pipeline.one_of_each(spark, frame.limit(0), "").count() == 0


def brute_kept(texts, length):
    """The texts without the strings of ``length`` bytes that start elsewhere too."""
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore"), any(gone)))
    return out


def test_stages_with_odd_rows(spark, tmp_path):
    """Every stage takes null, empty, repeated and clashing rows and empty tables, and keeps or cuts what it should."""
    r = random.Random(12)
    good = [" ".join(["The river ran by the old mill and"] + [words(r, 30, "abcdefgh")]) for _ in range(30)]
    passage = " ".join(words(r, 1, "klmnop") for _ in range(90))
    rows = [(i, t) for i, t in enumerate(good)] + [(100, None), (101, ""), (102, good[0]), (103, good[1] + " " + passage), (104, good[2] + " " + passage), (0, good[0]), (None, "no id at all")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100, 0, 1), (101, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    clash = frame.withColumn("score", corpus_pipeline.F.lit("clash")).withColumn("predicted", corpus_pipeline.F.lit(7)).withColumn("spans", corpus_pipeline.F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, str(tmp_path))
        empty = stage(spark, clash.limit(0), str(tmp_path))
        assert empty.count() == 0
        if name in ("quality", "toxicity"):
            assert out.columns == list(corpus_pipeline.COLUMNS) and {(x.doc_id, x.text) for x in out.collect()} <= set(rows)
        if name == "repeated_passages":
            expected = [(i, k if cut else t) for (i, t), (k, cut) in zip(rows, brute_kept([t for _, t in rows], corpus_pipeline.REPEATED_BYTES), strict=True) if not cut or k.strip()]
            assert collections.Counter((x.doc_id, x.text) for x in out.collect()) == collections.Counter(expected)
        if name == "packing":
            assert collections.Counter(x.doc_id for x in out.where("piece = 0").collect()) == collections.Counter(i for i, _ in rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        if name == "packing":
            assert out.select("doc_id").distinct().count() == before
            break
        assert sorted(out.columns) == sorted(columns)
        texts, kept = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert set(kept) <= set(texts)
        if name == "near_duplicates":
            ids = sorted(texts)
            classes = brute_classes([texts[i] for i in ids])
            assert set(kept) == {ids[c] for c in classes}
        if name == "repeated_passages":
            ids = sorted(texts)
            assert kept == {i: k if cut else texts[i] for i, (k, cut) in zip(ids, brute_kept([texts[i] for i in ids], corpus_pipeline.REPEATED_BYTES), strict=True) if not cut or k.strip()}
        docs, before = out, out.count()


def test_sql(spark, sf_dir):
    """The SQL of the subpackage's queries gives their rows."""
    duckdb = pytest.importorskip("duckdb")
    from assaykit.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got, expected = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(expected.columns)
        shown = [sorted(tuple("null" if x is None or x != x else f"{x:.3f}" if isinstance(x, float) else str(x) for x in row) for row in f[sorted(f.columns)].astype(object).itertuples(index=False)) for f in (got, expected)]
        assert shown[0] == shown[1], name
