"""Queries over prompts, embeddings, raters, ledgers and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, hashing, sequences, text as texts
from ..operators import agreement, leakage, ranking, vectors, weights
from .assessment import rounded, tokens
from .registry import query


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CANON = r"trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g'))"
FOLD = "(('0x' || substr(sha256(k), 1, 16))::UBIGINT % 10)::INTEGER"


def prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", texts.canonical_prompt("text").alias("k"))


@query(f"WITH d AS (SELECT doc_id, {CANON} AS k FROM documents) SELECT doc_id, sha256(k) AS prompt_sha256, {FOLD} AS prompt_fold, CASE WHEN {FOLD} = 1 THEN 'dev' ELSE 'fit' END AS split FROM d")
def prompt_folds(spark, sf_dir):
    rows = leakage.with_prompt_split(prompts(spark, sf_dir), F.col("k"))
    return rows.select("doc_id", F.sha2("k", 256).alias("prompt_sha256"), "prompt_fold", "split")


@query(f"""WITH d AS (SELECT *, {CANON} AS k FROM documents), s AS (SELECT *, {FOLD} AS f FROM d), l AS (SELECT DISTINCT k FROM s WHERE source <> 'src0'), m AS (SELECT s.*, l.k IS NOT NULL AS seen FROM s LEFT JOIN l USING (k) WHERE source = 'src0')
SELECT count(*)::BIGINT AS records, count(*) FILTER (WHERE seen)::BIGINT AS leaked_records, coalesce(sum(n_chars), 0)::BIGINT AS phones, coalesce(sum(n_chars) FILTER (WHERE seen), 0)::BIGINT AS leaked_phones, count(DISTINCT k) FILTER (WHERE seen)::BIGINT AS shared_keys,
  round(count(*) FILTER (WHERE seen) / count(*), 6) AS record_rate, round(coalesce(sum(n_chars) FILTER (WHERE seen), 0) / sum(n_chars), 6) AS phone_rate FROM m""")
def prompt_overlap(spark, sf_dir):
    rows = prompts(spark, sf_dir)
    return rounded(leakage.overlap(rows.where("source <> 'src0'"), rows.where("source = 'src0'"), "k", "n_chars"))


@query(f"WITH d AS (SELECT *, {CANON} AS k FROM documents) SELECT doc_id, k IN (SELECT k FROM d WHERE source <> 'src1') AS seen_prompt, lang IN (SELECT lang FROM d WHERE source <> 'src1') AS seen_lang FROM d WHERE source = 'src1'")
def seen_unseen(spark, sf_dir):
    rows = prompts(spark, sf_dir)
    return leakage.seen_flags(rows.where("source = 'src1'"), rows.where("source <> 'src1'"), prompt=F.col("k"), lang=F.col("lang")).select("doc_id", "seen_prompt", "seen_lang")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'scored' ELSE 'missing' END AS status FROM documents")
def coverage_status(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("status", F.lit("scored"))
    return table(spark, sf_dir, "documents").select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("missing")).alias("status"))


@query("SELECT count(*)::BIGINT AS eligible, count(l.doc_id)::BIGINT AS scored, round(100.0 * count(l.doc_id) / count(*), 6) AS percent FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def coverage_rate(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("s")).distinct()
    joined = table(spark, sf_dir, "documents").join(scored, F.col("doc_id") == F.col("s"), "left")
    return rounded(joined.agg(F.count(F.lit(1)).alias("eligible"), F.count("s").alias("scored"), (100.0 * F.count("s") / F.count(F.lit(1))).alias("percent")))


@query("SELECT doc_id, 'missing' AS side FROM (SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT DISTINCT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def key_set_difference(spark, sf_dir):
    return leakage.set_difference_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def split_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"))


EMBED = "WITH e AS (SELECT vec_id, label, embedding FROM embeddings)"


@query(EMBED + """, x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM e), s AS (SELECT label, d, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY ALL),
w AS (SELECT sum(ss - qq) AS w, sum(n * (n - 1)) AS wn, sum(n) AS n, sum(qq) AS qq FROM (SELECT label, sum(s * s) AS ss, sum(q) AS qq FROM s GROUP BY label) JOIN (SELECT label, count(*) AS n FROM e GROUP BY label) USING (label)),
t AS (SELECT sum(s * s) AS t FROM (SELECT d, sum(s) AS s FROM s GROUP BY d))
SELECT round(w / wn, 8) AS within, round((t - qq - w) / (n * (n - 1) - wn), 8) AS between FROM w CROSS JOIN t""")
def cluster_quality(spark, sf_dir):
    return rounded(vectors.cluster_quality(table(spark, sf_dir, "embeddings"), "label", "embedding"), 8)


@query(EMBED + """, i AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM e), s AS (SELECT unnest([499, 997, 1499, 1999, 2503]) AS stride)
SELECT a.vec_id, b.vec_id AS other, stride::INTEGER AS stride, round(greatest(-1, least(1, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) + 0.0 AS similarity
FROM i a JOIN s ON stride % a.n <> 0 JOIN i b ON b.i = (a.i + stride) % a.n""")
def impostor_similarities(spark, sf_dir):
    return rounded(vectors.impostor_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


@query("""WITH h AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings)
SELECT vec_id, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 6) + 0.0 AS similarity FROM h""")
def half_clip_similarity(spark, sf_dir):
    h = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rounded(h.select("vec_id", (arrays.dot(a, b) / F.sqrt(arrays.dot(a, a) * arrays.dot(b, b))).alias("similarity")))


@query(EMBED + """, x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM e), c AS (SELECT label AS centroid, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(v) AS m FROM x GROUP BY ALL) GROUP BY label),
r AS (SELECT vec_id, centroid, list_distance(e.embedding::DOUBLE[], c) AS distance FROM e CROSS JOIN c), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, centroid) AS k FROM r)
SELECT vec_id, max(centroid) FILTER (WHERE k = 1) AS centroid, round(max(distance) FILTER (WHERE k = 1), 6) AS distance, round((max(distance) FILTER (WHERE k = 2) - max(distance) FILTER (WHERE k = 1)) / max(distance) FILTER (WHERE k = 2), 6) AS confidence FROM k GROUP BY vec_id""")
def nearest_centroids(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(vectors.nearest_centroid(rows, "vec_id", "embedding", vectors.centroids_of(rows, "label", "embedding")))


@query("""WITH d AS (SELECT source, lang FROM documents), b AS (SELECT source, lang, count(*) AS n FROM d GROUP BY ALL), i AS (SELECT source, sum(n * (n - 1) / 2) AS same, sum(n) AS n, count(*) AS t FROM b GROUP BY source),
w AS (SELECT sum(same) / sum(n * (n - 1) / 2) AS cr, avg((t > 1)::INTEGER) AS multi FROM i), a AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM (SELECT lang, sum(n) AS n FROM b GROUP BY lang))
SELECT round(s / (n * (n - 1) / 2), 6) AS base_rate, round(cr, 6) AS cluster_rate, round(multi, 6) AS multi_text, round(cr / (s / (n * (n - 1) / 2)), 6) AS lift FROM w CROSS JOIN a""")
def text_confound(spark, sf_dir):
    return rounded(vectors.text_confound(table(spark, sf_dir, "documents"), "source", "lang"))


@query()
def linkage_clusters(spark, sf_dir):
    return vectors.linkage_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.35)


@query()
def k_means_profiles(spark, sf_dir):
    return rounded(vectors.k_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4))


@query("""WITH b AS (SELECT label, vec_id % 4 AS g, count(*) AS n FROM embeddings GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM b), x AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT label, sum(n) AS n FROM b GROUP BY label)), y AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT g, sum(n) AS n FROM b GROUP BY g))
SELECT round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) + 0.0 AS ari FROM s, x, y""")
def adjusted_rand_index(spark, sf_dir):
    return rounded(vectors.adjusted_rand(table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 4).alias("g")), "label", "g"))


def ratings(spark, sf_dir):
    """Three raters over the label table; the third is made from the id."""
    each = F.array(F.struct(F.lit("a").alias("rater"), F.col("quality").alias("rating")), F.struct(F.lit("b").alias("rater"), F.col("toxic").alias("rating")), F.struct(F.lit("c").alias("rater"), (F.col("doc_id") % 3).cast("int").alias("rating")))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.inline(each))


RATINGS = "WITH t AS (SELECT doc_id AS item, 'a' AS rater, quality::INTEGER AS rating FROM labels UNION ALL SELECT doc_id, 'b', toxic::INTEGER FROM labels UNION ALL SELECT doc_id, 'c', (doc_id % 3)::INTEGER FROM labels)"


@query(RATINGS + """, c AS (SELECT item, count(*) FILTER (WHERE rating = 0) AS c0, count(*) FILTER (WHERE rating = 1) AS c1, count(*) FILTER (WHERE rating = 2) AS c2, count(*) AS m FROM t GROUP BY item HAVING count(*) > 1),
o AS (SELECT count(*) AS u, sum(m) AS r, sum(c0 * (c0 - 1) / (m - 1)) AS o00, sum(c1 * (c1 - 1) / (m - 1)) AS o11, sum(c2 * (c2 - 1) / (m - 1)) AS o22, sum(c0 * c1 / (m - 1)) AS o01, sum(c0 * c2 / (m - 1)) AS o02, sum(c1 * c2 / (m - 1)) AS o12 FROM c),
n AS (SELECT *, o00 + o01 + o02 AS n0, o01 + o11 + o12 AS n1, o02 + o12 + o22 AS n2 FROM o),
d AS (SELECT *, (n0 / 2 + n1 / 2) ** 2 AS d01, (n0 / 2 + n1 + n2 / 2) ** 2 AS d02, (n1 / 2 + n2 / 2) ** 2 AS d12 FROM n)
SELECT u::BIGINT AS n_units, r::BIGINT AS n_ratings, round(1 - (o01 * d01 + o02 * d02 + o12 * d12) * 2 / (2 * (n0 * n1 * d01 + n0 * n2 * d02 + n1 * n2 * d12) / (n0 + n1 + n2 - 1)), 6) AS alpha FROM d""")
def krippendorff_alpha(spark, sf_dir):
    return rounded(agreement.krippendorff_ordinal(ratings(spark, sf_dir)))


@query(RATINGS + " SELECT x.rater AS rater_a, y.rater AS rater_b, count(*)::BIGINT AS n, count(*) FILTER (WHERE x.rating = y.rating)::BIGINT AS exact, round(count(*) FILTER (WHERE x.rating = y.rating) / count(*), 6) AS exact_rate FROM t x JOIN t y ON x.item = y.item AND x.rater < y.rater GROUP BY ALL")
def pairwise_agreement(spark, sf_dir):
    return rounded(agreement.pairwise_agreement(ratings(spark, sf_dir)))


@query(RATINGS + " SELECT item, CASE WHEN count(*) FILTER (WHERE rating = 0) * 2 > 3 THEN 0 WHEN count(*) FILTER (WHERE rating = 1) * 2 > 3 THEN 1 WHEN count(*) FILTER (WHERE rating = 2) * 2 > 3 THEN 2 ELSE -1 END AS consensus, count(*)::BIGINT AS n_ratings FROM t GROUP BY item")
def rater_consensus(spark, sf_dir):
    return agreement.consensus(ratings(spark, sf_dir), 3).withColumn("consensus", F.coalesce("consensus", F.lit(-1)))


@query("""WITH k AS (SELECT quality, count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS s FROM labels GROUP BY quality), z AS (SELECT *, s / n AS p, 1.959963984540054 AS z FROM k)
SELECT quality, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM z""")
def wilson_intervals(spark, sf_dir):
    counts = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("toxic").cast("double").alias("s"))
    low, high = agreement.wilson(F.col("s"), F.col("n"))
    return rounded(counts.select("quality", low.alias("low"), high.alias("high")))


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return rounded(ranking.latest(rows, ("user_id", "event_type"), "ts", "event_id").select("user_id", "event_type", "event_id", "value"))


@query("SELECT user_id, count(*)::BIGINT AS total, count(*) FILTER (WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2))::BIGINT AS completed FROM events GROUP BY user_id")
def review_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    done = F.broadcast(rows.select("event_type").distinct().orderBy("event_type").limit(2).withColumn("done", F.lit(1)))
    return rows.join(done, "event_type", "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count("done").alias("completed"))


@query("WITH d AS (SELECT event_id, count(*) AS n FROM events GROUP BY event_id) SELECT count(*)::BIGINT AS keys, count(*) FILTER (WHERE n > 1)::BIGINT AS repeated FROM d")
def ledger_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("keys"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"))


@query("""WITH d AS (SELECT doc_id, (n_chars % 180)::INTEGER AS n FROM documents), k AS (SELECT doc_id, n, unnest(range(0, greatest(1, ceil((n - 50) / 40) + 1)::INTEGER)) AS k FROM d WHERE n > 0)
SELECT DISTINCT doc_id, (CASE WHEN n <= 50 THEN 0 ELSE least(k * 40, n - 50) END)::INTEGER AS start, (CASE WHEN n <= 50 THEN n ELSE least(k * 40, n - 50) + 50 END)::INTEGER AS "end" FROM k""")
def phone_windows(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 180).cast("int").alias("n"))
    return n.select("doc_id", F.inline(arrays.index_windows(F.col("n"))))


@query("""WITH o AS (SELECT l_orderkey AS k, list(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS v FROM lineitem GROUP BY 1),
x AS (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM o), y AS (SELECT k, i, x, lag(x) OVER (PARTITION BY k ORDER BY i) AS w FROM x)
SELECT k, count(*) FILTER (WHERE w IS DISTINCT FROM x)::BIGINT AS runs, count(*) FILTER (WHERE w IS DISTINCT FROM x AND x <> 0)::BIGINT AS decoded FROM y GROUP BY k""")
def ctc_collapse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("v"))
    v = F.transform(F.array_sort(F.collect_list(key)), lambda s: s["v"])
    per = rows.groupBy(F.col("l_orderkey").alias("k")).agg(v.alias("v"))
    return per.select("k", F.size(arrays.run_starts(F.col("v"))).cast("long").alias("runs"), F.size(arrays.ctc_greedy(F.col("v"))).cast("long").alias("decoded"))


@query()
def conversation_word_errors(spark, sf_dir):
    """Word errors of each turn against the one before."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("reference"))
    b = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    e = a.join(b, ["conv_id", "turn"]).withColumn("e", texts.word_edits("reference", "hypothesis"))
    return rounded(e.select("conv_id", "turn", "e.edits", "e.words", texts.word_error_rate(F.col("e")).alias("wer")))


@query()  # whole texts take SQL too long; tests compare with a plain edit distance
def phone_error_rate(spark, sf_dir):
    """Corpus edits over reference length, on all letters of neighbouring documents."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("a"))
    b = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    e = w.join(b, "doc_id").select(F.length("a").alias("n"), texts.sequence_distance("a", "b").alias("e"))
    return rounded(e.agg(F.count(F.lit(1)).alias("pairs"), F.sum("e").alias("edits"), F.try_divide(F.sum("e"), F.sum("n")).alias("error_rate")))


@query()
def constrained_alignment(spark, sf_dir):
    """Viterbi spans of four targets over frames made from the embeddings."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.transform(F.slice(F.col("embedding"), t * 4 + 1, F.lit(4)), lambda x: x.cast("double"))).alias("p"), F.array(F.lit(1), F.lit(1), F.lit(2), F.lit(3)).alias("t"))
    return rows.select("vec_id", sequences.align_phones("p", "t").alias("a")).select("vec_id", "a.fallback", F.posexplode("a.spans").alias("phone", "s")).select("vec_id", "fallback", "phone", "s.start", "s.end")


@query("""WITH d AS (SELECT doc_id, 1 + n_chars % 37 AS f, 1 + n_chars % 5 AS n FROM documents), k AS (SELECT doc_id, f, n, unnest(range(0, n)) AS k FROM d), s AS (SELECT doc_id, k, f, n, least(k * f // n, f - 1) AS a FROM k)
SELECT doc_id, k::INTEGER AS phone, a::INTEGER AS start, greatest((k + 1) * f // n, a + 1)::INTEGER AS "end" FROM s""")
def uniform_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (1 + F.col("n_chars") % 37).cast("int").alias("f"), (1 + F.col("n_chars") % 5).cast("int").alias("n"))
    return d.select("doc_id", F.posexplode(arrays.uniform_spans(F.col("f"), F.col("n"))).alias("phone", "s")).select("doc_id", "phone", "s.start", "s.end")


@query("SELECT n_name, count(*)::BIGINT AS records, sum(c_acctbal > 0)::BIGINT AS positive FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def group_join_counts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("c_acctbal") > 0, 1)).alias("positive"))


@query("SELECT source, sha256('[' || string_agg(x, ',' ORDER BY x) || ']') AS digest FROM (SELECT DISTINCT source, '\"' || lang || '\"' AS x FROM documents) GROUP BY source")
def key_set_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(hashing.key_set_digest(F.col("lang")).alias("digest"))


@query("SELECT l_suppkey % 7 AS cluster, count(*)::BIGINT AS size FROM lineitem GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return tokens(spark, sf_dir).groupBy((F.col("speaker") % 7).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


@query("""WITH k AS (SELECT t.i AS threshold, l_suppkey // t.i AS cluster, count(*) AS n FROM lineitem CROSS JOIN (SELECT unnest([1, 2, 5, 10]) AS i) t GROUP BY ALL)
SELECT threshold, count(*)::BIGINT AS clusters, max(n)::BIGINT AS largest, round(median(n), 6) AS median, round(avg((n = 1)::INTEGER), 6) AS singletons FROM k GROUP BY threshold""")
def cluster_sweep(spark, sf_dir):
    each = F.explode(F.array(*(F.lit(i) for i in (1, 2, 5, 10)))).alias("threshold")
    k = tokens(spark, sf_dir).groupBy("speaker").agg(F.count(F.lit(1)).alias("n")).select("speaker", "n", each).groupBy("threshold", F.floor(F.col("speaker") / F.col("threshold")).alias("cluster")).agg(F.sum("n").alias("n"))
    return rounded(k.groupBy("threshold").agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"), F.median("n").alias("median"), F.avg((F.col("n") == 1).cast("double")).alias("singletons")))


@query("SELECT lang, round(var_pop(n_chars), 4) AS spread, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def text_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.var_pop("n_chars"), 4).alias("spread"), F.count(F.lit(1)).alias("n"))


@query("WITH n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source) SELECT count(*)::BIGINT AS groups, round(sum(n) ** 2 / sum(n * n), 6) AS effective FROM n")
def effective_sources(spark, sf_dir):
    return rounded(weights.effective_count(table(spark, sf_dir, "documents"), "source"))
