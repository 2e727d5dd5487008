"""Queries over record sets: selections, matches, differences and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import records
from .assessment import SOURCE, rounded, tokens
from .registry import query


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(SOURCE + ", s AS (SELECT phone, fold, sum(score) FILTER (WHERE label = 0) / count(*) FILTER (WHERE label = 0) AS zero, avg(score) AS score FROM p GROUP BY ALL) SELECT phone, round(avg(zero), 6) AS zero, round(avg(score), 6) AS score, count(*)::BIGINT AS seeds FROM s WHERE zero IS NULL OR isfinite(zero) GROUP BY phone")
def seed_means(spark, sf_dir):
    each = tokens(spark, sf_dir).groupBy("phone", "fold").agg(F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("zero"), F.avg("score").alias("score"))
    return rounded(records.mean_over_seeds(each, ("phone",), ("zero", "score")))


@query(SOURCE + "SELECT speaker, phone_index, label, round((score + score_b) / 2, 6) AS averaged FROM p")
def averaged_scores(spark, sf_dir):
    return rounded(records.average_scores(tokens(spark, sf_dir), ("score", "score_b")).select("speaker", "phone_index", "label", "averaged"))


@query(SOURCE + "SELECT utterance_id, count(score)::BIGINT AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS greatest FROM p GROUP BY utterance_id")
def utterance_summary(spark, sf_dir):
    return rounded(records.record_summary(tokens(spark, sf_dir), ("utterance_id",), "score"))


@query(SOURCE + "SELECT label, round(avg(score_b - score), 6) AS mean_difference, (count(*) FILTER (WHERE score_b > score))::BIGINT AS higher, (count(*) FILTER (WHERE score_b < score))::BIGINT AS lower, (count(*) FILTER (WHERE score_b = score))::BIGINT AS equal FROM p GROUP BY label")
def paired_score_differences(spark, sf_dir):
    return rounded(records.paired_differences(tokens(spark, sf_dir), ("label",), "score_b", "score"))


@query(SOURCE + """, a AS (SELECT speaker, phone, round(avg(score_b - score), 6) AS delta FROM p GROUP BY ALL)
SELECT speaker, phone, delta, row_number() OVER (PARTITION BY speaker ORDER BY abs(delta) DESC, phone)::INTEGER AS position FROM a QUALIFY position <= 5""")
def top_phone_deltas(spark, sf_dir):
    mean = rounded(tokens(spark, sf_dir).groupBy("speaker", "phone").agg(F.avg(F.col("score_b") - F.col("score")).alias("delta")))
    return records.top_by_magnitude(mean, ("speaker",), "delta", "phone", 5)


@query(SOURCE + ", r AS (SELECT speaker, utterance_id, floor((row_number() OVER (PARTITION BY speaker ORDER BY utterance_id, phone_index) - 1) / 64)::BIGINT AS chunk FROM p) SELECT speaker, chunk, count(*)::BIGINT AS n, min(utterance_id) AS first_utterance FROM r GROUP BY ALL")
def fixed_chunks(spark, sf_dir):
    cut = records.chunked(tokens(spark, sf_dir), ("speaker",), ("utterance_id", "phone_index"), 64)
    return cut.groupBy("speaker", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("utterance_id").alias("first_utterance"))


@query("SELECT n_regionkey, n_nationkey, coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), min(n_nationkey) OVER (PARTITION BY n_regionkey)) AS next FROM nation")
def cursor_cycle(spark, sf_dir):
    return records.next_in_cycle(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey"), ("n_regionkey",), "n_nationkey")


@query(SOURCE + "SELECT DISTINCT utterance_id FROM p WHERE fold = 0 AND utterance_id IN (SELECT utterance_id FROM p WHERE fold = 1)")
def shared_fold_keys(spark, sf_dir):
    rows = tokens(spark, sf_dir)
    return records.shared_keys(rows.where("fold = 0"), rows.where("fold = 1"), "utterance_id")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.n, 0)::BIGINT AS left_count, coalesce(b.n, 0)::BIGINT AS right_count FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id) a FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) b ON a.doc_id IS NOT DISTINCT FROM b.doc_id WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def label_multiset_difference(spark, sf_dir):
    return records.multiset_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS k FROM lineitem), r AS (SELECT DISTINCT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 0), j AS (SELECT l.k AS a, r.k AS b FROM l FULL JOIN r ON l.k = r.k)
SELECT (count(*) FILTER (WHERE b IS NULL))::BIGINT AS left_only, (count(*) FILTER (WHERE a IS NULL))::BIGINT AS right_only, (count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL))::BIGINT AS both, count(*) FILTER (WHERE b IS NULL) = 0 AND count(*) FILTER (WHERE a IS NULL) = 0 AS equal FROM j""")
def identical_row_sets(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"))
    return records.same_rows(left, table(spark, sf_dir, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("k")), "k")


@query("""WITH a AS (SELECT l_partkey AS k, avg(l_extendedprice / l_quantity) AS v FROM lineitem GROUP BY 1), b AS (SELECT p_partkey AS k, p_retailprice AS v FROM part)
SELECT (count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL))::BIGINT AS aligned, round(max(abs(a.v - b.v)), 6) AS largest, (count(*) FILTER (WHERE abs(a.v - b.v) > 100))::BIGINT AS beyond, (count(*) FILTER (WHERE a.k IS NULL OR b.k IS NULL))::BIGINT AS unpaired FROM a FULL JOIN b ON a.k = b.k""")
def aligned_value_comparison(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    return rounded(records.compare_values(left, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")), "k", "v", 100.0))


@query("""WITH d AS (SELECT DISTINCT 'audio/' || source || '/' || doc_id || '.wav' AS path, doc_id, source FROM documents),
k AS (SELECT doc_id || '.wav' AS key FROM d WHERE doc_id % 4 IN (0, 2) UNION SELECT source || '/' || doc_id || '.wav' FROM d WHERE doc_id % 4 IN (1, 2)),
h AS (SELECT path, count(*) AS n, min(key) AS key FROM d JOIN k ON ends_with(d.path, '/' || k.key) GROUP BY path)
SELECT d.path, CASE WHEN n = 1 THEN key END AS matched, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM d LEFT JOIN h USING (path)""")
def path_suffix_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("audio/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("path"), "doc_id", "source").distinct()
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".wav"))
    keys = d.where("doc_id % 4 IN (0, 2)").select(name.alias("key")).unionByName(d.where("doc_id % 4 IN (1, 2)").select(F.concat("source", F.lit("/"), name).alias("key")))
    return records.suffix_matches(d.select("path"), "path", keys, "key").select("path", "matched", "status")


@query("""WITH o AS (SELECT o_orderkey, 'a' || o_custkey AS first, 'b' || (o_orderkey % 50) AS second, 'c' || (o_orderkey % 3) AS third FROM orders),
k AS (SELECT 'a' || c_custkey AS key, 'customer' AS value FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'b' || i, 'bucket' FROM range(0, 20) t(i) UNION ALL SELECT 'c1', 'rest')
SELECT o_orderkey, coalesce(a.value, b.value, c.value) AS value FROM o LEFT JOIN k a ON a.key = first LEFT JOIN k b ON b.key = second LEFT JOIN k c ON c.key = third""")
def first_known_key(spark, sf_dir):
    key = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", key("a", F.col("o_custkey")).alias("first"), key("b", F.col("o_orderkey") % 50).alias("second"), key("c", F.col("o_orderkey") % 3).alias("third"))
    k = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(key("a", F.col("c_custkey")).alias("key"), F.lit("customer").alias("value"))
    k = k.unionByName(spark.range(20).select(key("b", F.col("id")).alias("key"), F.lit("bucket").alias("value"))).unionByName(spark.range(1).select(F.lit("c1").alias("key"), F.lit("rest").alias("value")))
    return records.first_known(o, ("first", "second", "third"), k, "key", "value", "o_orderkey").select("o_orderkey", "value")


@query("WITH w AS (SELECT * FROM (VALUES (0, 12), (1, 3), (2, 999), (3, 7), (4, 3)) t(place, n_nationkey)) SELECT place::INTEGER AS place, w.n_nationkey::BIGINT AS n_nationkey, n_name, n.n_nationkey IS NOT NULL AS known FROM w LEFT JOIN nation n ON n.n_nationkey = w.n_nationkey")
def keyed_selection(spark, sf_dir):
    rows = records.selection(table(spark, sf_dir, "nation"), "n_nationkey", [12, 3, 999, 7, 3])
    return rows.select("place", F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "known")


@query("""WITH t AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS a, string_split(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), ''), ' ') AS b FROM conversations)
SELECT conv_id, turn, coalesce(list_min([i - 1 FOR i IN range(1, least(len(a), len(b)) + 1) IF a[i] <> b[i]]), CASE WHEN len(a) <> len(b) THEN least(len(a), len(b)) END)::INTEGER AS mismatch FROM t""")
def sequence_mismatches(spark, sf_dir):
    from pyspark.sql import Window

    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), " ").alias("a"), F.split(F.coalesce(after, F.lit("")), " ").alias("b"))
    return t.select("conv_id", "turn", records.first_mismatch(F.col("a"), F.col("b")).alias("mismatch"))


@query(SOURCE + """, x AS (SELECT speaker, phone_index, score / 50 - 1 AS c, ln(1 + exp(score_b / 50 - 1)) AS g FROM p), q AS (SELECT *, 1 / (1 + exp(-(c + g / 2))) AS q1, 1 / (1 + exp(-(c - g / 2))) AS q2 FROM x)
SELECT speaker, phone_index, round(q1, 6) AS q1, round(q2, 6) AS q2, round(50 * (q1 + q2), 5) AS linked FROM q""")
def linked_scores(spark, sf_dir):
    q1, q2, score = records.link(F.col("score") / 50 - 1, F.col("score_b") / 50 - 1)
    rows = tokens(spark, sf_dir).select("speaker", "phone_index", q1.alias("q1"), q2.alias("q2"), F.round(score, 5).alias("linked"))
    return rounded(rows)


@query(SOURCE + "SELECT r::INTEGER AS rotation, CASE WHEN r = fold THEN 'test' WHEN (r + 1) % 5 = fold THEN 'calibration' ELSE 'fit' END AS part, count(*)::BIGINT AS n, count(DISTINCT speaker)::BIGINT AS speakers FROM p CROSS JOIN range(5) t(r) GROUP BY ALL")
def rotation_parts(spark, sf_dir):
    return records.rotations(tokens(spark, sf_dir), "fold", 5).groupBy("rotation", "part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("speaker").alias("speakers"))


@query("""WITH l AS (SELECT conv_id, turn, turn || '|' || coalesce(role, '') || '|' || coalesce(text, '') AS s FROM conversations)
SELECT conv_id, sha256('turns' || chr(10) || string_agg(strlen(s) || ':' || s || chr(10), '' ORDER BY turn, s)) AS digest FROM l GROUP BY conv_id""")
def conversation_digests(spark, sf_dir):
    line = F.concat(F.col("turn").cast("string"), F.lit("|"), F.coalesce("role", F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).alias("s")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", line).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", records.sequence_digest("turns", F.col("t.s")).alias("digest"))


@query("SELECT count(*)::BIGINT AS rows, (count(*) FILTER (WHERE c_acctbal IS NULL))::BIGINT AS missing, (count(*) FILTER (WHERE NOT isfinite(c_acctbal)))::BIGINT AS not_finite, (count(*) FILTER (WHERE c_acctbal < 0))::BIGINT AS below, (count(*) FILTER (WHERE c_acctbal > 5000 AND NOT isnan(c_acctbal)))::BIGINT AS above FROM customer")
def balance_domain(spark, sf_dir):
    return records.domain_violations(table(spark, sf_dir, "customer"), "c_acctbal", 0.0, 5000.0)


@query("""WITH t AS (SELECT conv_id, turn, role, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, role, len(w)::BIGINT AS n_tokens, len(w) > 100 AS too_many, array_to_string([i FOR i IN range(1, len(w) + 1) IF NOT w[i] IN ('the', 'a', 'and', 'to')], ' ') AS unknown FROM t""")
def token_reports(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    report = records.token_report(rows, "text", ("the", "a", "and", "to"), 100)
    return report.select("conv_id", "turn", "role", "n_tokens", "too_many", F.array_join(F.col("unknown").cast("array<string>"), " ").alias("unknown"))


@query("WITH k AS (SELECT doc_id, source, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT % 5)::INTEGER AS fold FROM documents WHERE source <> 'src0') SELECT fold, count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS sources FROM k GROUP BY fold")
def refolded_rest(spark, sf_dir):
    """Nested exclusion: a partition that was inspected before is dropped, the rest is folded anew."""
    rest = table(spark, sf_dir, "documents").where("source <> 'src0'").withColumn("fold", hashing.hash_fold(F.col("doc_id").cast("string"), 5))
    return rest.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@query(SOURCE + ", z AS (SELECT score FROM p WHERE label = 0) " + " UNION ALL ".join(f"SELECT {r}::DOUBLE AS rate, round(quantile_cont(score, 1 - {r}), 6) AS threshold FROM z" for r in (0.01, 0.05, 0.1)))
def impostor_thresholds(spark, sf_dir):
    """The scores that a given share of the impostors (label 0) exceed."""
    rates = (0.01, 0.05, 0.1)
    found = tokens(spark, sf_dir).where("label = 0").agg(F.percentile("score", [1 - r for r in rates]).alias("t"))
    pairs = F.arrays_zip(F.array(*(F.lit(r) for r in rates)).alias("rate"), F.col("t").alias("threshold"))
    return rounded(found.select(F.inline(pairs).alias("rate", "threshold")))
