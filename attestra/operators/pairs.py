"""Pairs, pools and small predicates: positional pairs, pool audits, rank comparison, batches of claims, prices, sections without titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import r6
from ..functions.text import first_prefix
from ..sources import records as R
from ..sources.tables import once, table
from .retrieval_metrics import gold_rank

# Prices per million tokens (input, output) by what the backend's name contains, in order.
PRICES = (("hosted:brack-2", 15.0, 75.0), ("hosted:", 3.0, 15.0))


def usd(spark: SparkSession, d: str) -> DataFrame:
    """Cost of the calls of each backend from its first matching price; null without a price or with unknown tokens."""
    r = R.records(spark, d, "backend", "prompt_tokens", "completion_tokens")
    a = first_prefix(F.col("backend"), tuple((n, x) for n, x, _ in PRICES), None)
    b = first_prefix(F.col("backend"), tuple((n, y) for n, _, y in PRICES), None)
    cost = (F.col("prompt_tokens") * a + F.col("completion_tokens") * b) / 1e6
    return r.withColumn("usd", cost).groupBy("backend").agg(F.count(F.lit(1)).alias("n"), F.count("usd").alias("n_priced"), F.round(F.sum("usd"), 4).alias("usd"))


def positional_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Claims of joint and post_hoc of one run, query and seed paired by place; records of unequal length are counted apart."""
    c = R.claims(spark, d, "record_id", "claim_id").join(R.records(spark, d, "run_id", "query_id", "seed", "system_name"), "record_id").where("system_name in ('joint', 'post_hoc')")
    n = c.groupBy("run_id", "query_id", "seed").agg(F.count_if(F.col("system_name") == "joint").alias("a"), F.count_if(F.col("system_name") == "post_hoc").alias("b"))
    return n.agg(F.sum(F.least("a", "b")).alias("n_pairs"), F.count_if(F.col("a") != F.col("b")).alias("n_unequal"), F.count(F.lit(1)).alias("n_groups"))


def rank_shift(spark: SparkSession, d: str) -> DataFrame:
    """Gold ranks of each record against the median of its query: better, worse, same, missing; a missing rank comes last."""
    g = gold_rank(spark, d).where("query_id is not null")
    m = g.groupBy("query_id").agg(F.median("gold_rank").alias("m"))
    x = g.join(m, "query_id").withColumns({"x": F.coalesce(F.col("gold_rank").cast("double"), F.lit(1e18)), "y": F.coalesce("m", F.lit(1e18))})
    why = F.when(F.col("gold_rank").isNull(), "missing").when(F.col("x") < F.col("y"), "better").when(F.col("x") > F.col("y"), "worse").otherwise("same")
    return x.groupBy(why.alias("shift")).agg(F.count(F.lit(1)).alias("n"))


def pool_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per query: sources in its pool, and passages of these sources that the pool lacks."""
    pool = R.ranked(spark, d, "query_id").select("query_id", "passage_id").distinct().withColumn("source_id", F.substring_index("passage_id", ":", 1))
    n = pool.groupBy("query_id").agg(F.count_distinct("source_id").alias("n_sources"), F.count(F.lit(1)).alias("n_pool"))
    sib = pool.select("query_id", "source_id").distinct().join(R.passages(spark, d).select("source_id", "passage_id"), "source_id").join(pool.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti")
    return n.join(sib.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id", "left").select("query_id", "n_sources", "n_pool", F.coalesce("m", F.lit(0)).alias("n_siblings_outside"))


def pool_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources of each record's list in the order of their best rank."""
    k = R.ranked(spark, d).groupBy("record_id", F.substring_index("passage_id", ":", 1).alias("source_id")).agg(F.min("rank_no").alias("best"))
    g = k.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("best", "source_id"))).alias("a"))
    return g.select("record_id", F.array_join(F.transform("a", lambda x: x["source_id"]), ",").alias("sources"))


def claim_batches(spark: SparkSession, d: str, size: int = 5) -> DataFrame:
    """Claims of a record in batches of five by their number, with the place in the batch."""
    c = R.claims(spark, d, "record_id", "claim_id").select("claim_key", "record_id", F.regexp_extract("claim_id", r"(\d+)", 1).cast("int").alias("i")).where("i >= 1")
    return c.select("claim_key", F.floor((F.col("i") - 1) / size).cast("bigint").alias("batch_no"), (F.pmod(F.col("i") - 1, F.lit(size)) + 1).cast("bigint").alias("place"))


def two_arm_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries that both joint and post_hoc answered, with the claims of each."""
    c = R.claims(spark, d, "record_id").join(R.records(spark, d, "query_id", "system_name"), "record_id").groupBy("query_id").agg(F.count_if(F.col("system_name") == "joint").alias("joint"), F.count_if(F.col("system_name") == "post_hoc").alias("post_hoc"))
    return c.where("joint > 0 and post_hoc > 0")


def l2_norms(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the vectors, and of them after scaling; a zero vector stays as it is."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return table(spark, d, "embeddings").select("vec_id", F.round(n, 5).alias("norm"), F.round(F.sqrt(F.aggregate(F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)), F.lit(0.0), lambda a, x: a + x * x)), 5).alias("scaled"))


def unit_hits(spark: SparkSession, d: str) -> DataFrame:
    """Units of the hit at 5: one boolean per record with gold, and their number and share by query."""
    g = gold_rank(spark, d).where("n_gold > 0")
    return g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold_rank") <= 5).alias("hits"), r6(F.avg(F.coalesce((F.col("gold_rank") <= 5).cast("double"), F.lit(0.0))), "share"))


def best_span_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of claims over several premises: the greatest of each verifier per claim, and the sum of these per query."""
    v = once(table(spark, d, "verifier_scores").select("score_id", "claim_key", "query_id", "verifier_name", "score"), "score_id").where("score is not null and not isnan(score)")
    top = v.groupBy("query_id", "claim_key", "verifier_name").agg(F.greatest(F.lit(0.0), F.max("score")).alias("top"))
    return top.groupBy("query_id", "verifier_name").agg(F.count(F.lit(1)).alias("n_claims"), F.round(F.sum(F.round("top", 6).cast("decimal(20,6)")), 3).cast("double").alias("sum_top"))


def backend_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Backends by their median latency, with means and extremes, and whether any call lacks it."""
    r = R.records(spark, d, "backend", "latency_s").withColumn("l", F.when(~F.isnan("latency_s"), F.col("latency_s")))
    return r.groupBy("backend").agg(F.count(F.lit(1)).alias("n"), r6(F.median("l"), "median_s"), F.round(F.avg("l"), 4).alias("mean_s"), r6(F.min("l"), "min_s"), r6(F.max("l"), "max_s"), F.bool_or(F.col("l").isNull()).alias("any_missing"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Chunk configs judged: ineligible if more than a tenth of their chunks exceed the limit, refused if they hold too few chunks, else they earn."""
    c = once(table(spark, d, "chunks").select("chunk_id", "config_id", "text"), "chunk_id").join(table(spark, d, "chunk_configs").select("config_id", "max_chars"), "config_id")
    g = c.groupBy("config_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.char_length("text") > F.col("max_chars")).alias("over"))
    return g.select("config_id", "n", "over", F.when(F.col("over") > F.col("n") * 0.1, "ineligible").when(F.col("n") < 100, "refused").otherwise("earns").alias("verdict"))


def titled(spark: SparkSession, d: str) -> DataFrame:
    """Passages that are blank, or that begin with their own label as a title; the rest may be indexed."""
    c = once(table(spark, d, "chunks").select("chunk_id", "label", "text"), "chunk_id")
    t = F.coalesce(F.trim("text"), F.lit(""))
    label = F.coalesce(F.trim("label"), F.lit(""))
    why = F.when(t == "", "blank").when((label != "") & F.startswith(F.lower(t), F.lower(label)), "titled").otherwise("kept")
    return c.groupBy(why.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def completed(spark: SparkSession, d: str) -> DataFrame:
    """Per annotator: questions done, answers with a judged validity, and the hours that all questions would take at this pace."""
    x = once(table(spark, d, "human_labels").select("label_id", "annotator_id", "question_uid", "claim_validity", "saved_at"), "label_id").where("annotator_id is not null")
    total = x.agg(F.count_distinct("question_uid").alias("total"))
    g = x.groupBy("annotator_id").agg(F.count_distinct("question_uid").alias("done"), F.count("claim_validity").alias("judged"))
    return g.crossJoin(total).select("annotator_id", "done", "judged", r6(F.col("judged") * 30.0 / F.nullif(F.col("done"), F.lit(0)) * F.col("total") / 3600, "projected_hours"))


QUERIES = {
    "agg20_backend_ranking": backend_ranking,
    "fn25_l2_norms": l2_norms,
    "fn29_usd": usd,
    "jn7_two_arm_queries": two_arm_queries,
    "jn9_positional_pairs": positional_pairs,
    "jn15_pool_audit": pool_audit,
    "jn15_pool_sources": pool_sources,
    "jn16_rank_shift": rank_shift,
    "pa7_claim_batches": claim_batches,
    "prj5_titled": titled,
    "prj13_completed": completed,
    "prj16_verdicts": verdicts,
    "sc24_unit_hits": unit_hits,
    "sc29_best_span_scores": best_span_scores,
}

_PRE = "WITH r AS (SELECT DISTINCT ON (record_id) * FROM query_records), c AS (SELECT DISTINCT ON (claim_key) * FROM claims), hl AS (SELECT DISTINCT ON (label_id) * FROM human_labels), ch AS (SELECT DISTINCT ON (chunk_id) * FROM chunks), k AS (SELECT record_id, query_id, unnest(retrieved, recursive := true) FROM r), g AS (SELECT DISTINCT record_id, unnest(gold_passage_ids) AS passage_id FROM r), f AS (SELECT k.record_id, min(rank_no) AS gold_rank FROM k SEMI JOIN g ON k.record_id = g.record_id AND k.passage_id = g.passage_id GROUP BY 1), gr AS (SELECT r.record_id, query_id, gold_rank, coalesce(len(list_distinct(gold_passage_ids)), 0) AS n_gold FROM r LEFT JOIN f USING (record_id)), pool AS (SELECT DISTINCT query_id, passage_id, split_part(passage_id, ':', 1) AS source_id FROM k), p AS (SELECT passage_id, arg_min(source_id, chunk_id) AS source_id FROM chunks WHERE passage_id IS NOT NULL AND text IS NOT NULL GROUP BY 1) "

SQL = {
    "agg20_backend_ranking": _PRE + "SELECT backend, count(*) AS n, round(median(l), 6) AS median_s, round(avg(l), 4) AS mean_s, round(min(l), 6) AS min_s, round(max(l), 6) AS max_s, bool_or(l IS NULL) AS any_missing FROM (SELECT backend, CASE WHEN NOT isnan(latency_s) THEN latency_s END AS l FROM r) GROUP BY 1",
    "fn25_l2_norms": "SELECT vec_id, round(sqrt(list_dot_product(e, e)), 5) AS norm, CASE WHEN list_dot_product(e, e) = 0 THEN 0.0 ELSE round(sqrt(list_sum(list_transform(e, lambda x: (x / sqrt(list_dot_product(e, e))) * (x / sqrt(list_dot_product(e, e)))))), 5) END AS scaled FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
    "fn29_usd": _PRE + "SELECT backend, count(*) AS n, count(u) AS n_priced, round(sum(u), 4) AS usd FROM (SELECT backend, (prompt_tokens * CASE WHEN contains(backend, 'hosted:brack-2') THEN 15.0::DOUBLE WHEN contains(backend, 'hosted:') THEN 3.0::DOUBLE END + completion_tokens * CASE WHEN contains(backend, 'hosted:brack-2') THEN 75.0::DOUBLE WHEN contains(backend, 'hosted:') THEN 15.0::DOUBLE END) / 1e6 AS u FROM r) GROUP BY 1",
    "jn7_two_arm_queries": _PRE + "SELECT query_id, count(*) FILTER (system_name = 'joint') AS joint, count(*) FILTER (system_name = 'post_hoc') AS post_hoc FROM c JOIN r USING (record_id) GROUP BY 1 HAVING count(*) FILTER (system_name = 'joint') > 0 AND count(*) FILTER (system_name = 'post_hoc') > 0",
    "jn9_positional_pairs": _PRE + "SELECT sum(least(a, b))::BIGINT AS n_pairs, count(*) FILTER (a <> b) AS n_unequal, count(*) AS n_groups FROM (SELECT count(*) FILTER (system_name = 'joint') AS a, count(*) FILTER (system_name = 'post_hoc') AS b FROM c JOIN r USING (record_id) WHERE system_name IN ('joint', 'post_hoc') GROUP BY run_id, query_id, seed)",
    "jn15_pool_audit": _PRE + "SELECT query_id, n_sources, n_pool, coalesce(m, 0) AS n_siblings_outside FROM (SELECT query_id, count(DISTINCT source_id) AS n_sources, count(*) AS n_pool FROM pool GROUP BY 1) LEFT JOIN (SELECT s.query_id, count(*) AS m FROM (SELECT DISTINCT query_id, source_id FROM pool) s JOIN p USING (source_id) ANTI JOIN pool ON pool.query_id = s.query_id AND pool.passage_id = p.passage_id GROUP BY 1) USING (query_id)",
    "jn15_pool_sources": _PRE + "SELECT record_id, string_agg(source_id, ',' ORDER BY best, source_id) AS sources FROM (SELECT record_id, split_part(passage_id, ':', 1) AS source_id, min(rank_no) AS best FROM k GROUP BY 1, 2) GROUP BY 1",
    "jn16_rank_shift": _PRE + "SELECT CASE WHEN gold_rank IS NULL THEN 'missing' WHEN gold_rank < coalesce(m, 1e18) THEN 'better' WHEN gold_rank > coalesce(m, 1e18) THEN 'worse' ELSE 'same' END AS shift, count(*) AS n FROM (SELECT gold_rank, median(gold_rank) OVER (PARTITION BY query_id) AS m FROM gr WHERE query_id IS NOT NULL) GROUP BY 1",
    "pa7_claim_batches": _PRE + r"SELECT claim_key, (i - 1) // 5 AS batch_no, (i - 1) % 5 + 1 AS place FROM (SELECT claim_key, try_cast(regexp_extract(claim_id, '(\d+)', 1) AS BIGINT) AS i FROM c) WHERE i >= 1",
    "prj5_titled": _PRE + "SELECT CASE WHEN coalesce(trim(text, ' '), '') = '' THEN 'blank' WHEN coalesce(trim(label, ' '), '') <> '' AND starts_with(lower(trim(text, ' ')), lower(trim(label, ' '))) THEN 'titled' ELSE 'kept' END AS state, count(*) AS n FROM ch GROUP BY 1",
    "prj13_completed": _PRE + "SELECT annotator_id, done, judged, round(judged * 30.0::DOUBLE / nullif(done, 0) * total / 3600, 6) AS projected_hours FROM (SELECT annotator_id, count(DISTINCT question_uid) AS done, count(claim_validity) AS judged FROM hl WHERE annotator_id IS NOT NULL GROUP BY 1), (SELECT count(DISTINCT question_uid) AS total FROM hl WHERE annotator_id IS NOT NULL)",
    "prj16_verdicts": _PRE + "SELECT config_id, n, over_ AS \"over\", CASE WHEN over_ > n * 0.1 THEN 'ineligible' WHEN n < 100 THEN 'refused' ELSE 'earns' END AS verdict FROM (SELECT config_id, count(*) AS n, count(*) FILTER (length(text) > max_chars) AS over_ FROM ch JOIN chunk_configs USING (config_id) GROUP BY 1)",
    "sc24_unit_hits": _PRE + "SELECT query_id, count(*) AS n, count(*) FILTER (gold_rank <= 5) AS hits, round(avg(coalesce((gold_rank <= 5)::INT, 0)), 6) AS share FROM gr WHERE n_gold > 0 GROUP BY 1",
    "sc29_best_span_scores": "WITH v AS (SELECT DISTINCT ON (score_id) * FROM verifier_scores) SELECT query_id, verifier_name, count(*) AS n_claims, round(sum(round(top, 6)::DECIMAL(20,6)), 3)::DOUBLE AS sum_top FROM (SELECT query_id, claim_key, verifier_name, greatest(0, max(score)) AS top FROM v WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3) GROUP BY 1, 2",
}
