"""Retrieval metrics over ranked lists and gold sets: gold ranks, hits, recall, MRR, nDCG, intervals and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import r6, wilson
from ..sources import records as R

KS = (1, 5, 10)


def gold_found(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Ranked rows whose passage is gold (a semi join on record and passage)."""
    return R.ranked(spark, d, *cols).join(R.gold(spark, d), ["record_id", "passage_id"], "left_semi")


def gold_rank(spark: SparkSession, d: str) -> DataFrame:
    """Per record the smallest rank of a gold passage, null if none was retrieved; with the size of the gold set."""
    size = F.size(F.array_distinct(F.coalesce("gold_passage_ids", F.array().cast("array<string>"))))
    rec = R.records(spark, d, "system_name", "query_id", "gold_passage_ids").select("record_id", "system_name", "query_id", size.cast("bigint").alias("n_gold"))
    best = gold_found(spark, d).groupBy("record_id").agg(F.min("rank_no").alias("gold_rank"))
    return rec.join(best, "record_id", "left")


def hit_curve(ranks: DataFrame, by: str, ks=KS) -> DataFrame:
    """Hits within each k, of all records, with the Wilson interval; misses stay in n."""
    one = ranks.select(by, "gold_rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    g = one.groupBy(by, "k").agg(F.count_if(F.col("gold_rank") <= F.col("k")).alias("hits"), F.count(F.lit(1)).alias("n"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return g.select(by, "k", "hits", "n", r6(F.col("hits") / F.col("n"), "hit_rate"), r6(lo, "lower"), r6(hi, "upper"))


def with_gold(ranks: DataFrame) -> DataFrame:
    """Records with a gold set: recall, MRR and nDCG are undefined without one."""
    return ranks.where("n_gold > 0")


def recall_at(spark: SparkSession, d: str, ks=KS) -> DataFrame:
    """Macro average per system of found gold within k over all gold, reachable or not."""
    ranks = with_gold(gold_rank(spark, d))
    found = gold_found(spark, d).groupBy("record_id").agg(*[F.count_distinct(F.when(F.col("rank_no") <= k, F.col("passage_id"))).alias(f"f{k}") for k in ks])
    x = ranks.join(found, "record_id", "left")
    return x.groupBy("system_name").agg(F.count(F.lit(1)).alias("n"), *[r6(F.avg(F.coalesce(F.col(f"f{k}"), F.lit(0)) / F.col("n_gold")), f"recall_at_{k}") for k in ks])


def mrr(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal gold rank, a miss counting 0."""
    return with_gold(gold_rank(spark, d)).groupBy("system_name").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0))), "mrr"))


def ndcg(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """Binary-gain nDCG at k; the ideal has min(gold, k) leading hits."""
    ranks = with_gold(gold_rank(spark, d))
    gain = gold_found(spark, d).where(F.col("rank_no") <= k).groupBy("record_id").agg(F.sum(1 / F.log2(F.col("rank_no") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold").cast("int"), F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    x = ranks.join(gain, "record_id", "left").withColumn("v", F.coalesce("dcg", F.lit(0.0)) / ideal)
    return x.groupBy("system_name").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v"), "ndcg_at_10"))


def gate(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """The retrieval gate at k: hit rate at least .90 and Wilson lower bound above .85."""
    c = hit_curve(gold_rank(spark, d), "system_name", (k,))
    return c.withColumn("passes", (F.col("hit_rate") >= 0.90) & (F.col("lower") > 0.85))


def pack(spark: SparkSession, d: str) -> DataFrame:
    """All retrieval figures of a system in one row."""
    c = hit_curve(gold_rank(spark, d), "system_name", (5, 10)).groupBy("system_name").agg(*[F.max(F.when(F.col("k") == k, F.col("hit_rate"))).alias(f"hit_at_{k}") for k in (5, 10)])
    rec = recall_at(spark, d).select("system_name", "recall_at_5")
    return c.join(rec, "system_name").join(mrr(spark, d).select("system_name", "mrr"), "system_name").join(ndcg(spark, d).select("system_name", "ndcg_at_10"), "system_name")


def rank_stats(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of gold ranks per system: in and out of the list, mean, median, extremes, six buckets."""
    r = F.col("gold_rank")
    bands = {"rank_1": (1, 1), "rank_2_5": (2, 5), "rank_6_10": (6, 10), "rank_11_20": (11, 20), "rank_21_50": (21, 50), "rank_51_100": (51, 100)}
    return (
        gold_rank(spark, d)
        .groupBy("system_name")
        .agg(
            F.count("gold_rank").alias("in_pool"),
            F.count_if(r.isNull()).alias("not_in_pool"),
            r6(F.avg(r), "mean_rank"),
            r6(F.median(r), "median_rank"),
            F.min(r).cast("bigint").alias("min_rank"),
            F.max(r).cast("bigint").alias("max_rank"),
            *[F.count_if(r.between(a, b)).alias(n) for n, (a, b) in bands.items()],
        )
    )


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Ranks assigned anew: 1-based, by score descending, ties by passage id."""
    w = Window.partitionBy("record_id").orderBy(F.desc("score"), "passage_id")
    return R.ranked(spark, d).select("record_id", "passage_id", F.round("score", 6).alias("score")).withColumn("new_rank", F.row_number().over(w).cast("bigint"))


def top_context(spark: SparkSession, d: str, depth: int = 5) -> DataFrame:
    """The first passages of each record by rank, joined as one ordered list of ids."""
    r = R.records(spark, d, "retrieved")
    by_rank = F.array_sort("retrieved", lambda a, b: F.when(a["rank_no"] < b["rank_no"], -1).when(a["rank_no"] > b["rank_no"], 1).otherwise(0))
    return r.select("record_id", F.array_join(F.transform(F.slice(by_rank, 1, depth), lambda p: p["passage_id"]), "|").alias("context_ids"))


def context_texts(spark: SparkSession, d: str, depth: int = 3) -> DataFrame:
    """Wanted (record, passage) pairs of the context with their text; a missing text is reported, not dropped."""
    want = R.ranked(spark, d).where(F.col("rank_no") <= depth).select("record_id", "rank_no", "passage_id")
    return want.join(R.passages(spark, d).select("passage_id", F.char_length("text").cast("bigint").alias("n_chars")), "passage_id", "left").select("record_id", F.col("rank_no").cast("bigint").alias("rank_no"), "passage_id", "n_chars", F.col("n_chars").isNull().alias("missing"))


def pruned(spark: SparkSession, d: str, keep: int = 5) -> DataFrame:
    """Lists with the scores of ranks beyond ``keep`` set to null, ids kept; as counts per record."""
    r = R.records(spark, d, "retrieved").where("retrieved is not null")
    cut = F.transform("retrieved", lambda p: F.struct(p["passage_id"].alias("passage_id"), p["rank_no"].alias("rank_no"), F.when(p["rank_no"] <= keep, p["score"]).alias("score")))
    x = r.select("record_id", cut.alias("l"))
    return x.select("record_id", F.size("l").cast("bigint").alias("n_ids"), F.size(F.filter("l", lambda p: p["score"].isNotNull())).cast("bigint").alias("n_kept"))


def arm_compare(spark: SparkSession, d: str) -> DataFrame:
    """Gold ranks of two systems on shared runs and queries: better, worse, unchanged; a miss ranks last."""
    g = gold_rank(spark, d).join(R.records(spark, d, "run_id", "seed"), "record_id").groupBy("run_id", "query_id", "seed", "system_name").agg(F.min("gold_rank").alias("g"))
    a = g.where("system_name = 'joint'").select("run_id", "query_id", "seed", F.coalesce("g", F.lit(10**9)).alias("a"))
    b = g.where("system_name = 'post_hoc'").select("run_id", "query_id", "seed", F.coalesce("g", F.lit(10**9)).alias("b"))
    x = a.join(b, ["run_id", "query_id", "seed"])
    return x.agg(F.count(F.lit(1)).alias("n_shared"), F.count_if(F.col("b") < F.col("a")).alias("better"), F.count_if(F.col("b") > F.col("a")).alias("worse"), F.count_if(F.col("b") == F.col("a")).alias("unchanged"))


QUERIES = {
    "jn5_gold_found": lambda s, d: gold_found(s, d).select("record_id", "passage_id", F.col("rank_no").cast("bigint").alias("rank_no")),
    "win1_rerank": reranked,
    "win2_gold_rank": lambda s, d: gold_rank(s, d).select("record_id", "n_gold", F.col("gold_rank").cast("bigint").alias("gold_rank")),
    "sc1_hit_curve": lambda s, d: hit_curve(gold_rank(s, d), "system_name"),
    "sc2_recall": recall_at,
    "sc3_mrr": mrr,
    "sc4_ndcg": ndcg,
    "sc5_gate": gate,
    "sc27_pack": pack,
    "agg14_gold_rank_stats": rank_stats,
    "top11_context": top_context,
    "src18_context_texts": context_texts,
    "prj11_prune": pruned,
    "rt15_arm_compare": arm_compare,
}

_R = "WITH r AS (SELECT DISTINCT ON (record_id) * FROM query_records), k AS (SELECT record_id, unnest(retrieved, recursive := true) FROM r WHERE retrieved IS NOT NULL), g AS (SELECT DISTINCT record_id, unnest(gold_passage_ids) AS passage_id FROM r), f AS (SELECT k.* FROM k SEMI JOIN g ON k.record_id = g.record_id AND k.passage_id = g.passage_id), gr AS (SELECT r.record_id, r.system_name, r.query_id, r.run_id, r.seed, coalesce(len(list_distinct(r.gold_passage_ids)), 0)::BIGINT AS n_gold, min(f.rank_no)::BIGINT AS gold_rank FROM r LEFT JOIN f USING (record_id) GROUP BY ALL)"
_CURVE = "SELECT system_name, k, count(*) FILTER (gold_rank <= k) AS hits, count(*) AS n FROM gr, (SELECT unnest([{ks}])::INT AS k) GROUP BY 1, 2"
_Z = "1.959964"
_W = f"greatest(0, (hits / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt((hits / n) * (1 - hits / n) / n + {_Z} * {_Z} / (4.0 * n * n)) / (1 + {_Z} * {_Z} / n)) AS lower, least(1, (hits / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) + {_Z} * sqrt((hits / n) * (1 - hits / n) / n + {_Z} * {_Z} / (4.0 * n * n)) / (1 + {_Z} * {_Z} / n)) AS upper"


def _curve(ks: str) -> str:
    return f"SELECT system_name, k, hits, n, round(hits / n, 6) AS hit_rate, round(lower, 6) AS lower, round(upper, 6) AS upper FROM (SELECT *, {_W} FROM ({_CURVE.format(ks=ks)}))"


_RECALL = "SELECT system_name, count(*) AS n, " + ", ".join(f"round(avg(coalesce(f{k}, 0) / n_gold), 6) AS recall_at_{k}" for k in KS) + " FROM gr LEFT JOIN (SELECT record_id, " + ", ".join(f"count(DISTINCT passage_id) FILTER (rank_no <= {k}) AS f{k}" for k in KS) + " FROM f GROUP BY 1) USING (record_id) WHERE n_gold > 0 GROUP BY 1"
_MRR = "SELECT system_name, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / gold_rank, 0)), 6) AS mrr FROM gr WHERE n_gold > 0 GROUP BY 1"
_NDCG = "SELECT system_name, count(*) AS n, round(avg(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1.0)))), 6) AS ndcg_at_10 FROM gr LEFT JOIN (SELECT record_id, sum(1 / log2(rank_no + 1.0)) AS dcg FROM f WHERE rank_no <= 10 GROUP BY 1) USING (record_id) WHERE n_gold > 0 GROUP BY 1"

SQL = {
    "jn5_gold_found": _R + "SELECT record_id, passage_id, rank_no::BIGINT AS rank_no FROM f",
    "win1_rerank": _R + "SELECT record_id, passage_id, round(score, 6) AS score, row_number() OVER (PARTITION BY record_id ORDER BY round(score, 6) DESC, passage_id) AS new_rank FROM k",
    "win2_gold_rank": _R + "SELECT record_id, n_gold, gold_rank FROM gr",
    "sc1_hit_curve": _R + _curve("1, 5, 10"),
    "sc2_recall": _R + _RECALL,
    "sc3_mrr": _R + _MRR,
    "sc4_ndcg": _R + _NDCG,
    "sc5_gate": _R + f"SELECT *, hit_rate >= 0.9 AND lower > 0.85 AS passes FROM ({_curve('10')})",
    "sc27_pack": _R + f"SELECT system_name, max(hit_rate) FILTER (k = 5) AS hit_at_5, max(hit_rate) FILTER (k = 10) AS hit_at_10, any_value(recall_at_5) AS recall_at_5, any_value(mrr) AS mrr, any_value(ndcg_at_10) AS ndcg_at_10 FROM ({_curve('5, 10')}) JOIN ({_RECALL}) a USING (system_name) JOIN ({_MRR}) b USING (system_name) JOIN ({_NDCG}) c USING (system_name) GROUP BY 1",
    "agg14_gold_rank_stats": _R + "SELECT system_name, count(gold_rank) AS in_pool, count(*) FILTER (gold_rank IS NULL) AS not_in_pool, round(avg(gold_rank), 6) AS mean_rank, round(median(gold_rank), 6) AS median_rank, min(gold_rank) AS min_rank, max(gold_rank) AS max_rank, count(*) FILTER (gold_rank = 1) AS rank_1, count(*) FILTER (gold_rank BETWEEN 2 AND 5) AS rank_2_5, count(*) FILTER (gold_rank BETWEEN 6 AND 10) AS rank_6_10, count(*) FILTER (gold_rank BETWEEN 11 AND 20) AS rank_11_20, count(*) FILTER (gold_rank BETWEEN 21 AND 50) AS rank_21_50, count(*) FILTER (gold_rank BETWEEN 51 AND 100) AS rank_51_100 FROM gr GROUP BY 1",
    "top11_context": _R + "SELECT r.record_id, CASE WHEN r.retrieved IS NULL THEN NULL ELSE coalesce(x.ids, '') END AS context_ids FROM r LEFT JOIN (SELECT record_id, string_agg(passage_id, '|' ORDER BY rank_no) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY rank_no) AS n FROM k) WHERE n <= 5 GROUP BY 1) x USING (record_id)",
    "src18_context_texts": _R + ", p AS (SELECT passage_id, arg_min(length(text), chunk_id) AS n_chars FROM chunks WHERE passage_id IS NOT NULL AND text IS NOT NULL GROUP BY 1) SELECT record_id, rank_no::BIGINT AS rank_no, passage_id, n_chars, n_chars IS NULL AS missing FROM k LEFT JOIN p USING (passage_id) WHERE rank_no <= 3",
    "prj11_prune": _R + "SELECT record_id, len(retrieved) AS n_ids, len(list_filter(retrieved, lambda p: p.rank_no <= 5 AND p.score IS NOT NULL)) AS n_kept FROM r WHERE retrieved IS NOT NULL",
    "rt15_arm_compare": _R + ", m AS (SELECT run_id, query_id, seed, coalesce(min(gold_rank) FILTER (system_name = 'joint'), 1000000000) AS a, coalesce(min(gold_rank) FILTER (system_name = 'post_hoc'), 1000000000) AS b FROM gr GROUP BY 1, 2, 3 HAVING count(*) FILTER (system_name = 'joint') > 0 AND count(*) FILTER (system_name = 'post_hoc') > 0) SELECT count(*) AS n_shared, count(*) FILTER (b < a) AS better, count(*) FILTER (b > a) AS worse, count(*) FILTER (a = b) AS unchanged FROM m",
}
