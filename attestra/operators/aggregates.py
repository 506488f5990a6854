"""Costs, accuracy, run summaries, percentile conventions and distribution tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.select import at_rank
from ..functions.stats import r6, strict_sum, wilson
from ..sources import records as R
from ..sources.tables import once, table

# The decisions.
DECISIONS = ("yes", "no", "maybe")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Verifier scores, redelivered rows once, without null and NaN scores."""
    return once(table(spark, d, "verifier_scores").select("score_id", "claim_key", "query_id", "verifier_name", "score", "latency_s"), "score_id").where("score is not null and not isnan(score)")


def linear_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of scores per verifier by linear interpolation."""
    return scores(spark, d).groupBy("verifier_name").agg(F.count(F.lit(1)).alias("n"), *[r6(F.percentile("score", F.lit(q / 100)), f"p{q}") for q in (10, 25, 50, 75, 90)])


def nearest_rank(spark: SparkSession, d: str, q: float = 0.9) -> DataFrame:
    """The other convention: the value at position floor(n * q), counted from 0."""
    x = at_rank(scores(spark, d), "verifier_name", "score", F.least(F.floor(F.col("n") * q) + 1, F.col("n")))
    return x.select("verifier_name", r6(F.col("score"), "p90_nearest"))


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    """The upper median: the value at position n // 2, counted from 0."""
    return at_rank(scores(spark, d), "verifier_name", "score", F.floor(F.col("n") / 2) + 1).select("verifier_name", r6(F.col("score"), "upper_median"))


def describe(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, median, p90, extremes, and the share of scores at or above each threshold."""
    at = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
    return scores(spark, d).groupBy("verifier_name").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("score"), "mean"), r6(F.median("score"), "median"), r6(F.percentile("score", F.lit(0.9)), "p90"), r6(F.max("score"), "max"), r6(F.min("score"), "min"), *[r6(F.avg((F.col("score") >= t).cast("double")), f"at_{int(t * 10)}") for t in at]
    )


def cost_rows(spark: SparkSession, d: str) -> DataFrame:
    """Calls as cost rows: the events stand for calls of components, with tokens missing where the call was rejected."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return e.select("event_id", "ts", F.col("user_id").alias("query_id"), F.col("event_type").alias("component"), F.when(F.col("k") % 7 != 0, F.col("k")).alias("tokens"), F.round("value", 4).alias("wall_s"))


def per_query_cost(spark: SparkSession, d: str) -> DataFrame:
    """Per component: totals per query, null where any call lacks a figure; then mean, median, extremes and counts of these.

    A row without a query is a query of its own; one without a component belongs to ``overall``.
    """
    c = cost_rows(spark, d).select(F.coalesce("component", F.lit("overall")).alias("component"), F.coalesce(F.col("query_id").cast("string"), F.concat(F.lit("row-"), F.col("event_id").cast("string"))).alias("q"), "tokens", "wall_s")
    q = c.groupBy("component", "q").agg(strict_sum(F.col("tokens")).alias("tokens"), strict_sum(F.col("wall_s")).alias("wall_s"))
    t = F.col("tokens")
    return q.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_queries"), F.count(t).alias("n_valid"), F.count_if(t.isNull()).alias("n_missing"), r6(F.avg(t), "mean_tokens"), r6(F.median(t), "median_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), F.sum(t).alias("total_tokens"), F.round(F.avg("wall_s"), 4).alias("mean_wall_s")
    )


def overhead_ratio(spark: SparkSession, d: str, ours: str = "click", judge: str = "purchase") -> DataFrame:
    """Mean cost of one component over that of another; null if either is unknown, infinite (flagged) over zero."""
    p = per_query_cost(spark, d)
    pick = lambda c, m: F.max(F.when(F.col("component") == c, F.col(m)))
    x = p.agg(pick(judge, "mean_tokens").alias("j"), pick(ours, "mean_tokens").alias("o"), pick(judge, "mean_wall_s").alias("jw"), pick(ours, "mean_wall_s").alias("ow"))
    ratio = lambda j, o: F.round(F.col(j) / F.nullif(F.col(o), F.lit(0.0)), 4)
    return x.select(ratio("j", "o").alias("token_ratio"), ratio("jw", "ow").alias("wall_ratio"), ((F.col("o") == 0) & (F.col("j") > 0)).alias("infinite"))


def _decision(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin(*DECISIONS), x)


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of right decisions per system among records with a known gold decision and a readable own one, with the Wilson interval."""
    r = R.records(spark, d, "system_name", "final_decision", "gold_final_decision").select("system_name", _decision(F.col("final_decision")).alias("p"), _decision(F.col("gold_final_decision")).alias("g")).where("g is not null")
    a = r.groupBy("system_name").agg(F.count(F.lit(1)).alias("n_gold"), F.count("p").alias("n_eval"), F.count_if(F.col("p").isNull()).alias("n_unparsed"), F.count_if(F.col("p") == F.col("g")).alias("n_right"))
    lo, hi = wilson(F.col("n_right"), F.col("n_eval"))
    return a.select("system_name", "n_gold", "n_eval", "n_unparsed", "n_right", r6(F.col("n_right") / F.nullif(F.col("n_eval"), F.lit(0)), "accuracy"), r6(lo, "lower"), r6(hi, "upper"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    """Gold by own decision, all nine cells; an unreadable own decision stands under maybe."""
    r = R.records(spark, d, "final_decision", "gold_final_decision").select(_decision(F.col("gold_final_decision")).alias("gold"), F.coalesce(_decision(F.col("final_decision")), F.lit("maybe")).alias("p")).where("gold is not null")
    n = r.groupBy("gold", "p").agg(F.count(F.lit(1)).alias("n"))
    cells = spark.createDataFrame([(g, p) for g in DECISIONS for p in DECISIONS], "gold string, p string")
    return cells.join(n, ["gold", "p"], "left").select("gold", F.col("p").alias("predicted"), F.coalesce("n", F.lit(0)).alias("n"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per system: records, clean parses, failed replies, claims, total tokens, longest and median latency over known ones."""
    r = R.records(spark, d, "system_name", "raw_generation", "latency_s", "completion_tokens")
    e = table(spark, d, "decompositions").groupBy("record_id").agg(F.max(F.coalesce(F.size("errors"), F.lit(0))).alias("n_errors"))
    c = R.claims(spark, d, "record_id").groupBy("record_id").agg(F.count(F.lit(1)).alias("n_claims"))
    x = r.join(e, "record_id", "left").join(c, "record_id", "left")
    ok = F.col("latency_s").isNotNull() & ~F.isnan("latency_s")
    return x.groupBy("system_name").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("n_errors") == 0).alias("n_clean"), F.count_if(F.coalesce(F.trim("raw_generation"), F.lit("")) == "").alias("n_failed"), r6(F.avg(F.coalesce("n_claims", F.lit(0))), "mean_claims"), F.sum("completion_tokens").alias("known_tokens"), r6(F.max(F.when(ok, F.col("latency_s"))), "max_latency_s"), r6(F.median(F.when(ok, F.col("latency_s"))), "median_latency_s")
    )


def three_way(spark: SparkSession, d: str) -> DataFrame:
    """Runs side by side: clean share, claims per query, share of uncited claims, citations."""
    r = R.records(spark, d, "run_id", "query_id")
    e = table(spark, d, "decompositions").groupBy("record_id").agg((F.max(F.coalesce(F.size("errors"), F.lit(0))) == 0).alias("clean"))
    rec = r.join(e, "record_id", "left").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("query_id").alias("n_queries"), F.count_if("clean").alias("n_clean"))
    c = R.claims(spark, d, "record_id", "citations").join(r, "record_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.coalesce(F.size("citations"), F.lit(0)) <= 0).alias("n_uncited"), F.sum(F.greatest(F.coalesce(F.size("citations"), F.lit(0)), F.lit(0))).alias("n_citations"))
    return rec.join(c, "run_id", "left").select("run_id", "n_records", "n_queries", "n_clean", "n_claims", "n_citations", r6(F.col("n_clean") / F.col("n_records"), "clean_share"), r6(F.col("n_claims") / F.col("n_queries"), "claims_per_query"), r6(F.col("n_uncited") / F.col("n_claims"), "uncited_share"))


def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Parse errors by kind: quoted strings, brackets and numbers replaced, then counted."""
    e = table(spark, d, "decompositions").select(F.explode("errors").alias("m"))
    k = F.regexp_replace(F.regexp_replace(F.regexp_replace("m", "'[^']*'|\"[^\"]*\"", "Q"), r"\[[^\]]*\]", "[]"), r"\d+", "N")
    return e.groupBy(k.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def prompt_sizes(spark: SparkSession, d: str, window: int = 1500, reserve: int = 200) -> DataFrame:
    """Sizes of contexts: least, floored mean and largest characters and tokens per system, and how many exceed the window."""
    t = R.passages(spark, d).select("passage_id", F.char_length("text").alias("c"), F.size(F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0))).alias("w"))
    x = R.ranked(spark, d, "system_name").join(t, "passage_id").groupBy("record_id", "system_name").agg(F.sum("c").alias("chars"), F.sum("w").alias("words"))
    x = x.withColumn("tokens", F.greatest(F.col("words"), F.floor(F.col("chars") / 4)))
    return x.groupBy("system_name").agg(F.min("chars").alias("min_chars"), F.floor(F.sum("chars") / F.count(F.lit(1))).alias("mean_chars"), F.max("chars").alias("max_chars"), F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"), F.count_if(F.col("tokens") + reserve > window).alias("over_window"))


def stage_labels(spark: SparkSession, d: str) -> DataFrame:
    """Calls of a query named by their place: first joint, second answer, last vanilla, the rest cite; queries of fewer than four calls have none."""
    w = Window.partitionBy("query_id")
    x = cost_rows(spark, d).select("query_id", "event_id", "tokens", F.row_number().over(w.orderBy("ts", "event_id")).alias("i"), F.count(F.lit(1)).over(w).alias("n")).where("n >= 4")
    stage = F.when(F.col("i") == 1, "joint").when(F.col("i") == 2, "post_hoc_answer").when(F.col("i") == F.col("n"), "vanilla").otherwise("post_hoc_cite")
    return x.select("query_id", "event_id", stage.alias("stage"))


def truncated_queries(spark: SparkSession, d: str, cap: int = 95) -> DataFrame:
    """Per system the queries of which a call that feeds it reached the token cap."""
    x = stage_labels(spark, d).join(cost_rows(spark, d).select("event_id", "tokens"), "event_id").where(F.col("tokens") >= cap)
    system = F.when(F.col("stage").startswith("post_hoc"), "post_hoc").otherwise(F.col("stage"))
    return x.select(system.alias("system_name"), "query_id").distinct()


def stage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per query and stage in columns, null where a call lacks its figure."""
    x = stage_labels(spark, d).join(cost_rows(spark, d).select("event_id", "tokens"), "event_id")
    q = x.groupBy("query_id", "stage").agg(strict_sum(F.col("tokens")).alias("t"))
    return q.groupBy("query_id").agg(*[F.max(F.when(F.col("stage") == s, F.col("t"))).alias(s) for s in ("joint", "post_hoc_answer", "post_hoc_cite", "vanilla")])


def batch_sizes(spark: SparkSession, d: str, batch: int = 5) -> DataFrame:
    """Claims of a record in batches: how many each call carries."""
    c = R.claims(spark, d, "record_id").groupBy("record_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    b = c.select("record_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / batch).cast("int"))).alias("batch_no"))
    return b.groupBy(F.least(F.lit(batch), F.col("n") - F.col("batch_no") * batch).cast("bigint").alias("batch_size")).agg(F.count(F.lit(1)).alias("n"))


def distinct_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct ids, runs, queries and versions, as a manifest states them."""
    r = table(spark, d, "query_records")
    return r.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("record_id").alias("n_records"), F.count_distinct("run_id").alias("n_runs"), F.count_distinct("query_id").alias("n_queries"), F.count_distinct("schema_version").alias("n_versions"))


QUERIES = {
    "agg2_percentiles": linear_percentiles,
    "agg3_nearest_rank": nearest_rank,
    "agg4_upper_median": upper_median,
    "agg5_describe": describe,
    "agg6_per_query_cost": per_query_cost,
    "agg7_overhead_ratio": overhead_ratio,
    "agg8_accuracy": accuracy,
    "agg8_confusion": confusion,
    "agg15_run_summary": run_summary,
    "agg16_three_way": three_way,
    "agg17_batch_sizes": batch_sizes,
    "agg18_audit": distinct_audit,
    "agg21_prompt_sizes": prompt_sizes,
    "prj18_error_kinds": error_kinds,
    "win6_stage_labels": stage_labels,
    "win9_truncated_queries": truncated_queries,
    "jn8_stage_totals": stage_totals,
}

_V = "WITH v AS (SELECT DISTINCT ON (score_id) * FROM verifier_scores), s AS (SELECT * FROM v WHERE score IS NOT NULL AND NOT isnan(score))"
_R = "WITH r AS (SELECT DISTINCT ON (record_id) * FROM query_records), c AS (SELECT DISTINCT ON (claim_key) * FROM claims)"
_E = "WITH e AS (SELECT event_id, ts, user_id AS query_id, event_type AS component, CASE WHEN k % 7 <> 0 THEN k END AS tokens, round(value, 4) AS wall_s FROM (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events))"
_Q = _E + ", q AS (SELECT coalesce(component, 'overall') AS component, coalesce(query_id::VARCHAR, 'row-' || event_id) AS q, CASE WHEN count(*) = count(tokens) THEN sum(tokens) END AS tokens, CASE WHEN count(*) = count(wall_s) THEN sum(wall_s) END AS wall_s FROM e GROUP BY 1, 2), p AS (SELECT component, count(*) AS n_queries, count(tokens) AS n_valid, count(*) FILTER (tokens IS NULL) AS n_missing, round(avg(tokens), 6) AS mean_tokens, round(median(tokens), 6) AS median_tokens, min(tokens)::BIGINT AS min_tokens, max(tokens)::BIGINT AS max_tokens, sum(tokens)::BIGINT AS total_tokens, round(avg(wall_s), 4) AS mean_wall_s FROM q GROUP BY 1)"
_ST = _E + ", n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY query_id) AS n FROM e), st AS (SELECT query_id, event_id, tokens, CASE WHEN i = 1 THEN 'joint' WHEN i = 2 THEN 'post_hoc_answer' WHEN i = n THEN 'vanilla' ELSE 'post_hoc_cite' END AS stage FROM n WHERE n >= 4)"
_D = "CASE WHEN lower(trim({0})) IN ('yes', 'no', 'maybe') THEN lower(trim({0})) END"
_Z = "1.959964"
_WIL = f"greatest(0, (x / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) - {_Z} * sqrt((x / n) * (1 - x / n) / n + {_Z} * {_Z} / (4.0 * n * n)) / (1 + {_Z} * {_Z} / n))"

SQL = {
    "agg2_percentiles": _V + "SELECT verifier_name, count(*) AS n, " + ", ".join(f"round(quantile_cont(score, {q / 100}), 6) AS p{q}" for q in (10, 25, 50, 75, 90)) + " FROM s GROUP BY 1",
    "agg3_nearest_rank": _V + "SELECT verifier_name, round(list_sort(list(score))[least(floor(count(*) * 0.9)::BIGINT + 1, count(*))], 6) AS p90_nearest FROM s GROUP BY 1",
    "agg4_upper_median": _V + "SELECT verifier_name, round(list_sort(list(score))[count(*) // 2 + 1], 6) AS upper_median FROM s GROUP BY 1",
    "agg5_describe": _V + "SELECT verifier_name, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(quantile_cont(score, 0.9), 6) AS p90, round(max(score), 6) AS max, round(min(score), 6) AS min, " + ", ".join(f"round(avg((score >= {t / 10})::INT), 6) AS at_{t}" for t in range(3, 9)) + " FROM s GROUP BY 1",
    "agg6_per_query_cost": _Q + "SELECT * FROM p",
    "agg7_overhead_ratio": _Q + "SELECT round(j / nullif(o, 0), 4) AS token_ratio, round(jw / nullif(ow, 0), 4) AS wall_ratio, o = 0 AND j > 0 AS infinite FROM (SELECT max(mean_tokens) FILTER (component = 'purchase') AS j, max(mean_tokens) FILTER (component = 'click') AS o, max(mean_wall_s) FILTER (component = 'purchase') AS jw, max(mean_wall_s) FILTER (component = 'click') AS ow FROM p)",
    "agg8_accuracy": _R + f", a AS (SELECT system_name, {_D.format('final_decision')} AS p, {_D.format('gold_final_decision')} AS g FROM r), b AS (SELECT system_name, count(*) AS n_gold, count(p) AS n_eval, count(*) FILTER (p IS NULL) AS n_unparsed, count(*) FILTER (p = g) AS n_right FROM a WHERE g IS NOT NULL GROUP BY 1), w AS (SELECT *, n_right AS x, n_eval AS n FROM b) SELECT system_name, n_gold, n_eval, n_unparsed, n_right, round(x / n, 6) AS accuracy, round({_WIL}, 6) AS lower, round({_WIL.replace('greatest(0', 'least(1').replace(') - ' + _Z, ') + ' + _Z)}, 6) AS upper FROM w",
    "agg8_confusion": _R + f", a AS (SELECT {_D.format('gold_final_decision')} AS gold, coalesce({_D.format('final_decision')}, 'maybe') AS predicted FROM r) SELECT gold, predicted, count(a.gold) AS n FROM (SELECT unnest(['yes', 'no', 'maybe']) AS gold) CROSS JOIN (SELECT unnest(['yes', 'no', 'maybe']) AS predicted) LEFT JOIN a USING (gold, predicted) GROUP BY 1, 2",
    "agg15_run_summary": _R + ", e AS (SELECT record_id, max(coalesce(len(errors), 0)) AS ne FROM decompositions GROUP BY 1), k AS (SELECT record_id, count(*) AS nc FROM c GROUP BY 1) SELECT system_name, count(*) AS n_records, count(*) FILTER (ne = 0) AS n_clean, count(*) FILTER (coalesce(trim(raw_generation), '') = '') AS n_failed, round(avg(coalesce(nc, 0)), 6) AS mean_claims, sum(completion_tokens)::BIGINT AS known_tokens, round(max(latency_s) FILTER (NOT isnan(latency_s)), 6) AS max_latency_s, round(median(latency_s) FILTER (NOT isnan(latency_s)), 6) AS median_latency_s FROM r LEFT JOIN e USING (record_id) LEFT JOIN k USING (record_id) GROUP BY 1",
    "agg16_three_way": _R + ", e AS (SELECT record_id, max(coalesce(len(errors), 0)) = 0 AS clean FROM decompositions GROUP BY 1), a AS (SELECT run_id, count(*) AS n_records, count(DISTINCT query_id) AS n_queries, count(*) FILTER (clean) AS n_clean FROM r LEFT JOIN e USING (record_id) GROUP BY 1), b AS (SELECT run_id, count(*) AS n_claims, count(*) FILTER (coalesce(len(citations), 0) = 0) AS n_uncited, sum(coalesce(len(citations), 0))::BIGINT AS n_citations FROM c JOIN r USING (record_id) GROUP BY 1) SELECT run_id, n_records, n_queries, n_clean, n_claims, n_citations, round(n_clean / n_records, 6) AS clean_share, round(n_claims / n_queries, 6) AS claims_per_query, round(n_uncited / n_claims, 6) AS uncited_share FROM a LEFT JOIN b USING (run_id)",
    "agg17_batch_sizes": _R + ", k AS (SELECT record_id, count(*) AS n FROM c GROUP BY 1) SELECT least(5, n - 5 * b) AS batch_size, count(*) AS n FROM (SELECT n, unnest(range(0, (n - 1) // 5 + 1)) AS b FROM k) GROUP BY 1",
    "agg18_audit": "SELECT count(*) AS n_rows, count(DISTINCT record_id) AS n_records, count(DISTINCT run_id) AS n_runs, count(DISTINCT query_id) AS n_queries, count(DISTINCT schema_version) AS n_versions FROM query_records",
    "agg21_prompt_sizes": _R + r", p AS (SELECT passage_id, arg_min(text, chunk_id) AS text FROM chunks WHERE passage_id IS NOT NULL AND text IS NOT NULL GROUP BY 1), k AS (SELECT record_id, system_name, unnest(retrieved).passage_id AS passage_id FROM r), x AS (SELECT record_id, system_name, sum(length(text)) AS chars, sum(len(regexp_extract_all(text, '[^\s\p{Z}\x{1c}-\x{1f}\x{85}]+'))) AS words FROM k JOIN p USING (passage_id) GROUP BY 1, 2), y AS (SELECT *, greatest(words, chars // 4) AS tokens FROM x) SELECT system_name, min(chars)::BIGINT AS min_chars, (sum(chars) // count(*))::BIGINT AS mean_chars, max(chars)::BIGINT AS max_chars, min(tokens)::BIGINT AS min_tokens, max(tokens)::BIGINT AS max_tokens, count(*) FILTER (tokens + 200 > 1500) AS over_window FROM y GROUP BY 1",
    "prj18_error_kinds": r"""SELECT regexp_replace(regexp_replace(regexp_replace(m, '''[^'']*''|"[^"]*"', 'Q', 'g'), '\[[^\]]*\]', '[]', 'g'), '\d+', 'N', 'g') AS kind, count(*) AS n FROM (SELECT unnest(errors) AS m FROM decompositions) GROUP BY 1""",
    "win6_stage_labels": _ST + "SELECT query_id, event_id, stage FROM st",
    "win9_truncated_queries": _ST + "SELECT DISTINCT CASE WHEN stage LIKE 'post_hoc%' THEN 'post_hoc' ELSE stage END AS system_name, query_id FROM st WHERE tokens >= 95",
    "jn8_stage_totals": _ST + ", q AS (SELECT query_id, stage, CASE WHEN count(*) = count(tokens) THEN sum(tokens)::BIGINT END AS t FROM st GROUP BY 1, 2) SELECT query_id, max(t) FILTER (stage = 'joint') AS joint, max(t) FILTER (stage = 'post_hoc_answer') AS post_hoc_answer, max(t) FILTER (stage = 'post_hoc_cite') AS post_hoc_cite, max(t) FILTER (stage = 'vanilla') AS vanilla FROM q GROUP BY 1",
}
