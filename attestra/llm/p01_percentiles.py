"""Problem 1: medians and high percentiles per system and run, and per verifier and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import spool
from ..sources.tables import once, table
from . import quantiles as Q

#: A recorded figure is wrong when it is off by more than this.
TOLERANCE = 1.0


def words_per_claim(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, system_name, words) of every claim with a text, redelivered rows counted once."""
    claims = table(spark, d, "claims").where(F.col("text").isNotNull())
    claims = claims.select("claim_key", "record_id", F.size(F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0))).alias("words"))
    records = once(table(spark, d, "query_records").select("record_id", "run_id", "system_name"), "record_id")
    return once(claims, "claim_key").join(records, "record_id").select("run_id", "system_name", "words")


def found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of arm_granularity whose median or 90th percentile is off by more than TOLERANCE.

    The sketch bounds decide; only groups whose bounds leave the answer open
    (more than K claims and a figure near the edge) are computed exactly. A
    null figure differs from nothing. Runs without claims are not listed.
    """
    keys = ["run_id", "system_name"]
    words = spool(words_per_claim(spark, d), "words")
    q = Q.percentiles(Q.sketches(words, keys, "words"), keys, {"p50": 0.5, "p90": 0.9})
    arms = table(spark, d, "arm_granularity").select(*keys, "median_words_per_claim", "p90_words_per_claim")
    both = arms.join(q, keys)

    def off(rec: str, p: str):
        r, t = F.col(rec), F.lit(TOLERANCE + 1e-9)
        sure = (r < F.col(f"{p}_lo") - t) | (r > F.col(f"{p}_hi") + t)
        never = r.isNull() | F.isnan(r) | ((F.abs(r - F.col(f"{p}_lo")) <= t) & (F.abs(r - F.col(f"{p}_hi")) <= t))
        return F.when(never, F.lit(0)).when(sure, F.lit(2)).otherwise(F.lit(1))

    state = F.greatest(off("median_words_per_claim", "p50"), off("p90_words_per_claim", "p90"))
    # greatest of the two is 1 only if neither is sure and one is open
    both = spool(both.withColumn("state", state), "bounds")
    sure = both.where("state = 2").select(*keys)
    open_ = both.where("state = 1").select(*keys, "median_words_per_claim", "p90_words_per_claim")
    exact = (
        words.join(open_.select(*keys).distinct(), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.percentile("words", F.lit(0.5)).alias("x50"), F.percentile("words", F.lit(0.9)).alias("x90"))
    )
    t = TOLERANCE + 1e-9
    late = open_.join(exact, keys).where((F.abs(F.col("median_words_per_claim") - F.col("x50")) > t) | (F.abs(F.col("p90_words_per_claim") - F.col("x90")) > t))
    return sure.unionByName(late.select(*keys)).distinct()


def arm_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Words per claim by run and system, with the bounds that hold for each figure."""
    keys = ["run_id", "system_name"]
    q = Q.percentiles(Q.sketches(words_per_claim(spark, d), keys, "words"), keys, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    return q.select(*keys, F.col("n").alias("n_claims"), *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75", "p90")], *[F.round(c, 6).alias(c) for c in ("p50_lo", "p50_hi", "p90_lo", "p90_hi")], (F.col("rank_err") / F.col("n")).alias("rank_err_share"))


def _latencies(spark: SparkSession, d: str) -> DataFrame:
    """Usable latencies: a null, NaN, zero or negative one is no measurement."""
    v = once(table(spark, d, "verifier_scores").select("score_id", "verifier_name", "latency_s", "scored_at"), "score_id")
    return v.where((F.col("latency_s") > 0) & ~F.isnan("latency_s")).select("verifier_name", F.to_date("scored_at").alias("day"), "latency_s")


def latency_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Latency percentiles per verifier and day of scoring; rows without a time form a group of day null."""
    keys = ["verifier_name", "day"]
    q = Q.percentiles(Q.sketches(_latencies(spark, d), keys, "latency_s"), keys, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return q.select(*keys, "n", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")], F.round("p50_lo", 6).alias("p50_lo"), F.round("p50_hi", 6).alias("p50_hi"), F.round("p99_lo", 6).alias("p99_lo"), F.round("p99_hi", 6).alias("p99_hi"))


def latency_combined(spark: SparkSession, d: str) -> DataFrame:
    """The daily sketches of a verifier merged over all its days: no value is read again."""
    daily = Q.sketches(_latencies(spark, d), ["verifier_name", "day"], "latency_s")
    q = Q.percentiles(Q.merge_sketches(daily, ["verifier_name"]), ["verifier_name"], {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return q.withColumn("rank_err_share", F.col("rank_err") / F.col("n"))


QUERIES = {"p1_found": found, "p1_arm_percentiles": arm_percentiles, "p1_latency_by_day": latency_by_day, "p1_latency_combined": latency_combined}

_WORDS = r"""
WITH r AS (SELECT DISTINCT record_id, run_id, system_name FROM query_records),
c AS (SELECT DISTINCT claim_key, record_id, len(regexp_extract_all(text, '[^\s\p{Z}\x{1c}-\x{1f}\x{85}]+')) AS words FROM claims WHERE text IS NOT NULL),
w AS (SELECT run_id, system_name, words FROM c JOIN r USING (record_id))
"""

SQL = {
    "p1_found": _WORDS
    + """, q AS (SELECT run_id, system_name, quantile_cont(words, 0.5) AS p50, quantile_cont(words, 0.9) AS p90 FROM w GROUP BY 1, 2)
SELECT DISTINCT run_id, system_name FROM arm_granularity JOIN q USING (run_id, system_name)
WHERE abs(median_words_per_claim - p50) > 1.000000001 OR abs(p90_words_per_claim - p90) > 1.000000001""",
    "p1_arm_percentiles": _WORDS
    + """SELECT run_id, system_name, count(*) AS n_claims, round(quantile_cont(words, 0.25), 6) AS p25, round(quantile_cont(words, 0.5), 6) AS p50,
round(quantile_cont(words, 0.75), 6) AS p75, round(quantile_cont(words, 0.9), 6) AS p90, round(quantile_cont(words, 0.5), 6) AS p50_lo, round(quantile_cont(words, 0.5), 6) AS p50_hi,
round(quantile_cont(words, 0.9), 6) AS p90_lo, round(quantile_cont(words, 0.9), 6) AS p90_hi, 0.0::DOUBLE AS rank_err_share FROM w GROUP BY 1, 2""",
    "p1_latency_by_day": """
WITH v AS (SELECT DISTINCT score_id, verifier_name, latency_s, scored_at FROM verifier_scores),
q AS (SELECT verifier_name, (scored_at AT TIME ZONE 'UTC')::DATE AS day, count(*) AS n, round(quantile_cont(latency_s, 0.5), 6) AS p50,
 round(quantile_cont(latency_s, 0.9), 6) AS p90, round(quantile_cont(latency_s, 0.99), 6) AS p99 FROM v WHERE latency_s > 0 AND NOT isnan(latency_s) GROUP BY 1, 2)
SELECT *, p50 AS p50_lo, p50 AS p50_hi, p99 AS p99_lo, p99 AS p99_hi FROM q""",
}
