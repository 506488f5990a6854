"""Reproducible draws, splits, joins between id sets, set differences, and annotation bookkeeping."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import r6
from ..functions.text import blind_id
from ..plans.durable import spool
from ..sources import records as R
from ..sources.tables import once, table

SEED = 17


def hash_key(seed: int, *parts: Column) -> Column:
    """A reproducible order: the hexadecimal hash of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def exact_key(df: DataFrame, col: str, seed: int) -> DataFrame:
    """The 64-bit keyed hash of each id as 16 hexadecimal digits, which order like the unsigned number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(key=[hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).hexdigest() for x in pdf[col]])

    return df.select(col).mapInPandas(run, f"{col} {df.schema[col].dataType.simpleString()}, key string")


def prescan_cutoff(target: int, total: int) -> int:
    """A hash bound below which a scan surely holds the target smallest keys: the target and a margin, as a share of 2**64."""
    over = min(total, target + math.ceil(max(30 * math.sqrt(target), 1000)))
    return int(over / total * 2**64)


def gold_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that gold passages were cut from."""
    return R.gold(spark, d).select(F.substring_index("passage_id", ":", 1).alias("source_id")).distinct()


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Sources that aren't gold."""
    s = table(spark, d, "chunks").where("source_id is not null").select("source_id").distinct()
    return s.join(gold_sources(spark, d), "source_id", "left_anti")


def draw(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The k sources with the smallest keys among those that aren't gold: the same whatever the order of rows, and nested for smaller k."""
    return candidates(spark, d).withColumn("key", hash_key(SEED, F.col("source_id"))).orderBy("key", "source_id").limit(k)


def longest_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Per source its longest passage, ties to the smallest chunk_id."""
    c = once(table(spark, d, "chunks").select("chunk_id", "source_id", "text"), "chunk_id").where("source_id is not null and text is not null")
    best = c.groupBy("source_id").agg(F.max_by("chunk_id", F.struct(F.char_length("text"), -F.col("chunk_id"))).alias("chunk_id"))
    return best


def collisions(spark: SparkSession, d: str) -> DataFrame:
    """Sources scanned, of them gold, and left."""
    s = table(spark, d, "chunks").where("source_id is not null").select("source_id").distinct()
    g = gold_sources(spark, d)
    return s.agg(F.count(F.lit(1)).alias("n_scanned")).crossJoin(s.join(g, "source_id", "left_semi").agg(F.count(F.lit(1)).alias("n_gold"))).crossJoin(s.join(g, "source_id", "left_anti").agg(F.count(F.lit(1)).alias("n_left")))


def question_order(spark: SparkSession, d: str) -> DataFrame:
    """Distinct queries in their seeded order. Positions come from counts per range of hashes, so no task orders them all."""
    q = R.records(spark, d, "query_id").select("query_id").distinct().withColumn("key", hash_key(SEED, F.col("query_id")))
    return ordered(q, "key", "query_id").select("query_id", F.col("pos").alias("order_index"))


def ordered(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Add pos, the 0-based place in the order of a hexadecimal key: counts of its 4096 leading ranges, then within the range."""
    x = df.withColumn("lead", F.substring(key, 1, 3))
    sums = x.groupBy("lead").agg(F.count(F.lit(1)).alias("c"))
    base = sums.withColumn("base", F.sum("c").over(Window.orderBy("lead")) - F.col("c")).select("lead", "base")  # at most 4096 rows
    return x.join(base, "lead").withColumn("pos", F.col("base") + F.row_number().over(Window.partitionBy("lead").orderBy(key, tie)) - 1).drop("lead", "base")


def splits(spark: SparkSession, d: str, dev: int = 10, test: int = 30) -> DataFrame:
    """Queries split into dev and test by their seeded order; the rest is left out."""
    x = question_order(spark, d)
    return x.select("query_id", F.when(F.col("order_index") < dev, "dev").when(F.col("order_index") < dev + test, "test").alias("split")).where("split is not null")


def outside_splits(spark: SparkSession, d: str) -> DataFrame:
    """Queries of neither split."""
    return R.records(spark, d, "query_id").select("query_id").distinct().join(splits(spark, d), "query_id", "left_anti")


def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Queries that both splits hold: there must be none."""
    s = splits(spark, d)
    return s.where("split = 'dev'").select("query_id").intersect(s.where("split = 'test'").select("query_id"))


def split_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of the dev queries."""
    return R.records(spark, d, "query_id", "system_name").join(splits(spark, d).where("split = 'dev'"), "query_id", "left_semi").select("record_id", "query_id")


def control_draw(spark: SparkSession, d: str, n: int = 3) -> DataFrame:
    """Per query n of all passages that are neither gold nor blank, drawn uniformly without replacement.

    Passages are numbered in hash order and a query draws keyed random numbers, at
    most ``50 * n``. Of its different numbers only so many are looked up as are
    sure to hold n that aren't gold: no product of all queries and passages.
    """
    p = spool(R.passages(spark, d).where(F.col("text").rlike(r"(?U)\S")).select("passage_id", hash_key(SEED, F.col("passage_id")).alias("key")), "control")
    size = p.agg(F.count(F.lit(1)).alias("size")).where("size > 0")
    r = R.records(spark, d, "query_id", "gold_passage_ids").where("query_id is not null")
    q = r.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_set(F.coalesce("gold_passage_ids", F.array().cast("array<string>"))))).alias("gold"))
    number = lambda i: F.conv(F.substring(hash_key(SEED, F.col("query_id"), i), 1, 15), 16, 10).cast("bigint") % F.col("size")
    tries = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(50 * n)), number))
    x = q.crossJoin(F.broadcast(size)).select("query_id", "gold", F.posexplode(F.slice(tries, 1, F.size("gold") + n)).alias("nth", "pos"))
    x = x.join(ordered(p, "key", "passage_id").select("passage_id", "pos"), "pos").where(~F.coalesce(F.array_contains("gold", F.col("passage_id")), F.lit(False)))
    w = Window.partitionBy("query_id").orderBy("nth")
    return x.withColumn("slot", F.row_number().over(w).cast("bigint")).where(F.col("slot") <= n).select("query_id", "slot", "passage_id")


def union_all(spark: SparkSession, d: str) -> DataFrame:
    """Gold passages first, then the distractors of the drawn sources, with their part."""
    p = R.passages(spark, d)
    gold = p.join(gold_sources(spark, d), "source_id", "left_semi").select("passage_id", F.lit("gold").alias("part"))
    rest = p.join(draw(spark, d), "source_id", "left_semi").select("passage_id", F.lit("distractor").alias("part"))
    return gold.unionByName(rest)


def declared_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs that the summary declares but no record has, and the other way round."""
    a = table(spark, d, "arm_granularity").select("run_id", "system_name").distinct()
    b = R.records(spark, d, "run_id", "system_name").select("run_id", "system_name").distinct()
    x = a.withColumn("a", F.lit(1)).unionByName(b.withColumn("b", F.lit(1)), allowMissingColumns=True).groupBy("run_id", "system_name").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return x.where("a is null or b is null").select("run_id", "system_name", F.when(F.col("b").isNull(), "declared only").otherwise("present only").alias("side"))


def truncated_both(spark: SparkSession, d: str) -> DataFrame:
    """Queries with an over-long latency in either system, left out of both: the claims that stay per system."""
    r = R.records(spark, d, "query_id", "system_name", "latency_s").where("query_id is not null")
    out = r.where("system_name = 'joint' and latency_s > 20").select("query_id").union(r.where("system_name = 'post_hoc' and latency_s > 20").select("query_id")).distinct()
    return r.join(out, "query_id", "left_anti").groupBy("system_name").agg(F.count(F.lit(1)).alias("n"))


def missing_scores(spark: SparkSession, d: str) -> DataFrame:
    """Claims that no verifier has scored: what an incremental run still has to score."""
    v = table(spark, d, "verifier_scores").where("score is not null").select("claim_key").distinct()
    return R.claims(spark, d, "record_id").select("claim_key").join(v, "claim_key", "left_anti")


def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    """Cited ids against the record's list: exact, else the only passage of the same source, else unknown."""
    c = R.citations(spark, d, "record_id").select("claim_key", F.col("citation_index").cast("bigint").alias("citation_index"), "record_id", "passage_id")
    # ids that lost their index, as drift does it
    c = c.withColumn("cited", F.when(F.col("claim_key") % 5 == 0, F.concat(F.substring_index("passage_id", ":", 1), F.lit(":"))).otherwise(F.col("passage_id"))).withColumn("base", F.substring_index("cited", ":", 1))
    k = R.ranked(spark, d).select("record_id", F.col("passage_id").alias("p")).distinct()
    exact = c.join(k, (c["record_id"] == k["record_id"]) & (c["cited"] == k["p"]), "left_semi").select("claim_key", "citation_index", F.lit("exact").alias("how"), F.col("cited").alias("resolved"))
    rest = c.join(k, (c["record_id"] == k["record_id"]) & (c["cited"] == k["p"]), "left_anti")
    one = k.groupBy("record_id", F.substring_index("p", ":", 1).alias("base")).agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("only")).where("n = 1")
    near = rest.join(one, ["record_id", "base"], "left").select("claim_key", "citation_index", F.when(F.col("only").isNotNull(), "recovered").otherwise("unknown").alias("how"), F.col("only").alias("resolved"))
    return exact.unionByName(near)


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Annotation tasks: the cited claims of a query over all systems, in seeded order, with opaque ids."""
    c = R.claims(spark, d, "record_id", "claim_id", "citations").where(F.size("citations") > 0).join(R.records(spark, d, "query_id", "system_name"), "record_id")
    c = c.withColumn("key", hash_key(SEED, F.col("record_id"), F.col("claim_id")))
    w = Window.partitionBy("query_id", F.substring("key", 1, 1)).orderBy("key", "claim_key")
    return c.select("claim_key", "query_id", blind_id("unit", SEED, F.col("claim_key").cast("string")).alias("unit"), F.substring("key", 1, 1).alias("block"), F.row_number().over(w).cast("bigint").alias("place"))


def grouped_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels by unit: how many, by whom, and the notes that aren't empty."""
    x = once(table(spark, d, "human_labels").select("label_id", "unit_id", "annotator_id", "notes"), "label_id")
    return x.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_labels"), F.array_join(F.array_sort(F.collect_set("annotator_id")), ",").alias("annotators"), F.count(F.nullif(F.trim("notes"), F.lit(""))).alias("n_notes"))


def unblinded(spark: SparkSession, d: str) -> DataFrame:
    """Labels joined with the record of their claim, by system."""
    x = once(table(spark, d, "human_labels").select("label_id", "claim_key"), "label_id")
    k = R.claims(spark, d, "record_id").join(R.records(spark, d, "system_name"), "record_id").select("claim_key", "system_name")
    return x.join(k, "claim_key").groupBy("system_name").agg(F.count(F.lit(1)).alias("n_labels"), F.count_distinct("claim_key").alias("n_claims"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """State of an annotator's work at each label: how many units were done."""
    x = once(table(spark, d, "human_labels").select("label_id", "annotator_id", "question_uid", "saved_at"), "label_id").where("saved_at is not null")
    return x.groupBy("annotator_id", F.to_date("saved_at").alias("day")).agg(F.count(F.lit(1)).alias("completed"), F.max("saved_at").alias("saved_at"))


def best_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Per annotator the snapshot with most completed, ties to the newest; and the newest day."""
    s = snapshots(spark, d)
    return s.groupBy("annotator_id").agg(F.max_by("day", F.struct("completed", "saved_at")).alias("best_day"), F.max("completed").alias("completed"), F.max_by("day", "saved_at").alias("latest_day"))


def annotation_status(spark: SparkSession, d: str) -> DataFrame:
    """Per annotator: units, questions, first and last contact, and whether the label spellings are consistent."""
    x = once(table(spark, d, "human_labels").select("label_id", "annotator_id", "unit_id", "question_uid", "support_label", "saved_at"), "label_id")
    return x.groupBy("annotator_id").agg(F.count_distinct("unit_id").alias("n_units"), F.count_distinct("question_uid").alias("n_questions"), F.to_date(F.max("saved_at")).alias("last_day"), (F.count_distinct("support_label") > F.count_distinct(F.regexp_replace(F.upper(F.trim("support_label")), r"[\s-]+", "_"))).alias("mixed_spelling"))


def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    """How many leading questions, in seeded order, the two busiest annotators have both done without a gap."""
    x = once(table(spark, d, "human_labels").select("label_id", "annotator_id", "question_uid"), "label_id").where("question_uid is not null")
    top = x.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "annotator_id").limit(2)
    q = ordered(x.select("question_uid").distinct().withColumn("key", hash_key(SEED, F.col("question_uid"))), "key", "question_uid")
    both = x.join(top, "annotator_id", "left_semi").groupBy("question_uid").agg((F.count_distinct("annotator_id") == 2).alias("both"))
    gap = q.join(both, "question_uid", "left").agg(F.min(F.when(~F.coalesce("both", F.lit(False)), F.col("pos"))).alias("gap"), F.count(F.lit(1)).alias("n"))
    return gap.select(F.coalesce("gap", "n").alias("common_prefix"), F.col("n").alias("n_questions"))


def runaway(spark: SparkSession, d: str) -> DataFrame:
    """Runs of claims in one record, each of whose stems goes on from the one before: first claim and length of at least two."""
    c = R.claims(spark, d, "record_id", "claim_id", "text").where("text is not null").select("record_id", "claim_key", F.regexp_extract("claim_id", r"(\d+)", 1).cast("int").alias("i"), F.regexp_replace(F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " "))), r"[ .,;:]+$", "").alias("stem"))
    w = Window.partitionBy("record_id").orderBy("i", "claim_key")
    prev = F.lag("stem").over(w)
    goes = (F.char_length("stem") > F.char_length(prev)) & F.startswith(F.col("stem"), prev) & ~F.substring(F.col("stem"), F.char_length(prev) + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    x = c.withColumn("new", F.when(F.coalesce(goes, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return x.groupBy("record_id", "island").agg(F.count(F.lit(1)).alias("length"), F.min("claim_key").alias("first_claim")).where("length >= 2").select("record_id", "first_claim", "length")


def confusable(spark: SparkSession, d: str) -> DataFrame:
    """Per query the greatest claim score of each system, and their mean over queries: wins, losses and mean difference."""
    v = once(table(spark, d, "verifier_scores").select("score_id", "claim_key", "verifier_name", "score"), "score_id").where("verifier_name = 'minifact' and score is not null and not isnan(score)")
    x = v.join(R.claims(spark, d, "record_id").join(R.records(spark, d, "query_id", "system_name"), "record_id"), "claim_key")
    g = x.groupBy("query_id").agg(F.max(F.when(F.col("system_name") == "joint", F.round("score", 6))).alias("a"), F.max(F.when(F.col("system_name") == "post_hoc", F.round("score", 6))).alias("b")).where("a is not null and b is not null")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), r6(F.avg(F.col("a") - F.col("b")), "mean_delta"), r6(F.median(F.col("a") - F.col("b")), "median_delta"))


def sign_test(spark: SparkSession, d: str) -> DataFrame:
    """The exact two-sided sign test of these wins and losses, by a running product of binomial terms."""
    c = confusable(spark, d).select("wins", "losses", (F.col("wins") + F.col("losses")).alias("m"), F.least("wins", "losses").alias("k"))
    start = F.struct(F.pow(F.lit(0.5), F.col("m")).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("k")), start, lambda a, i: F.struct((a["term"] * (F.col("m") - i) / (i + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum")), lambda a: a["sum"])
    return c.select("wins", "losses", F.when(F.col("m") > 0, F.round(F.least(F.lit(1.0), 2 * tail), 6)).alias("p_value"))


QUERIES = {
    "agg19_confusable": confusable,
    "an1_tasks": tasks,
    "an3_grouped_labels": grouped_labels,
    "an4_status": annotation_status,
    "fn24_sign_test": sign_test,
    "jn1_collisions": collisions,
    "jn3_split_records": split_records,
    "jn4_outside_splits": outside_splits,
    "jn12_unblinded": unblinded,
    "jn13_common_prefix": common_prefix,
    "jn17_resolved_ids": resolved_ids,
    "set1_union": union_all,
    "set2_split_overlap": split_overlap,
    "set4_declared_runs": declared_runs,
    "set5_truncated_both": truncated_both,
    "set6_missing_scores": missing_scores,
    "top1_draw": draw,
    "top2_exact_keys": lambda s, d: exact_key(candidates(s, d), "source_id", SEED),
    "top4_longest_per_source": longest_per_source,
    "top6_question_order": question_order,
    "top7_splits": splits,
    "top10_best_snapshot": best_snapshot,
    "top12_control_draw": control_draw,
    "win5_runaway": runaway,
}

_PRE = """WITH r AS (SELECT DISTINCT ON (record_id) * FROM query_records), c AS (SELECT DISTINCT ON (claim_key) * FROM claims), hl AS (SELECT DISTINCT ON (label_id) * FROM human_labels), ch AS (SELECT DISTINCT ON (chunk_id) * FROM chunks),
g AS (SELECT DISTINCT record_id, unnest(gold_passage_ids) AS passage_id FROM r), gs AS (SELECT DISTINCT split_part(passage_id, ':', 1) AS source_id FROM g WHERE passage_id IS NOT NULL), s AS (SELECT DISTINCT source_id FROM chunks WHERE source_id IS NOT NULL),
cd AS (SELECT source_id FROM s ANTI JOIN gs USING (source_id)), dr AS (SELECT source_id, md5('17:' || source_id) AS key FROM cd ORDER BY 2, 1 LIMIT 50),
p AS (SELECT passage_id, arg_min(text, chunk_id) AS text, arg_min(source_id, chunk_id) AS source_id FROM chunks WHERE passage_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
qo AS (SELECT query_id, row_number() OVER (ORDER BY md5('17:' || query_id), query_id) - 1 AS order_index FROM (SELECT DISTINCT query_id FROM r)), sl AS (SELECT query_id, CASE WHEN order_index < 10 THEN 'dev' ELSE 'test' END AS split FROM qo WHERE order_index < 40)"""
_SN = ", sn AS (SELECT annotator_id, (saved_at AT TIME ZONE 'UTC')::DATE AS day, count(*) AS completed, max(saved_at) AS saved_at FROM hl WHERE saved_at IS NOT NULL GROUP BY 1, 2)"
_CF = ", v AS (SELECT DISTINCT ON (score_id) * FROM verifier_scores), cf AS (SELECT q AS query_id, max(round(score, 6)) FILTER (system_name = 'joint') AS a, max(round(score, 6)) FILTER (system_name = 'post_hoc') AS b FROM v JOIN c USING (claim_key) JOIN (SELECT record_id, query_id AS q, system_name FROM r) r2 USING (record_id) WHERE verifier_name = 'minifact' AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1 HAVING count(*) FILTER (system_name = 'joint') > 0 AND count(*) FILTER (system_name = 'post_hoc') > 0)"

SQL = {
    "agg19_confusable": _PRE + _CF + "SELECT count(*) AS n, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, round(avg(a - b), 6) AS mean_delta, round(median(a - b), 6) AS median_delta FROM cf",
    "an1_tasks": _PRE + ", k AS (SELECT claim_key, query_id, md5('17:' || record_id || ':' || claim_id) AS key FROM c JOIN r USING (record_id) WHERE len(citations) > 0) SELECT claim_key, query_id, 'unit_' || substr(sha256('unit|17|' || claim_key), 1, 12) AS unit, substr(key, 1, 1) AS block, row_number() OVER (PARTITION BY query_id, substr(key, 1, 1) ORDER BY key, claim_key) AS place FROM k",
    "an3_grouped_labels": _PRE + "SELECT unit_id, count(*) AS n_labels, coalesce(array_to_string(list_sort(list(DISTINCT annotator_id) FILTER (annotator_id IS NOT NULL)), ','), '') AS annotators, count(nullif(trim(notes), '')) AS n_notes FROM hl GROUP BY 1",
    "an4_status": _PRE + r"SELECT annotator_id, count(DISTINCT unit_id) AS n_units, count(DISTINCT question_uid) AS n_questions, (max(saved_at) AT TIME ZONE 'UTC')::DATE AS last_day, count(DISTINCT support_label) > count(DISTINCT regexp_replace(upper(trim(support_label)), '[\s-]+', '_', 'g')) AS mixed_spelling FROM hl GROUP BY 1",
    "fn24_sign_test": _PRE + _CF + ", n AS (SELECT count(*) FILTER (a > b) AS w, count(*) FILTER (a < b) AS l FROM cf) SELECT w AS wins, l AS losses, round(least(1, 2 * list_sum(list_transform(range(0, least(w, l) + 1), lambda i: exp(lgamma(w + l + 1) - lgamma(i + 1) - lgamma(w + l - i + 1) + (w + l) * ln(0.5))))), 6) AS p_value FROM n",
    "jn1_collisions": _PRE + "SELECT (SELECT count(*) FROM s) AS n_scanned, (SELECT count(*) FROM s SEMI JOIN gs USING (source_id)) AS n_gold, (SELECT count(*) FROM cd) AS n_left",
    "jn3_split_records": _PRE + "SELECT record_id, query_id FROM r SEMI JOIN (SELECT * FROM sl WHERE split = 'dev') USING (query_id)",
    "jn4_outside_splits": _PRE + "SELECT query_id FROM qo ANTI JOIN sl USING (query_id)",
    "jn12_unblinded": _PRE + "SELECT system_name, count(*) AS n_labels, count(DISTINCT claim_key) AS n_claims FROM hl JOIN c USING (claim_key) JOIN r USING (record_id) GROUP BY 1",
    "jn13_common_prefix": _PRE + ", t AS (SELECT annotator_id FROM hl WHERE question_uid IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, annotator_id LIMIT 2), q AS (SELECT question_uid, row_number() OVER (ORDER BY md5('17:' || question_uid), question_uid) - 1 AS pos FROM (SELECT DISTINCT question_uid FROM hl WHERE question_uid IS NOT NULL)), b AS (SELECT question_uid FROM hl WHERE annotator_id IN (SELECT annotator_id FROM t) GROUP BY 1 HAVING count(DISTINCT annotator_id) = 2) SELECT coalesce(min(pos) FILTER (b.question_uid IS NULL), count(*)) AS common_prefix, count(*) AS n_questions FROM q LEFT JOIN b USING (question_uid)",
    "jn17_resolved_ids": _PRE + ", ci AS (SELECT claim_key, record_id, i - 1 AS citation_index, CASE WHEN claim_key % 5 = 0 THEN split_part(citations[i].passage_id, ':', 1) || ':' ELSE citations[i].passage_id END AS cited FROM (SELECT *, unnest(range(1, len(citations) + 1)) AS i FROM c)), k AS (SELECT DISTINCT record_id, unnest(retrieved).passage_id AS p FROM r), o AS (SELECT record_id, split_part(p, ':', 1) AS base, min(p) AS only_ FROM k GROUP BY 1, 2 HAVING count(*) = 1) SELECT claim_key, citation_index, CASE WHEN k.p IS NOT NULL THEN 'exact' WHEN only_ IS NOT NULL THEN 'recovered' ELSE 'unknown' END AS how, CASE WHEN k.p IS NOT NULL THEN cited ELSE only_ END AS resolved FROM ci LEFT JOIN k ON k.record_id = ci.record_id AND k.p = cited LEFT JOIN o ON o.record_id = ci.record_id AND o.base = split_part(cited, ':', 1)",
    "set1_union": _PRE + "SELECT passage_id, 'gold' AS part FROM p SEMI JOIN gs USING (source_id) UNION ALL SELECT passage_id, 'distractor' FROM p SEMI JOIN dr USING (source_id)",
    "set2_split_overlap": _PRE + "SELECT query_id FROM sl WHERE split = 'dev' INTERSECT SELECT query_id FROM sl WHERE split = 'test'",
    "set4_declared_runs": _PRE + ", a AS (SELECT DISTINCT run_id, system_name FROM arm_granularity), b AS (SELECT DISTINCT run_id, system_name FROM r) SELECT *, 'declared only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'present only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "set5_truncated_both": _PRE + "SELECT system_name, count(*) AS n FROM r WHERE query_id IS NOT NULL AND query_id NOT IN (SELECT query_id FROM r WHERE query_id IS NOT NULL AND system_name IN ('joint', 'post_hoc') AND latency_s > 20) GROUP BY 1",
    "set6_missing_scores": _PRE + "SELECT claim_key FROM c ANTI JOIN (SELECT DISTINCT claim_key FROM verifier_scores WHERE score IS NOT NULL) USING (claim_key)",
    "top1_draw": _PRE + "SELECT source_id, key FROM dr",
    "top4_longest_per_source": _PRE + "SELECT source_id, arg_max(chunk_id, (length(text), -chunk_id)) AS chunk_id FROM ch WHERE source_id IS NOT NULL AND text IS NOT NULL GROUP BY 1",
    "top6_question_order": _PRE + "SELECT query_id, order_index FROM qo",
    "top7_splits": _PRE + "SELECT query_id, split FROM sl",
    "top10_best_snapshot": _PRE + _SN + "SELECT annotator_id, arg_max(day, (completed, saved_at)) AS best_day, max(completed) AS completed, arg_max(day, saved_at) AS latest_day FROM sn GROUP BY 1",
    "win5_runaway": _PRE + r", k AS (SELECT record_id, claim_key, regexp_extract(claim_id, '(\d+)', 1)::INT AS i, regexp_replace(lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))), '[ .,;:]+$', '') AS stem FROM c WHERE text IS NOT NULL), l AS (SELECT *, lag(stem) OVER (PARTITION BY record_id ORDER BY i, claim_key) AS prev FROM k), n AS (SELECT *, CASE WHEN length(stem) > length(prev) AND starts_with(stem, prev) AND NOT regexp_matches(substr(stem, length(prev) + 1, 1), '[\p{L}\p{N}]') THEN 0 ELSE 1 END AS new FROM l), o AS (SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY i, claim_key) AS island FROM n) SELECT record_id, min(claim_key) AS first_claim, count(*) AS length FROM o GROUP BY record_id, island HAVING count(*) >= 2",
}
