"""Claims: length statistics, parity of two systems, strata, compound markers, abstentions and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import r6
from ..sources import records as R
from ..sources.tables import once, table

# Patterns of compound claims.
MARKERS = {
    "and": r"(?i)\band\b",
    "subordinate": r"(?i),\s*(?:which|while|whereas)\b",
    "multi_comma": r",[^,]*,",
}

# A claim states an incapacity by one of these ...
INCAPACITY = r"(?i)\b(?:(?:can|could)\s*not\s+be\s+(?:\w+\s+){0,2}(?:answer|address|determin|establish|conclud|assess)|(?:is|are|was|were)\s+not\s+(?:\w+\s+){0,2}(?:answered|addressed|discussed|mentioned|reported|provided|specified)|do(?:es)?\s+not\s+(?:\w+\s+){0,2}(?:answer|address|discuss|mention|report|provide|specify|contain|state)|(?:no|insufficient|not\s+enough)\s+(?:\w+\s+){0,2}(?:information|evidence|data|detail)|(?:cannot|can\s*not)\s+(?:be\s+)?(?:\w+\s+){0,2}(?:answered|determined|established|assessed))"
# ... and names the source it is about.
SOURCE = r"(?i)\b(?:passage|context|excerpt|abstract|document|source|text|article|provided\s+information)s?\b"

#: Most citations of a claim, and the tolerated gap of median lengths.
MAX_CITATIONS, PARITY_GAP = 3, 0.15

# The bands of claim lengths and of claims per query.
LENGTH_BANDS = ((1, 10), (11, 15), (16, 20), (21, 30), (31, None))
COUNT_BANDS = ((1, 5), (6, 10), (11, None))


def words(text: Column) -> Column:
    """Words between white space of any script."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def band(x: Column, bands) -> Column:
    """The name of the band that holds x; null outside of all."""
    out = F.lit(None).cast("string")
    for lo, hi in bands:
        out = F.when((x >= lo) & (x <= hi) if hi else x >= lo, f"{lo}-{hi}" if hi else f"{lo}+").otherwise(out)
    return out


def claim_rows(spark: SparkSession, d: str) -> DataFrame:
    """Claims with text, their words, and the run, system and query of their record."""
    c = R.claims(spark, d, "record_id", "text", "citations").where("text is not null").withColumn("words", words(F.col("text")))
    return c.join(R.records(spark, d, "run_id", "system_name", "query_id"), "record_id")


def arm_granularity(spark: SparkSession, d: str) -> DataFrame:
    """Per run and system: records (also those without claims), claims, and exact percentiles of words per claim and claims per record."""
    w = claim_rows(spark, d).groupBy("run_id", "system_name").agg(
        F.count(F.lit(1)).alias("n_claims"), *[r6(F.percentile("words", F.lit(q)), n) for n, q in (("median_words", 0.5), ("p25_words", 0.25), ("p75_words", 0.75), ("p90_words", 0.9))], r6(F.avg("words"), "mean_words")
    )
    per = R.claims(spark, d, "record_id", "text").where("text is not null").groupBy("record_id").agg(F.count(F.lit(1)).alias("c"))
    n = R.records(spark, d, "run_id", "system_name").join(per, "record_id", "left").groupBy("run_id", "system_name").agg(F.count(F.lit(1)).alias("n_records"), r6(F.median(F.coalesce("c", F.lit(0))), "median_claims"))
    return n.join(w, ["run_id", "system_name"])


def compound_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rates of compound markers per system, share of simple claims, and the median length of these (null if none)."""
    hit = {k: F.col("text").rlike(p) for k, p in MARKERS.items()}
    c = claim_rows(spark, d).withColumns({f"m_{k}": v for k, v in hit.items()})
    simple = ~(F.col("m_and") | F.col("m_subordinate") | F.col("m_multi_comma"))
    return c.groupBy("system_name").agg(
        F.count(F.lit(1)).alias("n_claims"), *[r6(F.avg(F.col(f"m_{k}").cast("double")), f"rate_{k}") for k in MARKERS], r6(F.avg(simple.cast("double")), "simple_share"), r6(F.median(F.when(simple, F.col("words"))), "median_simple_words")
    )


def markers(spark: SparkSession, d: str) -> DataFrame:
    """The compound markers of each claim, joined in their order."""
    each = F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in MARKERS.items()])
    return R.claims(spark, d, "text").where("text is not null").select("claim_key", F.array_join(F.array_compact(each), ",").alias("markers"))


def is_abstention(text: Column, citations: Column) -> Column:
    """No citation, an incapacity, and the source it is about; all three. Null citations are none."""
    return (F.coalesce(F.size(citations), F.lit(0)) <= 0) & text.rlike(INCAPACITY) & text.rlike(SOURCE)


def abstentions(spark: SparkSession, d: str) -> DataFrame:
    """The claims that decline to answer."""
    return R.claims(spark, d, "text", "citations").where(is_abstention(F.col("text"), F.col("citations"))).select("claim_key")


def abstention_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of abstaining claims per system, 0.0 for a system without claims."""
    c = claim_rows(spark, d).withColumn("a", is_abstention(F.col("text"), F.col("citations")))
    per = c.groupBy("system_name").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if("a").alias("n_abstaining"))
    return R.records(spark, d, "system_name").select("system_name").distinct().join(per, "system_name", "left").select("system_name", F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.coalesce("n_abstaining", F.lit(0)).alias("n_abstaining"), r6(F.coalesce(F.col("n_abstaining") / F.col("n_claims"), F.lit(0.0)), "abstention_rate"))


def full_abstentions(spark: SparkSession, d: str) -> DataFrame:
    """Records with claims, all of which abstain."""
    c = claim_rows(spark, d).withColumn("a", is_abstention(F.col("text"), F.col("citations")))
    return c.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("a")).where("n = a").select("record_id")


def parity(spark: SparkSession, d: str) -> DataFrame:
    """Median words per claim of joint and post_hoc, the relative gap, and whether it stays within the tolerance."""
    return _gap(claim_rows(spark, d).where("system_name in ('joint', 'post_hoc')"), [])


def _gap(rows: DataFrame, by: list[str]) -> DataFrame:
    g = rows.groupBy(*by, F.lit(1).alias("one")).agg(
        *[F.median(F.when(F.col("system_name") == s, F.col("words"))).alias(f"median_{s}") for s in ("joint", "post_hoc")],
        *[F.count_if(F.col("system_name") == s).alias(f"n_{s}") for s in ("joint", "post_hoc")],
        F.count_distinct("query_id").alias("n_queries"),
    )
    gap = (F.col("median_post_hoc") - F.col("median_joint")) / F.col("median_joint")
    return g.select(*by, "n_joint", "n_post_hoc", "n_queries", r6(F.col("median_joint"), "median_joint"), r6(F.col("median_post_hoc"), "median_post_hoc"), r6(gap, "gap"), (F.abs(gap) <= PARITY_GAP).alias("passes"))


def both_arms(spark: SparkSession, d: str) -> DataFrame:
    """Claims of joint and post_hoc on the queries that both have claims for."""
    c = claim_rows(spark, d).where("system_name in ('joint', 'post_hoc')")
    shared = c.groupBy("query_id").agg(F.count_distinct("system_name").alias("k")).where("k = 2").select("query_id")
    return c.join(shared, "query_id", "left_semi")


def compound_strata(spark: SparkSession, d: str) -> DataFrame:
    """Parity within simple and within compound claims."""
    compound = F.col("text").rlike(MARKERS["and"]) | F.col("text").rlike(MARKERS["subordinate"]) | F.col("text").rlike(MARKERS["multi_comma"])
    return _gap(both_arms(spark, d).withColumn("stratum", F.when(compound, "compound").otherwise("simple")), ["stratum"])


def length_strata(spark: SparkSession, d: str) -> DataFrame:
    """Parity within bands of claim length."""
    return _gap(both_arms(spark, d).withColumn("stratum", band(F.col("words"), LENGTH_BANDS)).where("stratum is not null"), ["stratum"])


def count_strata(spark: SparkSession, d: str) -> DataFrame:
    """Parity within bands of the joint system's claims per query."""
    c = both_arms(spark, d)
    per = c.groupBy("query_id").agg(F.count_if(F.col("system_name") == "joint").alias("k")).select("query_id", band(F.col("k"), COUNT_BANDS).alias("stratum")).where("stratum is not null")
    return _gap(c.join(per, "query_id"), ["stratum"])


def stratified_gate(spark: SparkSession, d: str, least: int = 10) -> DataFrame:
    """Per scheme: strata with enough queries in both arms, and whether there is one and all of them pass."""
    all_ = [f(spark, d).withColumn("scheme", F.lit(n)) for n, f in (("compound", compound_strata), ("length", length_strata), ("claim_count", count_strata))]
    x = all_[0].unionByName(all_[1]).unionByName(all_[2]).withColumn("powered", (F.col("n_queries") >= least) & (F.col("n_joint") > 0) & (F.col("n_post_hoc") > 0))
    return x.groupBy("scheme").agg(F.count_if("powered").alias("n_powered"), ((F.count_if("powered") > 0) & F.coalesce(F.bool_and(F.when(F.col("powered"), F.col("passes"))), F.lit(False))).alias("passes"))


def over_cap(spark: SparkSession, d: str) -> DataFrame:
    """Claims with more citations than allowed."""
    return R.claims(spark, d, "citations").where(F.size("citations") > MAX_CITATIONS).select("claim_key", F.size("citations").cast("bigint").alias("n_citations"))


def bad_spans(spark: SparkSession, d: str) -> DataFrame:
    """Citations whose span starts below 0 or ends before its start."""
    return R.citations(spark, d).where("char_start < 0 or char_end < char_start").select("claim_key", F.col("citation_index").cast("bigint").alias("citation_index"))


def supporting(spark: SparkSession, d: str) -> DataFrame:
    """Human labels collapsed to supporting or not; unusable labels are null."""
    x = once(table(spark, d, "human_labels").select("label_id", "support_label"), "label_id")
    name = F.regexp_replace(F.upper(F.trim("support_label")), r"[\s-]+", "_")
    good = F.when(name.isin("SUPPORTED", "PARTIAL"), True).when(name.isin("NOT_SUPPORTED", "CONTRADICTED"), False)
    return x.groupBy(good.alias("supporting")).agg(F.count(F.lit(1)).alias("n"))


def validation(spark: SparkSession, d: str) -> DataFrame:
    """The problems of each record, reported and never repaired: duplicate claim ids, claims over the citation cap, citations
    outside the retrieved passages (where any were retrieved), quotes of another length than their span, ranks that aren't
    1..n, and citations of the vanilla system."""
    c = R.claims(spark, d, "record_id", "claim_id", "citations").groupBy("record_id").agg(
        (F.count("claim_id") > F.count_distinct("claim_id")).alias("dup"), F.max(F.size("citations") > MAX_CITATIONS).alias("cap"), F.max(F.size("citations") > 0).alias("cites"), F.max(F.exists("citations", lambda x: x["quoted_text"].isNotNull() & (F.char_length(x["quoted_text"]) != x["char_end"] - x["char_start"]))).alias("quote")
    )
    r = R.records(spark, d, "system_name", "retrieved")
    outside = R.citations(spark, d, "record_id").join(r.where(F.size("retrieved") > 0).select("record_id"), "record_id", "left_semi").join(R.ranked(spark, d).select("record_id", "passage_id").distinct(), ["record_id", "passage_id"], "left_anti").select("record_id").distinct().withColumn("outside", F.lit(True))
    n = F.size("retrieved")
    ranks = F.when(n > 0, ~(F.array_sort(F.transform("retrieved", lambda p: p["rank_no"])) == F.sequence(F.lit(1), F.greatest(n, F.lit(1))))).otherwise(False)
    x = r.withColumn("ranks", ranks).join(c, "record_id", "left").join(outside, "record_id", "left")
    on = lambda name: F.coalesce(F.col(name), F.lit(False))
    names = (("duplicate_claim_id", on("dup")), ("over_cap", on("cap")), ("not_retrieved", on("outside")), ("quote_length", on("quote")), ("ranks", on("ranks")), ("vanilla_cites", on("cites") & (F.col("system_name") == "vanilla")))
    return x.select("record_id", F.array_join(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in names])), ",").alias("problems")).where("problems <> ''")


def divergence(spark: SparkSession, d: str) -> DataFrame:
    """Share of claims per system whose text isn't in the slice of the reply that it came from; claims without a span don't count."""
    c = R.claims(spark, d, "record_id", "text", "source_start", "source_end").where("text is not null and source_start is not null and source_end is not null")
    x = c.join(R.records(spark, d, "system_name", "raw_generation").where("raw_generation is not null"), "record_id")
    piece = F.substring(F.col("raw_generation"), F.col("source_start") + 1, F.col("source_end") - F.col("source_start"))
    return x.groupBy("system_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.instr(piece, F.trim("text")) == 0).alias("diverging"), r6(F.avg((F.instr(piece, F.trim("text")) == 0).cast("double")), "divergence"))


def stems(spark: SparkSession, d: str) -> DataFrame:
    """Claim stems (white space collapsed, small letters, trailing marks off) and how many claims share each."""
    flat = F.trim(F.regexp_replace(F.col("text"), r"(?U)\s+", " "))
    return R.claims(spark, d, "text").where("text is not null").groupBy(F.regexp_replace(F.lower(flat), r"[ .,;:]+$", "").alias("stem")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "fn1_words": lambda s, d: R.claims(s, d, "text").where("text is not null").select("claim_key", words(F.col("text")).cast("bigint").alias("words")),
    "fn7_stems": stems,
    "agg1_arm_granularity": arm_granularity,
    "agg9_abstention_rate": abstention_rate,
    "agg11_compound_profile": compound_profile,
    "agg24_divergence": divergence,
    "prj1_validate": validation,
    "prj2_bad_spans": bad_spans,
    "prj3_supporting": supporting,
    "prj4_over_cap": over_cap,
    "prj6_abstentions": abstentions,
    "prj8_full_abstentions": full_abstentions,
    "prj9_markers": markers,
    "sc13_parity": parity,
    "sc14_compound_strata": compound_strata,
    "sc15_length_strata": length_strata,
    "sc16_count_strata": count_strata,
    "sc17_stratified_gate": stratified_gate,
}

_WS = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_C = rf"""WITH r AS (SELECT DISTINCT ON (record_id) * FROM query_records), c AS (SELECT DISTINCT ON (claim_key) * FROM claims),
cr AS (SELECT c.*, len(regexp_extract_all(text, '[^\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+')) AS words, run_id, system_name, query_id FROM c JOIN r USING (record_id) WHERE text IS NOT NULL)"""
_M = {"and": r"regexp_matches(text, '(?i)\band\b')", "subordinate": r"regexp_matches(text, '(?i),\s*(?:which|while|whereas)\b')", "multi_comma": "regexp_matches(text, ',[^,]*,')"}
_COMPOUND = "(" + " OR ".join(_M.values()) + ")"
_ABST = f"(coalesce(len(citations), 0) = 0 AND regexp_matches(text, '{INCAPACITY}') AND regexp_matches(text, '{SOURCE}'))"
_BOTH = _C + ", b AS (SELECT * FROM cr WHERE system_name IN ('joint', 'post_hoc') AND query_id IN (SELECT query_id FROM cr WHERE system_name IN ('joint', 'post_hoc') GROUP BY 1 HAVING count(DISTINCT system_name) = 2))"


def _band_sql(x: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {x} BETWEEN {lo} AND {hi} THEN '{lo}-{hi}'" if hi else f"WHEN {x} >= {lo} THEN '{lo}+'" for lo, hi in bands) + " END"


def _gap_sql(src: str, by: str = "") -> str:
    return f"""SELECT {by + ', ' if by else ''}n_joint, n_post_hoc, n_queries, round(mj, 6) AS median_joint, round(mp, 6) AS median_post_hoc, round((mp - mj) / mj, 6) AS gap, abs((mp - mj) / mj) <= 0.15 AS passes FROM (
SELECT {by + ', ' if by else ''}median(words) FILTER (system_name = 'joint') AS mj, median(words) FILTER (system_name = 'post_hoc') AS mp, count(*) FILTER (system_name = 'joint') AS n_joint, count(*) FILTER (system_name = 'post_hoc') AS n_post_hoc, count(DISTINCT query_id) AS n_queries FROM {src} {'GROUP BY ' + by if by else ''})"""


_S14 = _gap_sql(f"(SELECT *, CASE WHEN {_COMPOUND} THEN 'compound' ELSE 'simple' END AS stratum FROM b)", "stratum")
_S15 = _gap_sql(f"(SELECT *, {_band_sql('words', LENGTH_BANDS)} AS stratum FROM b WHERE words > 0)", "stratum")
_S16 = _gap_sql(f"(SELECT b.*, {_band_sql('k', COUNT_BANDS)} AS stratum FROM b JOIN (SELECT query_id, count(*) FILTER (system_name = 'joint') AS k FROM b GROUP BY 1) USING (query_id) WHERE k > 0)", "stratum")

SQL = {
    "fn1_words": _C + rf"SELECT claim_key, len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')) AS words FROM c WHERE text IS NOT NULL",
    "fn7_stems": _C + rf"SELECT regexp_replace(lower(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))), '[ .,;:]+$', '') AS stem, count(*) AS n FROM c WHERE text IS NOT NULL GROUP BY 1",
    "agg1_arm_granularity": _C + ", k AS (SELECT record_id, count(*) AS c FROM c WHERE text IS NOT NULL GROUP BY 1), n AS (SELECT run_id, system_name, count(*) AS n_records, round(median(coalesce(c, 0)), 6) AS median_claims FROM r LEFT JOIN k USING (record_id) GROUP BY 1, 2) SELECT n.*, n_claims, median_words, p25_words, p75_words, p90_words, mean_words FROM n JOIN (SELECT run_id, system_name, count(*) AS n_claims, round(median(words), 6) AS median_words, round(quantile_cont(words, 0.25), 6) AS p25_words, round(quantile_cont(words, 0.75), 6) AS p75_words, round(quantile_cont(words, 0.9), 6) AS p90_words, round(avg(words), 6) AS mean_words FROM cr GROUP BY 1, 2) USING (run_id, system_name)",
    "agg9_abstention_rate": _C + f"SELECT system_name, count(c.claim_key) AS n_claims, count(*) FILTER (c.a) AS n_abstaining, round(coalesce(count(*) FILTER (c.a) / nullif(count(c.claim_key), 0), 0), 6) AS abstention_rate FROM r LEFT JOIN (SELECT record_id, claim_key, {_ABST} AS a FROM cr) c USING (record_id) GROUP BY 1",
    "agg11_compound_profile": _C + "SELECT system_name, count(*) AS n_claims, " + ", ".join(f"round(avg({m}::INT), 6) AS rate_{k}" for k, m in _M.items()) + f", round(avg((NOT {_COMPOUND})::INT), 6) AS simple_share, round(median(words) FILTER (NOT {_COMPOUND}), 6) AS median_simple_words FROM cr GROUP BY 1",
    "agg24_divergence": _C + "SELECT system_name, count(*) AS n, count(*) FILTER (x = 0) AS diverging, round(avg((x = 0)::INT), 6) AS divergence FROM (SELECT system_name, instr(substr(raw_generation, source_start + 1, source_end - source_start), trim(text, ' ')) AS x FROM c JOIN r USING (record_id) WHERE text IS NOT NULL AND source_start IS NOT NULL AND source_end IS NOT NULL AND raw_generation IS NOT NULL) GROUP BY 1",
    "prj1_validate": _C
    + """, ci AS (SELECT record_id, unnest(citations, recursive := true) FROM c), rk AS (SELECT DISTINCT record_id, unnest(retrieved).passage_id AS passage_id FROM r),
f AS (SELECT record_id, count(claim_id) > count(DISTINCT claim_id) AS dup, coalesce(bool_or(len(citations) > 3), false) AS cap, coalesce(bool_or(len(citations) > 0), false) AS cites FROM c GROUP BY 1),
q AS (SELECT record_id, bool_or(quoted_text IS NOT NULL AND length(quoted_text) <> char_end - char_start) AS quote FROM ci GROUP BY 1),
o AS (SELECT DISTINCT record_id, true AS outside FROM ci ANTI JOIN rk ON ci.record_id = rk.record_id AND ci.passage_id = rk.passage_id WHERE record_id IN (SELECT record_id FROM r WHERE len(retrieved) > 0)),
x AS (SELECT r.record_id, list_filter([CASE WHEN dup THEN 'duplicate_claim_id' END, CASE WHEN cap THEN 'over_cap' END, CASE WHEN outside THEN 'not_retrieved' END, CASE WHEN quote THEN 'quote_length' END,
 CASE WHEN len(retrieved) > 0 AND list_sort(list_transform(retrieved, lambda p: p.rank_no)) <> list_transform(range(1, len(retrieved) + 1), lambda i: i::INT) THEN 'ranks' END, CASE WHEN cites AND system_name = 'vanilla' THEN 'vanilla_cites' END], lambda s: s IS NOT NULL) AS p
 FROM r LEFT JOIN f USING (record_id) LEFT JOIN q USING (record_id) LEFT JOIN o USING (record_id))
SELECT record_id, array_to_string(p, ',') AS problems FROM x WHERE len(p) > 0""",
    "prj2_bad_spans": _C + "SELECT claim_key, i - 1 AS citation_index FROM (SELECT claim_key, unnest(range(1, len(citations) + 1)) AS i, citations FROM c) WHERE citations[i].char_start < 0 OR citations[i].char_end < citations[i].char_start",
    "prj3_supporting": r"SELECT CASE WHEN l IN ('SUPPORTED', 'PARTIAL') THEN true WHEN l IN ('NOT_SUPPORTED', 'CONTRADICTED') THEN false END AS supporting, count(*) AS n FROM (SELECT label_id, any_value(regexp_replace(upper(trim(support_label)), '[\s-]+', '_', 'g')) AS l FROM human_labels GROUP BY 1) GROUP BY 1",
    "prj4_over_cap": _C + "SELECT claim_key, len(citations) AS n_citations FROM c WHERE len(citations) > 3",
    "prj6_abstentions": _C + f"SELECT claim_key FROM c WHERE {_ABST}",
    "prj8_full_abstentions": _C + f"SELECT record_id FROM cr GROUP BY 1 HAVING bool_and({_ABST})",
    "prj9_markers": _C + "SELECT claim_key, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {m} THEN '{k}' END" for k, m in _M.items()) + "], lambda s: s IS NOT NULL), ',') AS markers FROM c WHERE text IS NOT NULL",
    "sc13_parity": _C + _gap_sql("(SELECT * FROM cr WHERE system_name IN ('joint', 'post_hoc'))"),
    "sc14_compound_strata": _BOTH + _S14,
    "sc15_length_strata": _BOTH + _S15,
    "sc16_count_strata": _BOTH + _S16,
    "sc17_stratified_gate": _BOTH + f"SELECT scheme, count(*) FILTER (p) AS n_powered, count(*) FILTER (p) > 0 AND coalesce(bool_and(passes) FILTER (p), false) AS passes FROM (SELECT *, n_queries >= 10 AND n_joint > 0 AND n_post_hoc > 0 AS p FROM (SELECT 'compound' AS scheme, * FROM ({_S14}) UNION ALL SELECT 'length', * FROM ({_S15}) UNION ALL SELECT 'claim_count', * FROM ({_S16}))) GROUP BY 1",
}
