"""Citation precision and recall from stored entailment scores, the contrast of two systems, and threshold sweeps.

Scores are facts and thresholds are applied when asked: per claim one score of
its united spans, one of each span alone, and one of the rest without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import harmonic, r6, ratio
from ..plans.durable import spool
from ..sources import records as R
from . import agreement as A
from .claim_metrics import LENGTH_BANDS, band, is_abstention, words

#: The score from which a premise entails a hypothesis.
TAU = 0.3
TAUS = (0.1, 0.3, 0.5, 0.7, 0.9)


def span_texts(spark: SparkSession, d: str) -> DataFrame:
    """(claim_key, citation_index, span): the cited slice of the passage, else the stored quote; null if there is neither."""
    c = R.citations(spark, d).join(R.passages(spark, d).select("passage_id", "text"), "passage_id", "left")
    piece = F.when(F.col("char_end") >= F.col("char_start"), F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
    return c.select("claim_key", F.col("citation_index").cast("bigint").alias("citation_index"), F.coalesce(piece, "quoted_text").alias("span"))


def _tokens(c):
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Per claim with text: the scores u (united spans), s (each alone), l (the others), rounded to six places.

    The stand-in scorer is the share of the claim's distinct words that the
    premise has; any scorer of (premise, hypothesis) pairs can take its place.
    """
    c = R.claims(spark, d, "record_id", "text", "citations").where("text is not null").select("claim_key", "record_id", "text", words(F.col("text")).alias("n_words"), is_abstention(F.col("text"), F.col("citations")).alias("abstains"))
    spans = span_texts(spark, d).groupBy("claim_key").agg(F.array_sort(F.collect_list(F.struct("citation_index", _tokens(F.coalesce("span", F.lit(""))).alias("t")))).alias("g"))
    x = c.join(spans, "claim_key", "left").withColumns({"h": _tokens(F.col("text")), "p": F.coalesce(F.transform("g", lambda s: s["t"]), F.array().cast("array<array<string>>"))})
    score = lambda t: F.round(F.coalesce(F.size(F.array_intersect(F.col("h"), t)) / F.nullif(F.size("h"), F.lit(0)), F.lit(0.0)), 6)
    rest = lambda _, i: score(F.flatten(F.filter(F.col("p"), lambda __, j: j != i)))
    x = x.select("claim_key", "record_id", "n_words", "abstains", score(F.flatten("p")).alias("u"), F.transform("p", lambda t: score(t)).alias("s"), F.transform("p", rest).alias("l"))
    return x.join(R.records(spark, d, "run_id", "query_id", "system_name", "seed"), "record_id")


def judged(f: DataFrame, tau=TAU) -> DataFrame:
    """Counts per claim at a threshold: citations, those that aren't irrelevant, and whether the union entails the claim.

    A citation is irrelevant if it fails alone while the others, if any, suffice.
    """
    t = tau if not isinstance(tau, float) else F.lit(tau)
    n = F.size("s")
    bad = F.size(F.filter(F.arrays_zip("s", "l"), lambda z: (z["s"] < t) & (n > 1) & (z["l"] >= t)))
    return f.withColumns({"n_cited": n.cast("bigint"), "n_good": (n - bad).cast("bigint"), "recalled": ((n > 0) & (F.col("u") >= t)).cast("bigint"), "answered": (~F.col("abstains")).cast("bigint")})


def scores_by(j: DataFrame, *by: str) -> DataFrame:
    """Micro precision over citations, recall over answered claims and over all, and both F1; 0 where a denominator is 0."""
    g = j.groupBy(*by).agg(F.count(F.lit(1)).alias("n_claims"), F.sum("n_cited").alias("n_citations"), F.sum("n_good").alias("n_good"), F.sum("answered").alias("n_answered"), F.sum(F.col("recalled") * F.col("answered")).alias("n_recalled"), F.sum("recalled").alias("n_recalled_all"))
    p, r, ra = ratio(F.col("n_good"), F.col("n_citations")), ratio(F.col("n_recalled"), F.col("n_answered")), ratio(F.col("n_recalled_all"), F.col("n_claims"))
    return g.select(*by, "n_claims", "n_citations", "n_good", "n_answered", "n_recalled", r6(p, "precision"), r6(r, "recall"), r6(ra, "recall_all"), r6(harmonic(p, r), "f1"), r6(harmonic(p, ra), "f1_all"))


def per_claim(spark: SparkSession, d: str) -> DataFrame:
    """Citation recall and precision of each claim; the precision of an uncited claim is null."""
    j = judged(facts(spark, d))
    return j.select("claim_key", F.col("recalled").alias("citation_recall"), r6(F.col("n_good") / F.nullif(F.col("n_cited"), F.lit(0)), "citation_precision"))


def phi_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The distinct (premise, hypothesis) pairs that scoring needs: unions, single spans, and the others without one."""
    c = R.claims(spark, d, "text").where("text is not null")
    g = span_texts(spark, d).where("span is not null").groupBy("claim_key").agg(F.array_sort(F.collect_list(F.struct("citation_index", "span"))).alias("g"))
    x = c.join(g, "claim_key").select("text", F.transform("g", lambda s: s["span"]).alias("p"))
    loo = F.transform("p", lambda _, i: F.array_join(F.filter("p", lambda __, j: j != i), " "))
    every = F.concat(F.array(F.array_join("p", " ")), "p", F.when(F.size("p") > 1, loo).otherwise(F.array().cast("array<string>")))
    return x.select(F.explode(every).alias("premise"), "text").select(F.md5("premise").alias("premise_md5"), F.md5("text").alias("hypothesis_md5")).distinct()


def f1(spark: SparkSession, d: str) -> DataFrame:
    """Citation scores per system."""
    return scores_by(judged(facts(spark, d)), "system_name")


def tau_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The same at five thresholds, without scoring again."""
    f = facts(spark, d).withColumn("tau", F.explode(F.array(*[F.lit(t) for t in TAUS])))
    return scores_by(judged(f, F.col("tau")), "system_name", "tau")


def recall_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Citation recall by system and band of claim length, all cells."""
    bands = ((0, 10), *LENGTH_BANDS[1:])
    j = judged(facts(spark, d)).withColumn("band", band(F.col("n_words"), bands)).where("band is not null").groupBy("system_name", "band").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("recalled"), "recall"))
    names = [f"{a}-{b}" if b else f"{a}+" for a, b in bands]
    cells = spark.createDataFrame([(s, b) for s in ("joint", "post_hoc", "vanilla") for b in names], "system_name string, band string")
    return cells.join(j, ["system_name", "band"], "left").select("system_name", "band", F.coalesce("n", F.lit(0)).alias("n"), "recall")


def pairing(spark: SparkSession, d: str) -> DataFrame:
    """Joint and post_hoc records of one run, query and seed, paired, with the first reason that excludes a pair."""
    n = R.claims(spark, d, "record_id").groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    r = R.records(spark, d, "run_id", "query_id", "seed", "system_name", "raw_generation").join(n, "record_id", "left")
    bad = (F.coalesce(F.trim("raw_generation"), F.lit("")) == "") & F.col("n").isNull()
    g = r.groupBy("run_id", "query_id", "seed", "system_name").agg(F.max(F.coalesce("n", F.lit(0))).alias("n"), F.min(bad).alias("bad"))
    key = ["run_id", "query_id", "seed"]
    a = g.where("system_name = 'joint'").select(*key, F.col("n").alias("nj"), F.col("bad").alias("bj"))
    b = g.where("system_name = 'post_hoc'").select(*key, F.col("n").alias("np"), F.col("bad").alias("bp"))
    x = a.join(b, key, "full_outer")
    why = F.when(F.col("nj").isNull(), "missing joint").when(F.col("np").isNull(), "missing post_hoc").when(F.col("bj"), "rejected joint").when(F.col("bp"), "rejected post_hoc").when(F.col("nj") == 0, "no claims joint").when(F.col("np") == 0, "no claims post_hoc").otherwise("paired")
    return x.groupBy(why.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def contrast(spark: SparkSession, d: str, n_boot: int = 10_000, seed: int = 5) -> DataFrame:
    """F1 of joint minus post_hoc over the queries of both, with the query-clustered interval.

    Each query is reduced to its four sums per system before it is resampled.
    """
    cols = ("n_good", "n_cited", "recalled", "answered")
    j = judged(facts(spark, d)).where("system_name in ('joint', 'post_hoc')").withColumn("recalled", F.col("recalled") * F.col("answered"))
    q = j.groupBy("query_id").agg(*[F.sum(F.when(F.col("system_name") == s, F.col(c))).alias(f"{c}_{s}") for s in ("joint", "post_hoc") for c in cols]).where("n_cited_joint is not null and n_cited_post_hoc is not null")
    stats = spool(A._indexed(q, "query_id"), "contrast")

    def delta(x: DataFrame, *by: str) -> DataFrame:
        s = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"{c}_{s}").alias(f"{c}_{s}") for s in ("joint", "post_hoc") for c in cols])
        f = {s: harmonic(ratio(F.col(f"n_good_{s}"), F.col(f"n_cited_{s}")), ratio(F.col(f"recalled_{s}"), F.col(f"answered_{s}"))) for s in ("joint", "post_hoc")}
        return s.select(*by, "n", f["joint"].alias("fj"), f["post_hoc"].alias("fp"), (f["joint"] - f["post_hoc"]).alias("delta"))

    point = delta(stats)
    reps = delta(A.draws(spark, stats, n_boot, seed).join(stats, "idx"), "replicate").agg(F.round(F.percentile("delta", F.lit(0.025)), 5).alias("lower"), F.round(F.percentile("delta", F.lit(0.975)), 5).alias("upper"))
    return point.crossJoin(reps).select(F.col("n").alias("n_queries"), F.round("fj", 5).alias("f1_joint"), F.round("fp", 5).alias("f1_post_hoc"), F.round("delta", 5).alias("delta"), "lower", "upper", ((F.col("lower") > 0) | (F.col("upper") < 0)).alias("excludes_zero"))


QUERIES = {
    "fn16_span_texts": lambda s, d: span_texts(s, d).select("claim_key", "citation_index", F.md5("span").alias("span_md5")),
    "sc6_per_claim": per_claim,
    "sc7_phi_pairs": phi_pairs,
    "agg10_citation_f1": f1,
    "agg22_recall_by_length": recall_by_length,
    "jn6_pairing": pairing,
    "sc22_contrast": contrast,
    "sc23_tau_sweep": tau_sweep,
}

_ABST = "(coalesce(len(citations), 0) = 0 AND regexp_matches(text, '{0}') AND regexp_matches(text, '{1}'))"
from .claim_metrics import INCAPACITY, SOURCE  # noqa: E402

_TOK = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'))"
_SCORE = "round(coalesce(len(list_intersect(h, {0})) / nullif(len(h), 0), 0), 6)"
_PRE = rf"""WITH r AS (SELECT DISTINCT ON (record_id) * FROM query_records), c AS (SELECT DISTINCT ON (claim_key) * FROM claims),
p AS (SELECT passage_id, arg_min(text, chunk_id) AS text FROM chunks WHERE passage_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
ci AS (SELECT claim_key, i - 1 AS citation_index, citations[i].passage_id AS passage_id, citations[i].char_start AS cs, citations[i].char_end AS ce, citations[i].quoted_text AS qt FROM (SELECT claim_key, citations, unnest(range(1, len(citations) + 1)) AS i FROM c)),
sp AS (SELECT claim_key, citation_index, coalesce(CASE WHEN ce >= cs THEN substr(text, cs + 1, ce - cs) END, qt) AS span FROM ci LEFT JOIN p USING (passage_id)),
sg AS (SELECT claim_key, list({_TOK.format("coalesce(span, '')")} ORDER BY citation_index) AS p FROM sp GROUP BY 1),
f0 AS (SELECT c.claim_key, record_id, {_ABST.format(INCAPACITY, SOURCE)} AS abstains, len(regexp_extract_all(text, '[^\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+')) AS n_words, {_TOK.format('text')} AS h, coalesce(p, []) AS p FROM c LEFT JOIN sg USING (claim_key) WHERE text IS NOT NULL),
f AS (SELECT f0.*, query_id, system_name, {_SCORE.format('flatten(p)')} AS u, list_transform(p, lambda t: {_SCORE.format('t')}) AS s, list_transform(p, lambda t, i: {_SCORE.format('flatten(list_filter(p, lambda y, j: j <> i))')}) AS l FROM f0 JOIN r USING (record_id))"""


def _j(tau: str, src: str = "f") -> str:
    return f"(SELECT *, len(s) AS n_cited, len(s) - len(list_filter(range(1, len(s) + 1), lambda i: s[i] < {tau} AND len(s) > 1 AND l[i] >= {tau})) AS n_good, (len(s) > 0 AND u >= {tau})::INT AS recalled, (NOT abstains)::INT AS answered FROM {src})"


def _by(src: str, by: str) -> str:
    return f"""SELECT {by}, n_claims, n_citations, n_good, n_answered, n_recalled, round(p, 6) AS precision, round(rc, 6) AS recall, round(ra, 6) AS recall_all, round(coalesce(2 * p * rc / nullif(p + rc, 0), 0), 6) AS f1, round(coalesce(2 * p * ra / nullif(p + ra, 0), 0), 6) AS f1_all FROM (
SELECT *, coalesce(n_good / nullif(n_citations, 0), 0) AS p, coalesce(n_recalled / nullif(n_answered, 0), 0) AS rc, coalesce(na / nullif(n_claims, 0), 0) AS ra FROM (SELECT {by}, count(*) AS n_claims, sum(n_cited)::BIGINT AS n_citations, sum(n_good)::BIGINT AS n_good, sum(answered)::BIGINT AS n_answered, sum(recalled * answered)::BIGINT AS n_recalled, sum(recalled)::BIGINT AS na FROM {src} GROUP BY {by}))"""


def _f1(s: str, x: str = "") -> str:
    p, r = f"coalesce(sum({x}g{s}) / nullif(sum({x}c{s}), 0), 0)", f"coalesce(sum({x}r{s}) / nullif(sum({x}a{s}), 0), 0)"
    return f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"


_QS = "(SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS idx FROM (SELECT query_id, " + ", ".join(f"sum({c}) FILTER (system_name = '{n}') AS {k}{s}" for s, n in (("j", "joint"), ("p", "post_hoc")) for k, c in (("g", "n_good"), ("c", "n_cited"), ("r", "recalled * answered"), ("a", "answered"))) + f" FROM {_j('0.3')} WHERE system_name IN ('joint', 'post_hoc') GROUP BY 1) WHERE cj IS NOT NULL AND cp IS NOT NULL)"
_BAND = "CASE WHEN n_words BETWEEN 0 AND 10 THEN '0-10' WHEN n_words <= 15 THEN '11-15' WHEN n_words <= 20 THEN '16-20' WHEN n_words <= 30 THEN '21-30' ELSE '31+' END"

SQL = {
    "fn16_span_texts": _PRE + "SELECT claim_key, citation_index, md5(span) AS span_md5 FROM sp",
    "sc6_per_claim": _PRE + f"SELECT claim_key, recalled::BIGINT AS citation_recall, round(n_good / nullif(n_cited, 0), 6) AS citation_precision FROM {_j('0.3')}",
    "sc7_phi_pairs": _PRE + ", g AS (SELECT text, list(span ORDER BY citation_index) AS p FROM sp JOIN c USING (claim_key) WHERE span IS NOT NULL AND text IS NOT NULL GROUP BY claim_key, text) SELECT DISTINCT md5(x) AS premise_md5, md5(text) AS hypothesis_md5 FROM (SELECT text, unnest(list_concat([array_to_string(p, ' ')], p, CASE WHEN len(p) > 1 THEN list_transform(p, lambda y, i: array_to_string(list_filter(p, lambda z, j: j <> i), ' ')) ELSE [] END)) AS x FROM g)",
    "agg10_citation_f1": _PRE + _by(_j("0.3"), "system_name"),
    "agg22_recall_by_length": _PRE + f", j AS (SELECT system_name, {_BAND} AS band, count(*) AS n, round(avg(recalled), 6) AS recall FROM {_j('0.3')} GROUP BY 1, 2) SELECT system_name, band, coalesce(n, 0) AS n, recall FROM (SELECT unnest(['joint', 'post_hoc', 'vanilla']) AS system_name) CROSS JOIN (SELECT unnest(['0-10', '11-15', '16-20', '21-30', '31+']) AS band) LEFT JOIN j USING (system_name, band)",
    "jn6_pairing": _PRE + ", n AS (SELECT record_id, count(*) AS n FROM c GROUP BY 1), g AS (SELECT run_id, query_id, seed, system_name, max(coalesce(n, 0)) AS n, bool_and(coalesce(trim(raw_generation, ' '), '') = '' AND n IS NULL) AS bad FROM r LEFT JOIN n USING (record_id) GROUP BY ALL) SELECT CASE WHEN a.n IS NULL THEN 'missing joint' WHEN b.n IS NULL THEN 'missing post_hoc' WHEN a.bad THEN 'rejected joint' WHEN b.bad THEN 'rejected post_hoc' WHEN a.n = 0 THEN 'no claims joint' WHEN b.n = 0 THEN 'no claims post_hoc' ELSE 'paired' END AS outcome, count(*) AS n FROM (SELECT * FROM g WHERE system_name = 'joint') a FULL JOIN (SELECT * FROM g WHERE system_name = 'post_hoc') b ON a.run_id = b.run_id AND a.query_id = b.query_id AND a.seed = b.seed GROUP BY 1",
    "sc22_contrast": _PRE + f", q AS {_QS} SELECT *, lower > 0 OR upper < 0 AS excludes_zero FROM (SELECT count(*) AS n_queries, round({_f1('j')}, 5) AS f1_joint, round({_f1('p')}, 5) AS f1_post_hoc, round({_f1('j')} - {_f1('p')}, 5) AS delta FROM q), (SELECT round(quantile_cont(d, 0.025), 5) AS lower, round(quantile_cont(d, 0.975), 5) AS upper FROM (SELECT replicate, {_f1('j')} - {_f1('p')} AS d FROM (SELECT replicate, ('0x' || substr(md5('5:' || replicate || ':' || pos), 1, 8))::BIGINT % nc AS idx FROM (SELECT count(*) AS nc FROM q), (SELECT unnest(range(0, 10000)) AS replicate), LATERAL (SELECT unnest(range(0, nc)) AS pos)) JOIN q USING (idx) GROUP BY 1))",
    "sc23_tau_sweep": _PRE + _by(_j("tau", "(SELECT *, unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS tau FROM f)"), "system_name, tau"),
}
