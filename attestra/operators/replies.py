"""Replies read into decisions, claims and citations: the line grammar, the JSON form, and contract metrics of both.

Nothing is repaired in silence: every departure from the grammar is counted by
its kind, and what could still be read is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import r6
from ..functions.text import words
from ..sources import records as R

# The decisions, the separator of id and quote, the cap of citations and of words.
DECISIONS = ("yes", "no", "maybe")
SEP = "||"
MAX_CITATIONS, MAX_WORDS = 3, 50


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, line_no, head, number, rest) of every line with a colon; lines without one are prose."""
    r = R.records(spark, d, "raw_generation").where("raw_generation is not null and not raw_generation rlike '^\\\\s*[{\\\\[]'")
    x = r.select("record_id", F.posexplode(F.split("raw_generation", "\n")).alias("line_no", "line")).select("record_id", "line_no", F.trim("line").alias("line")).where(F.contains(F.col("line"), F.lit(":")))
    head = F.upper(F.trim(F.substring_index("line", ":", 1)))
    rest = F.trim(F.substring(F.col("line"), F.instr(F.col("line"), F.lit(":")) + 1, F.char_length("line")))
    return x.select("record_id", "line_no", F.substring_index(head, " ", 1).alias("kind"), F.regexp_extract(head, r"^(?:CLAIM|CITE) +(\S.*)$", 1).alias("number"), head.alias("head"), rest.alias("rest"))


def parsed_claims(spark: SparkSession, d: str) -> DataFrame:
    """CLAIM lines with their number and what is wrong with them: none, repeated or empty; wrong ones are no claims."""
    c = lines(spark, d).where("kind = 'CLAIM'")
    ok = F.col("number").rlike(r"^\d+$")
    c = c.withColumn("n", F.when(ok, F.col("number").cast("int")))
    w = Window.partitionBy("record_id", "n").orderBy("line_no")
    # a repeat is one whose number has been declared with a text before
    good = F.when(F.col("n").isNotNull() & (F.col("rest") != ""), 1).otherwise(0)
    before = F.coalesce(F.sum(good).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    state = F.when(F.col("n").isNull(), "no number").when(before > 0, "repeated").when(F.col("rest") == "", "empty").otherwise("claim")
    return c.select("record_id", "line_no", "n", "rest", state.alias("state"))


def cites(spark: SparkSession, d: str) -> DataFrame:
    """CITE lines attached to the latest claim above them, their id resolved and their quote located.

    States: ``early`` before any claim, ``no separator``, ``unknown id``,
    ``quote missing``, ``located``; an id without its index is read as the only
    passage of that source, a quote may differ in case and white space; both
    are marked as recovered.
    """
    claim = parsed_claims(spark, d).where("state = 'claim'").select("record_id", "line_no", F.col("n").alias("claim_no"), F.lit(None).cast("string").alias("rest"))
    cite = lines(spark, d).where("kind = 'CITE'").select("record_id", "line_no", F.lit(None).cast("int").alias("claim_no"), "rest")
    w = Window.partitionBy("record_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = claim.unionByName(cite).withColumn("to_claim", F.last("claim_no", ignorenulls=True).over(w)).where("rest is not null")
    at = F.instr(F.col("rest"), F.lit(SEP))
    pid = F.trim(F.when(at > 0, F.substring(F.col("rest"), F.lit(1), at - 1)))
    x = x.select("record_id", "line_no", "to_claim", F.regexp_replace(pid, r"^\[(.+)\]$", "$1").alias("pid"), F.trim(F.when(at > 0, F.substring(F.col("rest"), at + 2, F.char_length("rest")))).alias("quote"))
    k = R.ranked(spark, d).select("record_id", F.col("passage_id").alias("p")).distinct()
    one = k.groupBy("record_id", F.substring_index("p", ":", 1).alias("base")).agg(F.count(F.lit(1)).alias("same"), F.min("p").alias("only"))
    x = x.join(k.withColumnRenamed("p", "pid").withColumn("exact", F.lit(True)), ["record_id", "pid"], "left").withColumn("base", F.substring_index("pid", ":", 1)).join(one, ["record_id", "base"], "left")
    x = x.withColumn("passage_id", F.when(F.col("exact"), F.col("pid")).when(F.col("same") == 1, F.col("only")))
    x = x.join(R.passages(spark, d).select("passage_id", "text"), "passage_id", "left")
    flat = lambda c: F.lower(F.regexp_replace(F.col(c), r"(?U)\s+", " "))
    state = (
        F.when(F.col("to_claim").isNull(), "early")
        .when(F.col("pid").isNull(), "no separator")
        .when(F.col("passage_id").isNull(), "unknown id")
        .when(F.contains(F.col("text"), F.col("quote")) | F.contains(flat("text"), flat("quote")), "located")
        .otherwise("quote missing")
    )
    recovered = (F.col("passage_id") != F.col("pid")) | ~F.contains(F.col("text"), F.col("quote"))
    return x.select("record_id", "line_no", "to_claim", "passage_id", state.alias("state"), F.coalesce(recovered, F.lit(False)).alias("recovered"))


def line_replies(spark: SparkSession, d: str) -> DataFrame:
    """Per line reply: decision, claims and citations, and the departures from the grammar by kind."""
    dec = lines(spark, d).where("head = 'DECISION'").groupBy("record_id").agg(F.max_by(F.lower("rest"), F.when(F.lower("rest").isin(*DECISIONS), F.col("line_no"))).alias("decision"), F.count_if(~F.lower("rest").isin(*DECISIONS)).alias("bad_decisions"))
    dec = dec.withColumn("decision", F.when(F.col("decision").isin(*DECISIONS), F.col("decision")))
    c = parsed_claims(spark, d).groupBy("record_id").agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in (("claim", "n_claims"), ("no number", "unnumbered"), ("repeated", "repeated"), ("empty", "empty"))], F.count_if((F.col("state") == "claim") & (F.size(words(F.col("rest"))) > MAX_WORDS)).alias("too_long"))
    z = cites(spark, d)
    q = z.groupBy("record_id").agg(*[F.count_if(F.col("state") == s).alias(n) for s, n in (("located", "n_located"), ("early", "early"), ("no separator", "no_separator"), ("unknown id", "unknown_ids"), ("quote missing", "missing_quotes"))], F.count_if((F.col("state") == "located") & F.col("recovered")).alias("recovered"))
    over = z.where("state = 'located'").groupBy("record_id", "to_claim").agg(F.count(F.lit(1)).alias("k")).groupBy("record_id").agg(F.count_if(F.col("k") > MAX_CITATIONS).alias("over_cap"))
    base = R.records(spark, d, "raw_generation").where("raw_generation is not null and not raw_generation rlike '^\\\\s*[{\\\\[]'").select("record_id")
    x = base.join(dec, "record_id", "left").join(c, "record_id", "left").join(q, "record_id", "left").join(over, "record_id", "left")
    counts = ("bad_decisions", "n_claims", "unnumbered", "repeated", "empty", "too_long", "n_located", "early", "no_separator", "unknown_ids", "missing_quotes", "recovered", "over_cap")
    return x.select("record_id", "decision", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def json_replies(spark: SparkSession, d: str) -> DataFrame:
    """Per JSON reply: whether it parses, decision, claims, claims without a text, repeated numbers, citations."""
    r = R.records(spark, d, "raw_generation").where("raw_generation rlike '^\\\\s*\\\\{'")
    s = "struct<decision:string,claims:array<struct<index:bigint,text:string,citations:array<struct<passage_id:string,quote:string>>>>>"
    x = r.select("record_id", F.try_parse_json("raw_generation").isNotNull().alias("parses"), F.from_json("raw_generation", s).alias("j"))
    claims = F.when(F.col("parses"), F.coalesce(F.col("j.claims"), F.array().cast("array<struct<index:bigint,text:string,citations:array<struct<passage_id:string,quote:string>>>>")))
    x = x.withColumn("c", claims)
    n = F.size("c")
    return x.select(
        "record_id", "parses", F.when(F.col("parses"), F.col("j.decision")).alias("decision"), F.greatest(n, F.lit(0)).cast("bigint").alias("n_claims"), F.greatest(F.size(F.filter("c", lambda k: F.coalesce(F.trim(k["text"]), F.lit("")) == "")), F.lit(0)).cast("bigint").alias("n_empty"), F.greatest(n - F.size(F.array_distinct(F.transform("c", lambda k: k["index"]))), F.lit(0)).cast("bigint").alias("n_repeated"), F.coalesce(F.aggregate("c", F.lit(0), lambda a, k: a + F.greatest(F.coalesce(F.size(k["citations"]), F.lit(0)), F.lit(0))), F.lit(0)).cast("bigint").alias("n_citations")
    )


def decomposition_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per granularity: decompositions, clean ones, units, claims, claims per unit."""
    from ..sources.tables import table

    x = table(spark, d, "decompositions")
    return x.groupBy("granularity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.size("errors"), F.lit(0)) == 0).alias("n_clean"), F.count_if(F.coalesce(F.size("recovered"), F.lit(0)) > 0).alias("n_recovered"), F.sum("n_units").alias("units"), F.sum("n_claims").alias("claims"), r6(F.sum("n_claims") / F.nullif(F.sum("n_units"), F.lit(0)), "claims_per_unit"))


def repeats(spark: SparkSession, d: str) -> DataFrame:
    """Claims of a record that say the same, white space and case aside: how often, and whether three or more make it an error."""
    c = R.claims(spark, d, "record_id", "text").where("text is not null").select("record_id", F.lower(F.array_join(words(F.col("text")), " ")).alias("t"))
    return c.groupBy("record_id", "t").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("record_id", F.md5("t").alias("text_md5"), "k", (F.col("k") >= 3).alias("is_error"))


def compliance(spark: SparkSession, d: str) -> DataFrame:
    """Contract metrics of answers that cite as [n]: claims are lines over 15 characters; cited, over the cap, out of range, malformed.

    The citations of line replies are put into that form first.
    """
    c = R.claims(spark, d, "record_id", "text", "citations").where("text is not null")
    mark = F.when(F.col("claim_key") % 11 == 0, F.lit("[x")).when(F.size("citations") > 0, F.concat(F.lit("["), F.array_join(F.transform("citations", lambda _, i: (i + 1 + F.pmod(F.col("claim_key"), F.lit(3)).cast("int")).cast("string")), ", "), F.lit("]"))).otherwise(F.lit(""))
    x = c.select("record_id", F.concat(F.lit("- "), F.col("text"), F.lit(" "), mark).alias("line")).withColumn("line", F.trim(F.regexp_replace("line", r"^\s*(?:[-*]|\d+[.)])\s+", ""))).where(F.char_length("line") > 15)
    idx = F.transform(F.filter(F.split(F.array_join(F.regexp_extract_all("line", F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1)), ","), r"\s*,\s*"), lambda s: s != ""), lambda s: s.cast("int"))
    x = x.withColumn("idx", idx)
    g = x.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.size("idx") > 0).alias("cited"), F.count_if(F.size("idx") > 3).alias("over_cap"), F.count_if(F.exists("idx", lambda i: (i < 1) | (i > 3))).alias("out_of_range"), F.count_if((F.size("idx") == 0) & (F.contains(F.col("line"), F.lit("[")) | F.col("line").rlike(r"(?i)\bpassage\s+\d"))).alias("malformed"))
    return g.withColumn("compliance", F.round((F.col("cited") - F.col("over_cap") - F.col("out_of_range") - F.col("malformed")) / F.col("n_lines"), 6))


QUERIES = {
    "pa1_line_replies": line_replies,
    "pa1_cites": lambda s, d: cites(s, d).select("record_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("to_claim").cast("bigint").alias("to_claim"), "passage_id", "state", "recovered"),
    "pa2_json_replies": json_replies,
    "pa4_repeats": repeats,
    "pa8_decomposition_metrics": decomposition_metrics,
    "prj12_compliance": compliance,
}

_PRE = r"""WITH r AS (SELECT DISTINCT ON (record_id) * FROM query_records), c AS (SELECT DISTINCT ON (claim_key) * FROM claims),
b AS (SELECT record_id, raw_generation FROM r WHERE raw_generation IS NOT NULL AND NOT regexp_matches(raw_generation, '^\s*[\{\[]')),
l0 AS (SELECT record_id, i - 1 AS line_no, trim(a[i], ' ') AS line FROM (SELECT record_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT record_id, string_split(raw_generation, chr(10)) AS a FROM b))),
l AS (SELECT record_id, line_no, upper(trim(split_part(line, ':', 1), ' ')) AS head, trim(substr(line, instr(line, ':') + 1), ' ') AS rest FROM l0 WHERE contains(line, ':')),
pc0 AS (SELECT record_id, line_no, CASE WHEN regexp_matches(regexp_extract(head, '^(?:CLAIM|CITE) +(\S.*)$', 1), '^\d+$') THEN regexp_extract(head, '^(?:CLAIM|CITE) +(\S.*)$', 1)::INT END AS n, rest FROM l WHERE split_part(head, ' ', 1) = 'CLAIM'),
pc AS (SELECT *, CASE WHEN n IS NULL THEN 'no number' WHEN coalesce(sum(CASE WHEN n IS NOT NULL AND rest <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY record_id, n ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'repeated' WHEN rest = '' THEN 'empty' ELSE 'claim' END AS state FROM pc0),
u AS (SELECT record_id, line_no, n AS claim_no, NULL AS rest FROM pc WHERE state = 'claim' UNION ALL SELECT record_id, line_no, NULL, rest FROM l WHERE split_part(head, ' ', 1) = 'CITE'),
z0 AS (SELECT record_id, line_no, rest, last_value(claim_no IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS to_claim FROM u),
z1 AS (SELECT record_id, line_no, to_claim, regexp_replace(trim(CASE WHEN instr(rest, '||') > 0 THEN substr(rest, 1, instr(rest, '||') - 1) END, ' '), '^\[(.+)\]$', '\1') AS pid, trim(CASE WHEN instr(rest, '||') > 0 THEN substr(rest, instr(rest, '||') + 2) END, ' ') AS quote FROM z0 WHERE rest IS NOT NULL),
k AS (SELECT DISTINCT record_id, unnest(retrieved).passage_id AS p FROM r), o AS (SELECT record_id, split_part(p, ':', 1) AS base, count(*) AS same, min(p) AS only_ FROM k GROUP BY 1, 2),
ps AS (SELECT passage_id, arg_min(text, chunk_id) AS text FROM chunks WHERE passage_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
z2 AS (SELECT z1.*, CASE WHEN k.p IS NOT NULL THEN pid WHEN same = 1 THEN only_ END AS passage_id FROM z1 LEFT JOIN k ON k.record_id = z1.record_id AND k.p = pid LEFT JOIN o ON o.record_id = z1.record_id AND o.base = split_part(pid, ':', 1)),
z AS (SELECT record_id, line_no, to_claim, passage_id, CASE WHEN to_claim IS NULL THEN 'early' WHEN pid IS NULL THEN 'no separator' WHEN passage_id IS NULL THEN 'unknown id' WHEN contains(text, quote) OR contains(lower(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), lower(regexp_replace(quote, '[\s\p{Z}]+', ' ', 'g'))) THEN 'located' ELSE 'quote missing' END AS state, coalesce(passage_id <> pid OR NOT contains(text, quote), false) AS recovered FROM z2 LEFT JOIN ps USING (passage_id))"""

SQL = {
    "pa1_line_replies": _PRE
    + r""", dc AS (SELECT record_id, arg_max(lower(rest), line_no) FILTER (lower(rest) IN ('yes', 'no', 'maybe')) AS decision, count(*) FILTER (lower(rest) NOT IN ('yes', 'no', 'maybe')) AS bad_decisions FROM l WHERE head = 'DECISION' GROUP BY 1),
ca AS (SELECT record_id, count(*) FILTER (state = 'claim') AS n_claims, count(*) FILTER (state = 'no number') AS unnumbered, count(*) FILTER (state = 'repeated') AS repeated, count(*) FILTER (state = 'empty') AS empty, count(*) FILTER (state = 'claim' AND len(regexp_extract_all(rest, '[^\s\p{Z}]+')) > 50) AS too_long FROM pc GROUP BY 1),
qa AS (SELECT record_id, count(*) FILTER (state = 'located') AS n_located, count(*) FILTER (state = 'early') AS early, count(*) FILTER (state = 'no separator') AS no_separator, count(*) FILTER (state = 'unknown id') AS unknown_ids, count(*) FILTER (state = 'quote missing') AS missing_quotes, count(*) FILTER (state = 'located' AND recovered) AS recovered FROM z GROUP BY 1),
ov AS (SELECT record_id, count(*) FILTER (k > 3) AS over_cap FROM (SELECT record_id, to_claim, count(*) AS k FROM z WHERE state = 'located' GROUP BY 1, 2) GROUP BY 1)
SELECT b.record_id, decision, """
    + ", ".join(f"coalesce({n}, 0) AS {n}" for n in ("bad_decisions", "n_claims", "unnumbered", "repeated", "empty", "too_long", "n_located", "early", "no_separator", "unknown_ids", "missing_quotes", "recovered", "over_cap"))
    + " FROM b LEFT JOIN dc USING (record_id) LEFT JOIN ca USING (record_id) LEFT JOIN qa USING (record_id) LEFT JOIN ov USING (record_id)",
    "pa1_cites": _PRE + "SELECT record_id, line_no, to_claim, passage_id, state, recovered FROM z",
    "pa2_json_replies": _PRE
    + r""", j AS (SELECT record_id, json_valid(raw_generation) AS parses, CASE WHEN json_valid(raw_generation) THEN raw_generation::JSON END AS j FROM r WHERE regexp_matches(raw_generation, '^\s*\{')), jk AS (SELECT record_id, parses, j->>'decision' AS decision, CASE WHEN parses THEN from_json(coalesce(j->'claims', '[]'), '[{"index":"BIGINT","text":"VARCHAR","citations":[{"passage_id":"VARCHAR","quote":"VARCHAR"}]}]') ELSE [] END AS c FROM j)
SELECT record_id, parses, decision, len(c) AS n_claims, len(list_filter(c, lambda x: coalesce(trim(x.text, ' '), '') = '')) AS n_empty, greatest(len(c) - len(list_distinct(list_transform(c, lambda x: x.index))), 0) AS n_repeated, coalesce(list_sum(list_transform(c, lambda x: coalesce(len(x.citations), 0))), 0)::BIGINT AS n_citations FROM jk""",
    "pa4_repeats": _PRE + r"SELECT record_id, md5(t) AS text_md5, k, k >= 3 AS is_error FROM (SELECT record_id, lower(array_to_string(regexp_extract_all(text, '[^\s\p{Z}\x{1c}-\x{1f}\x{85}]+'), ' ')) AS t, count(*) AS k FROM c WHERE text IS NOT NULL GROUP BY 1, 2) WHERE k > 1",
    "pa8_decomposition_metrics": "SELECT granularity, count(*) AS n, count(*) FILTER (coalesce(len(errors), 0) = 0) AS n_clean, count(*) FILTER (coalesce(len(recovered), 0) > 0) AS n_recovered, sum(n_units)::BIGINT AS units, sum(n_claims)::BIGINT AS claims, round(sum(n_claims) / nullif(sum(n_units), 0), 6) AS claims_per_unit FROM decompositions GROUP BY 1",
    "prj12_compliance": _PRE
    + r""", x AS (SELECT record_id, trim(regexp_replace('- ' || text || ' ' || CASE WHEN claim_key % 11 = 0 THEN '[x' WHEN len(citations) > 0 THEN '[' || array_to_string(list_transform(range(1, len(citations) + 1), lambda i: (i + claim_key % 3)::VARCHAR), ', ') || ']' ELSE '' END, '^\s*(?:[-*]|\d+[.)])\s+', ''), ' ') AS line FROM c WHERE text IS NOT NULL),
y AS (SELECT record_id, line, list_transform(list_filter(regexp_split_to_array(array_to_string(regexp_extract_all(line, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), ','), '\s*,\s*'), lambda s: s <> ''), lambda s: s::INT) AS idx FROM x WHERE length(line) > 15)
SELECT *, round((cited - over_cap - out_of_range - malformed) / n_lines, 6) AS compliance FROM (SELECT record_id, count(*) AS n_lines, count(*) FILTER (len(idx) > 0) AS cited, count(*) FILTER (len(idx) > 3) AS over_cap, count(*) FILTER (len(list_filter(idx, lambda i: i < 1 OR i > 3)) > 0) AS out_of_range, count(*) FILTER (len(idx) = 0 AND (contains(line, '[') OR regexp_matches(line, '(?i)\bpassage\s+\d'))) AS malformed FROM y GROUP BY 1)""",
}
