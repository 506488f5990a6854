"""Quotes found in their passages, missed quotes by kind, and replies in stages and units."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import r6
from ..plans.durable import spool
from ..sources import records as R
from . import agreement as A
from .claim_metrics import words

# The quote marks that may enclose a quote, taken off in this order, and the marks at its edges.
QUOTE_MARKS = ('"', "'", "“", "”", "‘", "’")
EDGE_MARKS = " \t\r\n.,;:!?"
# Characters that a run of a quote must share with its passage not to be made up, and that part two spliced runs.
LEAST_BLOCK, SPLICE_GAP = 24, 12


def unquoted(quote: Column) -> Column:
    """A quote without outer white space and each kind of enclosing mark once."""
    outer = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    q = outer(quote)
    for mark in QUOTE_MARKS:
        closed = lambda x, m=mark: (F.char_length(x) > 1) & F.startswith(x, F.lit(m)) & F.endswith(x, F.lit(m))
        # the step before is bound once, not written out wherever it is used
        q = F.get(F.transform(F.array(q), lambda x: F.when(closed(x), outer(F.substring(x, F.lit(2), F.char_length(x) - 2))).otherwise(x)), F.lit(0))
    return q


def _pattern(q: Column, flags: str = "") -> Column:
    """The words of a quote in order, any white space between them; null for none."""
    ws = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    return F.when(F.size(ws) > 0, F.concat(F.lit(flags), F.array_join(F.transform(ws, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), r"\s+")))


def locate(df: DataFrame, quote: str, text: str) -> DataFrame:
    """``df`` with tier, span_start, span_end and span_text: where the passage really has the quote.

    Tiers: 1 exact; 2 other white space; 3 other case as well; 4 and 5 the same
    without marks at the edges; null where no tier finds it, or either is null.
    An empty quote is found at 0. The text is the passage's own; offsets are
    0-based code points. Patterns are tried only on what tier 1 doesn't find.
    """
    x = df.withColumn("_q", unquoted(F.col(quote)))
    edge = F.btrim("_q", F.lit(EDGE_MARKS))
    x = x.withColumn("_at", F.instr(F.col(text), F.col("_q")))
    miss = F.col("_at") == 0
    tried = [F.when(miss, F.regexp_substr(F.col(text), p)) for p in (_pattern(F.col("_q")), _pattern(F.col("_q"), "(?i)"), _pattern(edge), _pattern(edge, "(?i)"))]
    x = x.withColumn("_s", F.array(*tried))
    tier = F.when(F.col("_at") > 0, 1).when(miss, F.coalesce(*[F.when(F.get("_s", F.lit(i)).isNotNull(), F.lit(i + 2)) for i in range(4)]))
    x = x.withColumn("tier", tier).withColumn("span_text", F.when(F.col("tier") == 1, F.col("_q")).otherwise(F.get("_s", F.col("tier") - 2)))
    start = F.instr(F.col(text), F.col("span_text")) - 1
    return x.withColumn("span_start", start).withColumn("span_end", F.col("span_start") + F.char_length("span_text")).drop("_q", "_at", "_s")


def located(spark: SparkSession, d: str) -> DataFrame:
    """Every citation with a quote and a known passage: the tier that finds the quote, and its span."""
    c = R.citations(spark, d).where("quoted_text is not null")
    x = locate(c.join(R.passages(spark, d).select("passage_id", "text"), "passage_id"), "quoted_text", "text")
    return x.select("claim_key", F.col("citation_index").cast("bigint").alias("citation_index"), F.col("tier").cast("bigint").alias("tier"), F.col("span_start").cast("bigint").alias("span_start"), F.col("span_end").cast("bigint").alias("span_end"), "span_text")


def miss_kind(quote: str, text: str) -> str:
    """Why a passage doesn't have a quote: case, fabricated, spliced, overrun or reworded."""
    q, t = " ".join(quote.split()), " ".join(text.split())
    if q.lower() in t.lower():
        return "case"
    blocks = [b for b in difflib.SequenceMatcher(None, q.lower(), t.lower(), autojunk=False).get_matching_blocks() if b.size]
    long = [b for b in blocks if b.size >= LEAST_BLOCK]
    if not long:
        return "fabricated"
    if any(y.b - (x.b + x.size) >= SPLICE_GAP and y.a - (x.a + x.size) < SPLICE_GAP for x, y in zip(long, long[1:])):
        return "spliced"
    first, last = long[0], long[-1]
    if first.a + len(q) - (last.a + last.size) >= SPLICE_GAP and (last.b + last.size >= len(t) - 1 or first.b <= 1):
        return "overrun"
    return "reworded"


def misses(spark: SparkSession, d: str) -> DataFrame:
    """(kind, n): the quotes that no tier finds, by what is wrong with them. Only these rows go through Python, in batches."""
    c = R.citations(spark, d).where("quoted_text is not null")
    x = locate(c.join(R.passages(spark, d).select("passage_id", "text"), "passage_id"), "quoted_text", "text").where("tier is null and text is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"kind": [miss_kind(q, t) for q, t in zip(pdf["quoted_text"], pdf["text"])]}, dtype=object)

    return x.select("quoted_text", "text").mapInPandas(run, "kind string").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Per query the passages of its joint, then post_hoc, then vanilla lists in the order in which they are first seen."""
    order = F.when(F.col("system_name") == "joint", 1).when(F.col("system_name") == "post_hoc", 2).otherwise(3)
    x = R.ranked(spark, d, "query_id", "system_name").where("passage_id is not null and query_id is not null")
    first = x.groupBy("query_id", "passage_id").agg(F.min(F.struct(order.alias("list_no"), F.col("rank_no"), F.col("record_id"))).alias("at"))
    # few lists per query hold few passages; a hot query has many records but no more distinct passages in its pool
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at.list_no", "at.rank_no", "at.record_id", "passage_id"))
    return first.select("query_id", "passage_id", place.cast("bigint").alias("place"))


def chosen_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that are the chosen one of their source: the longest text, then the smallest id."""
    c = R.passages(spark, d).select("source_id", "passage_id", F.char_length("text").alias("n"))
    best = c.groupBy("source_id").agg(F.min(F.struct(-F.col("n"), F.col("passage_id"))).alias("b")).select("source_id", F.col("b.passage_id").alias("passage_id"))
    return c.join(best, ["source_id", "passage_id"], "left_semi").select("source_id", "passage_id", F.col("n").cast("bigint").alias("n_chars"))


def gold_positions(spark: SparkSession, d: str) -> DataFrame:
    """Place of the first gold passage in the stored order of each list, and which of 1, 5, 10 and 20 it is within; null if none."""
    r = R.records(spark, d, "retrieved", "gold_passage_ids").where("size(gold_passage_ids) > 0")
    at = F.array_min(F.transform(F.filter(F.transform("retrieved", lambda p, i: F.struct(p["passage_id"].alias("p"), i.alias("i"))), lambda x: F.array_contains("gold_passage_ids", x["p"])), lambda x: x["i"] + 1))
    x = r.select("record_id", at.cast("bigint").alias("place"))
    return x.select("record_id", "place", *[F.coalesce(F.col("place") <= k, F.lit(False)).alias(f"within_{k}") for k in (1, 5, 10, 20)])


def gold_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Per record the retrieved passages crossed with the sentences of its gold passages: how many pairs, and how many share a source."""
    s = R.passages(spark, d).select("passage_id", "source_id")
    g = R.gold(spark, d).join(s, "passage_id").groupBy("record_id", "source_id").agg(F.count(F.lit(1)).alias("n_gold"))
    p = R.ranked(spark, d).select("record_id", "passage_id").distinct().join(s, "passage_id").groupBy("record_id", "source_id").agg(F.count(F.lit(1)).alias("n_found"))
    # pairs are counted by their factors, never listed
    same = p.join(g, ["record_id", "source_id"]).groupBy("record_id").agg(F.sum(F.col("n_found") * F.col("n_gold")).alias("same_source"))
    n = p.groupBy("record_id").agg(F.sum("n_found").alias("f")).join(g.groupBy("record_id").agg(F.sum("n_gold").alias("g")), "record_id")
    return n.join(same, "record_id", "left").select("record_id", (F.col("f") * F.col("g")).alias("n_pairs"), F.coalesce("same_source", F.lit(0)).alias("same_source"))


def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Per backend the seconds of its calls: rate, least and most per completion token, and what a million tokens would take."""
    r = R.records(spark, d, "backend", "latency_s", "completion_tokens").where("latency_s > 0 and not isnan(latency_s) and completion_tokens > 0")
    r = r.withColumn("s", F.round(F.col("latency_s"), 6).cast("decimal(20,6)")).withColumn("per", F.col("latency_s") / F.col("completion_tokens"))
    g = r.groupBy("backend").agg(F.count(F.lit(1)).alias("n"), F.sum("s").cast("double").alias("s"), F.sum("completion_tokens").alias("t"), F.min("per").alias("a"), F.max("per").alias("b"))
    return g.select("backend", "n", F.round(F.col("t") / F.col("s"), 3).alias("tokens_per_s"), r6(F.col("a"), "least_s"), r6(F.col("b"), "most_s"), F.round(1e6 * F.col("s") / F.col("t"), 1).alias("s_per_million"))


def trimmed(spark: SparkSession, d: str) -> DataFrame:
    """The first three gold ids of each record, in their order."""
    return R.records(spark, d, "gold_passage_ids").select("record_id", F.array_join(F.slice("gold_passage_ids", 1, 3), ",").alias("kept"))


def corpus_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of corpora by the number of documents aimed at, for one thousand times the tokens of each run's prompts."""
    # The names.
    n = F.col("target_n")
    name = F.when(n == 2_000_000, "pubmed-2m-v1").when(n == 1_000_000, "pubmed-1m-v1").otherwise(F.concat(F.lit("pubmed-"), F.floor(n / 1000).cast("string"), F.lit("k-v1")))
    sizes = R.records(spark, d, "run_id").groupBy("run_id").agg((F.count(F.lit(1)) * 20_000).alias("target_n"))
    return sizes.select("run_id", "target_n", name.alias("corpus_id"))


def median_gap(spark: SparkSession, d: str, draws: int = 4000, seed: int = 3) -> DataFrame:
    """Median words per claim of post_hoc over joint, less one, with the interval from resampled queries.

    Queries need records of both systems. Each is reduced to counts per system
    and number of words, which go to every task; a replicate adds up those of its draws. Replicates in
    which a system has no claim are left out; the ends are order statistics.
    """
    r = R.records(spark, d, "query_id", "system_name").where("query_id is not null and system_name in ('joint', 'post_hoc')")
    both = r.groupBy("query_id").agg(F.count_distinct("system_name").alias("k")).where("k = 2").select("query_id")
    c = R.claims(spark, d, "record_id", "text").where("text is not null").select("record_id", words(F.col("text")).cast("bigint").alias("w"))
    w = c.join(r, "record_id").join(both, "query_id").groupBy("query_id", "system_name", "w").agg(F.count(F.lit(1)).alias("n"))
    ids = A._indexed(both, "query_id")
    n = ids.agg(F.count(F.lit(1)).alias("n_queries"))
    kinds = F.when(F.col("system_name") == "joint", 0).otherwise(1)
    counts = spool(w.join(ids, "query_id").select("idx", kinds.alias("k"), "w", "n"), "words")
    size = n.first()["n_queries"]
    shared = spark.sparkContext.broadcast(A.packed(counts, "idx", "k", "w", "n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idx, kind, words_, times = shared.value
        values = np.unique(words_)
        idx, times, kind = idx.astype(np.int64), times.astype(np.float64), kind.astype(np.int64)
        code = np.searchsorted(values, words_) + kind * len(values)

        def middle(c: np.ndarray) -> float | None:
            upto = np.cumsum(c)
            if not len(upto) or upto[-1] == 0:
                return None
            return sum(float(values[np.searchsorted(upto, (upto[-1] + i) // 2)]) for i in (1, 2)) / 2

        for pdf in batches:
            out = []
            for r in pdf["id"].tolist():
                often = np.ones(size) if r < 0 else sum(np.bincount(i, minlength=size) for i in A.drawn(r, size, seed))
                # counts stay whole: a double holds them up to 2^53
                c = np.bincount(code, often[idx] * times, 2 * len(values)).astype(np.int64) if len(code) else np.zeros(0, dtype=np.int64)
                out.append((r, middle(c[: len(values)]), middle(c[len(values) :])))
            yield pd.DataFrame(out, columns=["replicate", "j", "p"]).astype({"replicate": "int64", "j": "float64", "p": "float64"})

    every = A.replicates(spark, draws).unionByName(spark.range(-1, 0))
    g = every.mapInPandas(run, "replicate bigint, j double, p double")
    g = g.where("j is not null and p is not null and not isnan(j) and not isnan(p)").select("replicate", ((F.col("p") - F.col("j")) / F.nullif("j", F.lit(0.0))).alias("gap"))
    # draws are a parameter, so their gaps are few
    sorted_gaps = F.array_sort(F.collect_list(F.when(F.col("replicate") >= 0, F.col("gap"))))
    s = g.agg(sorted_gaps.alias("s"), F.max(F.when(F.col("replicate") < 0, F.col("gap"))).alias("point"))
    k = F.size("s")
    end = lambda q: F.get("s", F.least(F.floor(k * F.lit(q)), k - 1).cast("int"))
    return s.crossJoin(n).select("n_queries", k.cast("bigint").alias("draws"), F.round("point", 6).alias("point"), F.round(end(0.025), 6).alias("lower"), F.round(end(0.975), 6).alias("upper"))


QUERIES = {
    "fn9_located": located,
    "fn12_missed_quotes": misses,
    "win10_first_seen": first_seen,
    "jn2_chosen_rows": chosen_rows,
    "rt17_gold_positions": gold_positions,
    "jn11_gold_pairs": gold_pairs,
    "agg25_throughput": throughput,
    "fn33_trimmed": trimmed,
    "fn30_corpus_names": corpus_names,
    "sc12_gap_interval": median_gap,
}

_R = "r AS (SELECT DISTINCT ON (record_id) * FROM query_records)"
_P = "p AS (SELECT passage_id, arg_min({'s': source_id, 't': text}, chunk_id) AS x FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks) WHERE passage_id IS NOT NULL AND text IS NOT NULL GROUP BY 1), ps AS (SELECT passage_id, x.s AS source_id, x.t AS text FROM p)"
_C = "c AS (SELECT DISTINCT ON (claim_key) * FROM claims)"


def _unquoted_sql() -> str:
    """A chain of select lists, one per mark, over rows (k, i, q, text)."""
    trim = lambda x: rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
    out = f"SELECT claim_key, i, {trim('quoted')} AS q, text FROM x"
    for m in QUOTE_MARKS:
        m = m.replace("'", "''")
        out = f"SELECT claim_key, i, CASE WHEN length(q) > 1 AND starts_with(q, '{m}') AND ends_with(q, '{m}') THEN {trim('q[2:-2]')} ELSE q END AS q, text FROM ({out})"
    return out


def _tier_sql(q: str, flags: str) -> str:
    w = rf"list_filter(regexp_split_to_array({q}, '\s+'), lambda w: w <> '')"
    return rf"CASE WHEN strpos(text, q) = 0 AND len({w}) > 0 THEN nullif(regexp_extract(text, '{flags}' || array_to_string(list_transform({w}, lambda w: '\Q' || w || '\E'), '\s+')), '') END"


_EDGE = "trim(q, ' ' || chr(9) || chr(13) || chr(10) || '.,;:!?')"

SQL = {
    "fn9_located": f"WITH {_C}, {_P}, e AS (SELECT claim_key, unnest(range(0, len(citations))) AS i, citations FROM c), x AS (SELECT claim_key, i, citations[i + 1].quoted_text AS quoted, text FROM e JOIN ps ON citations[i + 1].passage_id = ps.passage_id WHERE citations[i + 1].quoted_text IS NOT NULL), "
    f"u AS ({_unquoted_sql()}), t AS (SELECT claim_key, i, q, text, [CASE WHEN strpos(text, q) > 0 THEN q END, {_tier_sql('q', '')}, {_tier_sql('q', '(?i)')}, {_tier_sql(_EDGE, '')}, {_tier_sql(_EDGE, '(?i)')}] AS s FROM u), "
    "k AS (SELECT claim_key, i, text, s, (SELECT min(n) FROM (SELECT unnest(range(1, 6)) AS n) WHERE s[n] IS NOT NULL) AS tier FROM t) "
    "SELECT claim_key, i AS citation_index, tier, strpos(text, s[tier]) - 1 AS span_start, strpos(text, s[tier]) - 1 + length(s[tier]) AS span_end, s[tier] AS span_text FROM k",
    "win10_first_seen": f"WITH {_R}, x AS (SELECT query_id, p.passage_id, min((CASE system_name WHEN 'joint' THEN 1 WHEN 'post_hoc' THEN 2 ELSE 3 END, p.rank_no, record_id)) AS fs FROM (SELECT record_id, query_id, system_name, unnest(retrieved) AS p FROM r) WHERE p.passage_id IS NOT NULL AND query_id IS NOT NULL GROUP BY 1, 2) SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY fs, passage_id) AS place FROM x",
    "jn2_chosen_rows": f"WITH {_P} SELECT source_id, passage_id, length(text) AS n_chars FROM ps WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY length(text) DESC, passage_id) = 1",
    "rt17_gold_positions": f"WITH {_R}, x AS (SELECT record_id, (SELECT min(i) FROM (SELECT unnest(range(1, len(retrieved) + 1)) AS i) WHERE list_contains(gold_passage_ids, retrieved[i].passage_id)) AS place FROM r WHERE len(gold_passage_ids) > 0) SELECT record_id, place, " + ", ".join(f"coalesce(place <= {k}, false) AS within_{k}" for k in (1, 5, 10, 20)) + " FROM x",
    "jn11_gold_pairs": f"WITH {_R}, {_P}, g AS (SELECT record_id, ps.source_id FROM (SELECT record_id, unnest(list_distinct(gold_passage_ids)) AS passage_id FROM r) JOIN ps USING (passage_id)), f AS (SELECT record_id, ps.source_id FROM (SELECT DISTINCT record_id, p.passage_id FROM (SELECT record_id, unnest(retrieved) AS p FROM r)) JOIN ps USING (passage_id)) SELECT record_id, count(*) AS n_pairs, count(*) FILTER (f.source_id = g.source_id) AS same_source FROM f JOIN g USING (record_id) GROUP BY 1",
    "agg25_throughput": f"WITH {_R} SELECT backend, count(*) AS n, round(sum(completion_tokens) / sum(round(latency_s, 6)::DECIMAL(20,6))::DOUBLE, 3) AS tokens_per_s, round(min(latency_s / completion_tokens), 6) AS least_s, round(max(latency_s / completion_tokens), 6) AS most_s, round(1e6 * sum(round(latency_s, 6)::DECIMAL(20,6))::DOUBLE / sum(completion_tokens), 1) AS s_per_million FROM r WHERE latency_s > 0 AND NOT isnan(latency_s) AND completion_tokens > 0 GROUP BY 1",
    "fn33_trimmed": f"WITH {_R} SELECT record_id, array_to_string(gold_passage_ids[1:3], ',') AS kept FROM r",
    "fn30_corpus_names": f"WITH {_R}, x AS (SELECT run_id, count(*) * 20000 AS target_n FROM r GROUP BY 1) SELECT run_id, target_n, CASE target_n WHEN 2000000 THEN 'pubmed-2m-v1' WHEN 1000000 THEN 'pubmed-1m-v1' ELSE 'pubmed-' || (target_n // 1000) || 'k-v1' END AS corpus_id FROM x",
    "sc12_gap_interval": f"WITH {_R}, {_C}, k AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS idx FROM r WHERE query_id IS NOT NULL AND system_name IN ('joint', 'post_hoc') GROUP BY 1 HAVING count(DISTINCT system_name) = 2), w AS (SELECT idx, system_name, len(list_filter(regexp_split_to_array(text, '[\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+'), lambda x: x <> '')) AS w FROM c JOIN r USING (record_id) JOIN k USING (query_id) WHERE text IS NOT NULL AND system_name IN ('joint', 'post_hoc')), h AS (SELECT idx, system_name, w, count(*) AS n FROM w GROUP BY ALL), "
    "dr AS (SELECT replicate, idx, count(*) AS times FROM (SELECT replicate, ('0x' || substr(md5('3:' || replicate || ':' || pos), 1, 8))::BIGINT % nc AS idx FROM (SELECT count(*) AS nc FROM k), (SELECT unnest(range(0, 4000)) AS replicate), LATERAL (SELECT unnest(range(0, nc)) AS pos)) GROUP BY ALL), "
    "z AS (SELECT replicate, system_name, w, sum(times * n) AS n FROM dr JOIN h USING (idx) GROUP BY ALL UNION ALL SELECT -1, system_name, w, sum(n) FROM h GROUP BY ALL), y AS (SELECT replicate, system_name, w, sum(n) OVER (PARTITION BY replicate, system_name ORDER BY w) AS upto, sum(n) OVER (PARTITION BY replicate, system_name) AS total FROM z), "
    "m AS (SELECT replicate, (min(w) FILTER (system_name = 'joint' AND upto >= (total + 1) // 2) + min(w) FILTER (system_name = 'joint' AND upto >= (total + 2) // 2)) / 2.0 AS j, (min(w) FILTER (system_name = 'post_hoc' AND upto >= (total + 1) // 2) + min(w) FILTER (system_name = 'post_hoc' AND upto >= (total + 2) // 2)) / 2.0 AS p FROM y GROUP BY 1), "
    "g AS (SELECT replicate, (p - j) / nullif(j, 0) AS gap FROM m WHERE p IS NOT NULL AND j IS NOT NULL), s AS (SELECT list_sort(list(gap) FILTER (replicate >= 0 AND gap IS NOT NULL)) AS s, max(gap) FILTER (replicate < 0) AS point FROM g) "
    "SELECT (SELECT count(*) FROM k) AS n_queries, len(s) AS draws, round(point, 6) AS point, round(s[floor(0.025 * len(s))::INT + 1], 6) AS lower, round(s[least(floor(0.975 * len(s))::INT, len(s) - 1) + 1], 6) AS upper FROM s",
}
