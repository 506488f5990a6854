"""Texts cut into units: sentences, windows, capped pieces, chunks under four strategies, claim bodies, candidates for quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stats import r6
from ..sources import records as R
from ..sources.tables import table

#: The strategies under which a document can be chunked.
STRATEGIES = ("abstract", "section", "sentence_window", "fixed_width")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").where("text is not null")


def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sentence spans of every document."""
    return docs(spark, d).select("doc_id", F.posexplode(X.sentence_spans(F.col("text"))).alias("pos", "s")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("s.start").cast("bigint").alias("char_start"), F.col("s.end").cast("bigint").alias("char_end"))


def chunk(df: DataFrame, strategy: str, size: int = 3, stride: int = 1, max_chars: int = 800) -> DataFrame:
    """(doc_id, chunk_index, char_start, char_end) of every document under a strategy; every piece within max_chars.

    Sections are the document's non-blank lines; a blank document has no chunk.
    Spans of whole texts and sections are cut in consecutive pieces at the cap.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if max_chars < 1 or size < 1 or stride < 1 or stride > size:
        raise ValueError("max_chars, size and stride must be positive, and stride no more than size")
    t = F.col("text")
    span = "array<struct<start:int,end:int>>"
    if strategy in ("abstract", "fixed_width"):
        spans = F.array(F.struct(F.lit(0).alias("start"), F.char_length(t).alias("end"))).cast(span)
    elif strategy == "section":
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))

        def line(acc, p):
            one = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.char_length(p)).alias("end")))
            return F.struct((acc["at"] + F.char_length(p) + 1).alias("at"), F.when(F.trim(F.regexp_replace(p, r"(?U)\s+", " ")) == "", acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

        spans = F.aggregate(F.split(t, "\n"), empty, line, lambda acc: acc["out"])
    else:
        spans = X.sentence_spans(t)
    x = df.where(F.regexp_replace(t, r"(?U)\s+", "") != "").select("doc_id", spans.alias("s"))
    if strategy == "sentence_window":
        starts = X.window_starts(F.size("s"), size, stride)
        wide = F.transform(starts, lambda i: F.struct(F.element_at(F.col("s"), i + 1)["start"].alias("start"), F.element_at(F.col("s"), F.least(i + size, F.size("s")))["end"].alias("end")))
        x = x.select("doc_id", wide.alias("s"))
    pieces = F.flatten(F.transform("s", lambda w: F.transform(X.capped(w["end"] - w["start"], max_chars), lambda p: F.struct((w["start"] + p["start"]).alias("start"), (w["start"] + p["end"]).alias("end")))))
    return x.select("doc_id", F.posexplode(pieces).alias("i", "p")).select("doc_id", F.col("i").cast("bigint").alias("chunk_index"), F.col("p.start").cast("bigint").alias("char_start"), F.col("p.end").cast("bigint").alias("char_end"))


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks per strategy: how many, of how many documents, and their mean length."""
    out = None
    for s in STRATEGIES:
        c = chunk(docs(spark, d), s, max_chars=600 if s == "fixed_width" else 2000).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), r6(F.avg(F.col("char_end") - F.col("char_start")), "mean_chars")).withColumn("strategy", F.lit(s))
        out = c if out is None else out.unionByName(c)
    return out


def cut_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    """Documents that two chunkings cut differently, and the totals of both."""
    a = chunk(docs(spark, d), "section", max_chars=2000).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("a"))
    b = chunk(docs(spark, d), "abstract", max_chars=2000).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end"))).alias("b"))
    return a.join(b, "doc_id", "full").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_different"), F.sum(F.size("a")).alias("chunks_a"), F.sum(F.size("b")).alias("chunks_b"))


def rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Sources put together again from their passages in order, one blank between."""
    c = R.passages(spark, d).select("source_id", "chunk_index", "text")
    g = c.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda x: x["text"]), " ")
    return g.select("source_id", F.size("p").cast("bigint").alias("n_passages"), F.md5(whole).alias("text_md5"))


def bodies(spark: SparkSession, d: str) -> DataFrame:
    """Answer spans of replies: bodies of CLAIM lines, else the whole reply."""
    r = R.records(spark, d, "raw_generation").where("raw_generation is not null")
    b = X.claim_bodies(F.col("raw_generation"))
    return r.select("record_id", F.size(b).cast("bigint").alias("n_bodies"), F.md5(F.array_join(b, "\n")).alias("bodies_md5"))


def run_ons(spark: SparkSession, d: str, most: int = 12) -> DataFrame:
    """Claims cut into pieces of at most ``most`` words at clause marks."""
    c = R.claims(spark, d, "text").where("text is not null")
    return c.select("claim_key", F.posexplode(X.pack_clauses(F.col("text"), most)).alias("pos", "piece")).select("claim_key", F.col("pos").cast("bigint").alias("pos"), "piece")


def packed(spark: SparkSession, d: str, most: int = 40) -> DataFrame:
    """Passages as chunks of whole sentences of at most ``most`` words."""
    return R.passages(spark, d).select("passage_id", F.posexplode(X.pack_sentences(F.col("text"), most)).alias("pos", "piece")).select("passage_id", F.col("pos").cast("bigint").alias("pos"), F.md5("piece").alias("piece_md5"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Quote candidates per passage; passages with none are left out."""
    p = R.passages(spark, d).select("passage_id", X.quote_candidates(F.col("text")).alias("q")).where(F.size("q") > 0)
    return p.select("passage_id", F.size("q").cast("bigint").alias("n"), F.md5(F.array_join("q", "\n")).alias("q_md5"))


def windows(spark: SparkSession, d: str, size: int = 5, stride: int = 2) -> DataFrame:
    """Sliding windows over the sentences of each document, the tail once."""
    x = docs(spark, d).select("doc_id", F.size(X.sentences(F.col("text"))).alias("n"))
    return x.select("doc_id", "n", F.explode(X.window_starts(F.col("n"), size, stride)).alias("s")).select("doc_id", F.col("s").cast("bigint").alias("first"), F.least(F.col("s") + size, F.col("n")).cast("bigint").alias("end"))


def tightened(spark: SparkSession, d: str) -> DataFrame:
    """Spans of claims in their replies, shrunk past outer white space."""
    c = R.claims(spark, d, "record_id", "source_start", "source_end").where("source_start is not null and source_end > source_start").join(R.records(spark, d, "raw_generation").where("raw_generation is not null"), "record_id")
    piece = F.substring(F.col("raw_generation"), F.col("source_start") + 1, F.col("source_end") - F.col("source_start"))
    left, right = F.regexp_replace(piece, r"(?U)^\s+", ""), F.regexp_replace(piece, r"(?U)\s+$", "")
    n = F.char_length(piece)
    return c.where(F.regexp_replace(piece, r"(?U)\s+", "") != "").select("claim_key", (F.col("source_start") + n - F.char_length(left)).cast("bigint").alias("tight_start"), (F.col("source_start") + F.char_length(right)).cast("bigint").alias("tight_end"))


def prompt_guard(spark: SparkSession, d: str, window: int = 700, answer: int = 256) -> DataFrame:
    """Replies whose rough token count and the tokens of an answer exceed the window; equality is allowed."""
    r = R.records(spark, d, "backend", "raw_generation").where("raw_generation is not null")
    return r.withColumn("t", X.prompt_tokens(F.col("raw_generation"))).groupBy("backend").agg(F.count(F.lit(1)).alias("n"), F.sum("t").cast("bigint").alias("tokens"), F.count_if(F.col("t") + answer > window).alias("refused"))


# Windows of models by what their name contains, in order, and the default.
MODEL_WINDOWS = (("hosted:", 200_000), ("orla-7b", 14_336), ("orla", 32_768))
DEFAULT_WINDOW = 14_336


def model_windows(spark: SparkSession, d: str) -> DataFrame:
    """The window of each backend: the first entry that its name contains."""
    return R.records(spark, d, "backend").select("backend").distinct().select("backend", X.first_prefix(F.col("backend"), MODEL_WINDOWS, DEFAULT_WINDOW).cast("bigint").alias("max_tokens"))


def judge_replies(spark: SparkSession, d: str) -> DataFrame:
    """Judge replies read as scores: made from the scores of the verifiers in the forms that judges use, broken ones among them."""
    v = table(spark, d, "verifier_scores").where("score is not null and not isnan(score)").select("score_id", F.floor(F.col("score") * 120).cast("int").alias("k")).distinct()
    form = F.col("score_id") % 5
    reply = F.when(form == 0, F.concat(F.lit(" "), F.col("k").cast("string"), F.lit("%"))).when(form == 1, F.concat(F.col("k").cast("string"), F.lit("."))).when(form == 2, F.concat(F.lit("score "), F.col("k").cast("string"))).otherwise(F.col("k").cast("string"))
    return v.select(X.judge_score(reply).alias("s")).groupBy(F.round("s", 2).alias("judge_score")).agg(F.count(F.lit(1)).alias("n"))


def blind_ids(spark: SparkSession, d: str) -> DataFrame:
    """Opaque unit ids of claims."""
    return R.claims(spark, d, "record_id", "claim_id").select("claim_key", X.blind_id("unit", 13, F.col("record_id").cast("string"), F.col("claim_id")).alias("unit"))


# The closings that may complete a JSON reply that was cut, in the order in which they are tried.
CLOSINGS = ("", "}", "]}", "\"}]}", "\"]}]}", "\"\"}]}", "null}]}", "\"\"}]}}")


def repaired_json(spark: SparkSession, d: str) -> DataFrame:
    """Which closing makes a JSON reply parse, and the decision in it; replies that none completes have neither."""
    r = R.records(spark, d, "raw_generation").where(F.col("raw_generation").rlike(r"^\s*\{"))
    parsed = lambda c: F.try_parse_json(F.concat(F.col("raw_generation"), F.lit(c)))
    which = F.coalesce(*[F.when(parsed(c).isNotNull(), F.lit(i)) for i, c in enumerate(CLOSINGS)])
    decision = F.coalesce(*[F.try_variant_get(parsed(c), "$.decision", "string") for c in CLOSINGS])
    return r.select(which.cast("bigint").alias("closing"), decision.alias("decision")).groupBy("closing", "decision").agg(F.count(F.lit(1)).alias("n"))


def unwrapped(spark: SparkSession, d: str) -> DataFrame:
    """Replies that open with a quote mark and are one JSON string, decoded by one level; every other reply as it is."""
    r = R.records(spark, d, "raw_generation").where("raw_generation is not null")
    raw = F.col("raw_generation")
    # the parser reads the first value only, so that nothing may follow the closing quote mark
    one = F.regexp_replace(raw, r"(?s)\\.", "").rlike(r'\A"[^"]*"[ \t\r\n]*\z')
    back = F.when(F.startswith(raw, F.lit('"')) & one, F.try_variant_get(F.try_parse_json(raw), "$", "string"))
    return r.select("record_id", F.char_length(F.coalesce(back, raw)).cast("bigint").alias("n_chars"))


QUERIES = {
    "fn2_sentence_spans": sentence_rows,
    "fn3_before_capital": lambda s, d: docs(s, d).select("doc_id", F.size(X.split_before_capital(F.col("text"))).cast("bigint").alias("n")),
    "fn4_capped": lambda s, d: docs(s, d).select("doc_id", F.explode(X.capped(F.char_length("text"), 500)).alias("p")).select("doc_id", F.col("p.start").cast("bigint").alias("char_start"), F.col("p.end").cast("bigint").alias("char_end")),
    "fn5_tighten": tightened,
    "fn6_run_ons": run_ons,
    "fn8_normalised": lambda s, d: R.claims(s, d, "text").where("text is not null").select("claim_key", F.md5(F.lower(F.array_join(X.words(F.col("text")), " "))).alias("norm_md5")),
    "fn10_quote_candidates": candidates,
    "fn14_claim_bodies": bodies,
    "fn17_packed": packed,
    "fn18_judge_scores": judge_replies,
    "fn21_blind_ids": blind_ids,
    "fn27_repaired_json": repaired_json,
    "fn28_unwrapped": unwrapped,
    "win3_windows": windows,
    "prj14_prompt_guard": prompt_guard,
    "prj15_model_windows": model_windows,
    "rt1_chunk_section": lambda s, d: chunk(docs(s, d), "section", max_chars=1200),
    "rt1_chunk_window": lambda s, d: chunk(docs(s, d), "sentence_window", 3, 1, 800),
    "rt1_chunk_fixed": lambda s, d: chunk(docs(s, d), "fixed_width", max_chars=512),
    "rt1_chunk_counts": chunk_counts,
    "rt13_rebuilt": rebuilt,
    "agg23_cut_asymmetry": cut_asymmetry,
}

_S = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_W = r"[^\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
_PRE = f"""WITH c AS (SELECT DISTINCT ON (claim_key) * FROM claims), r AS (SELECT DISTINCT ON (record_id) * FROM query_records), t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
p AS (SELECT passage_id, arg_min(text, chunk_id) AS text, arg_min(source_id, chunk_id) AS source_id, arg_min(chunk_index, chunk_id) AS chunk_index FROM chunks WHERE passage_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
pc AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, a FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]{_S}+)', '\\1' || chr(1), 'g'), chr(1)) AS a FROM t)),
sp AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, p0 AS s, p0 + length(regexp_replace(a[i], '([.!?]){_S}+$', '\\1')) AS e FROM (SELECT *, sum(length(a[i])) OVER (PARTITION BY doc_id ORDER BY i) - length(a[i]) AS p0 FROM pc) WHERE regexp_replace(a[i], '{_S}+', '', 'g') <> '')"""
_SENT = "list_filter(string_split(regexp_replace(text, '([.!?])" + _S + "+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '" + _S + "+', '', 'g') <> '')"
_LN = f", ln AS (SELECT doc_id, i, p0 AS s, p0 + length(l) AS e FROM (SELECT doc_id, i, l, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1 AS p0 FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM t))) WHERE regexp_replace(l, '{_S}+', '', 'g') <> '')"
_WN = ", ns AS (SELECT doc_id, count(*) AS n FROM sp GROUP BY 1), wi AS (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - {size}) / {stride})::BIGINT) + 1)) * {stride} AS f FROM ns)"
_NB = f", nb AS (SELECT * FROM t WHERE regexp_replace(text, '{_S}+', '', 'g') <> '')"


def _cap(src: str, cap: int) -> str:
    return f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, o) - 1 AS chunk_index, (s + o)::BIGINT AS char_start, least(s + o + {cap}, e)::BIGINT AS char_end FROM (SELECT doc_id, i, s, e, unnest(range(0, greatest(e - s, 1)::BIGINT, {cap})) AS o FROM {src})"


_WSRC = "(SELECT w.doc_id, f AS i, a.s AS s, b.e AS e FROM wi w JOIN sp a ON a.doc_id = w.doc_id AND a.pos = f JOIN sp b ON b.doc_id = w.doc_id AND b.pos = least(f + {size}, n) - 1)"
_ABS = "(SELECT doc_id, 0 AS i, 0 AS s, length(text) AS e FROM nb)"


def _pack(src: str, most: int) -> str:
    return f"list_filter((SELECT list_append(z.done, z.held) FROM (SELECT list_reduce(list_transform({src}, lambda k: {{'done': []::VARCHAR[], 'held': k}}), lambda a, b: CASE WHEN len(regexp_extract_all(a.held || ' ' || b.held, '{_W}')) <= {most} THEN {{'done': a.done, 'held': a.held || ' ' || b.held}} ELSE {{'done': list_append(a.done, a.held), 'held': b.held}} END) AS z)), lambda x: trim(x) <> '')"


_CL = "string_split(regexp_replace(text, '([;,])" + _S + "+', '\\1' || chr(1), 'g'), chr(1))"

SQL = {
    "fn2_sentence_spans": _PRE + "SELECT doc_id, pos, s::BIGINT AS char_start, e::BIGINT AS char_end FROM sp",
    "fn3_before_capital": _PRE + r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS n FROM t",
    "fn4_capped": _PRE + "SELECT doc_id, o AS char_start, least(o + 500, length(text)) AS char_end FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 500)) AS o FROM t)",
    "fn5_tighten": _PRE + f"SELECT claim_key, (source_start + length(p) - length(regexp_replace(p, '^{_S}+', '')))::BIGINT AS tight_start, (source_start + length(regexp_replace(p, '{_S}+$', '')))::BIGINT AS tight_end FROM (SELECT claim_key, source_start, substr(raw_generation, source_start + 1, source_end - source_start) AS p FROM c JOIN r USING (record_id) WHERE source_start IS NOT NULL AND source_end > source_start AND raw_generation IS NOT NULL) WHERE regexp_replace(p, '{_S}+', '', 'g') <> ''",
    "fn6_run_ons": _PRE + f"SELECT claim_key, i - 1 AS pos, a[i] AS piece FROM (SELECT claim_key, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT claim_key, {_pack(_CL, 12)} AS a FROM c WHERE text IS NOT NULL))",
    "fn8_normalised": _PRE + f"SELECT claim_key, md5(lower(array_to_string(regexp_extract_all(text, '{_W}'), ' '))) AS norm_md5 FROM c WHERE text IS NOT NULL",
    "fn10_quote_candidates": _PRE + ", q AS (SELECT passage_id, list_sort(list_distinct(list_filter(list_concat(f, list_transform(f, lambda x: regexp_replace(x, '[.!?]+$', '')), g), lambda x: contains(text, x)))) AS q FROM (SELECT *, list_filter(list_transform(" + _SENT + r", lambda x: trim(x, ' ')), lambda x: length(x) >= 10) AS f, list_filter(list_transform(string_split(regexp_replace(text, '[;:]\s+', chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: length(x) >= 15) AS g FROM p)) SELECT passage_id, len(q) AS n, md5(array_to_string(q, chr(10))) AS q_md5 FROM q WHERE len(q) > 0",
    "fn14_claim_bodies": _PRE + r", l AS (SELECT record_id, raw_generation, list_filter(string_split(raw_generation, chr(10)), lambda x: regexp_matches(x, '(?i)^[ \t]*CLAIM[ \t]+\d+[ \t]*:[ \t]*')) AS l FROM r WHERE raw_generation IS NOT NULL), b AS (SELECT record_id, CASE WHEN len(l) = 0 THEN [raw_generation] ELSE list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '(?i)^[ \t]*CLAIM[ \t]+\d+[ \t]*:[ \t]*', ''), ' ')), lambda x: x <> '') END AS b FROM l) SELECT record_id, len(b) AS n_bodies, md5(array_to_string(b, chr(10))) AS bodies_md5 FROM b",
    "fn17_packed": _PRE + f"SELECT passage_id, i - 1 AS pos, md5(a[i]) AS piece_md5 FROM (SELECT passage_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT passage_id, {_pack(_SENT, 40)} AS a FROM p))",
    "fn18_judge_scores": "SELECT CASE WHEN score_id % 5 <> 2 AND k BETWEEN 0 AND 100 THEN round(k / 100.0::DOUBLE, 2) END AS judge_score, count(*) AS n FROM (SELECT DISTINCT score_id, floor(score * 120)::INT AS k FROM verifier_scores WHERE score IS NOT NULL AND NOT isnan(score)) GROUP BY 1",
    "fn21_blind_ids": _PRE + "SELECT claim_key, 'unit_' || substr(sha256(concat_ws('|', 'unit', '13', record_id::VARCHAR, claim_id)), 1, 12) AS unit FROM c",
    "fn27_repaired_json": _PRE + ", x AS (SELECT (SELECT min(i) FROM (SELECT unnest(range(0, 8)) AS i, unnest(['', '}', ']}', '\"}]}', '\"]}]}', '\"\"}]}', 'null}]}', '\"\"}]}}']) AS s) WHERE json_valid(raw_generation || s)) AS closing, raw_generation FROM r WHERE regexp_matches(raw_generation, '^\\s*\\{')) SELECT closing, CASE WHEN closing IS NOT NULL THEN (raw_generation || ['', '}', ']}', '\"}]}', '\"]}]}', '\"\"}]}', 'null}]}', '\"\"}]}}'][closing + 1])::JSON->>'decision' END AS decision, count(*) AS n FROM x GROUP BY 1, 2",
    "fn28_unwrapped": _PRE + "SELECT record_id, length(CASE WHEN starts_with(raw_generation, '\"') AND json_valid(raw_generation) THEN raw_generation::JSON->>'$' ELSE raw_generation END) AS n_chars FROM r WHERE raw_generation IS NOT NULL",
    "win3_windows": _PRE + _WN.format(size=5, stride=2) + "SELECT doc_id, f AS first, least(f + 5, n) AS \"end\" FROM wi",
    "prj14_prompt_guard": _PRE + f", x AS (SELECT backend, greatest(len(regexp_extract_all(raw_generation, '{_W}')), length(raw_generation) // 4) AS t FROM r WHERE raw_generation IS NOT NULL) SELECT backend, count(*) AS n, sum(t)::BIGINT AS tokens, count(*) FILTER (t + 256 > 700) AS refused FROM x GROUP BY 1",
    "prj15_model_windows": _PRE + "SELECT DISTINCT backend, CASE WHEN contains(backend, 'hosted:') THEN 200000 WHEN contains(backend, 'orla-7b') THEN 14336 WHEN contains(backend, 'orla') THEN 32768 ELSE 14336 END::BIGINT AS max_tokens FROM r",
    "rt1_chunk_section": _PRE + _LN + _cap("ln", 1200),
    "rt1_chunk_window": _PRE + _WN.format(size=3, stride=1) + _cap(_WSRC.format(size=3), 800),
    "rt1_chunk_fixed": _PRE + _NB + _cap(_ABS, 512),
    "rt1_chunk_counts": _PRE + _LN + _NB + _WN.format(size=3, stride=1) + " " + " UNION ALL ".join(f"SELECT '{n}' AS strategy, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, round(avg(char_end - char_start), 6) AS mean_chars FROM ({_cap(src, cap)})" for n, src, cap in (("abstract", _ABS, 2000), ("section", "ln", 2000), ("sentence_window", _WSRC.format(size=3), 2000), ("fixed_width", _ABS, 600))),
    "rt13_rebuilt": _PRE + "SELECT source_id, count(*) AS n_passages, md5(string_agg(text, ' ' ORDER BY chunk_index, text)) AS text_md5 FROM p GROUP BY 1",
    "agg23_cut_asymmetry": _PRE + _LN + _NB + f", a AS (SELECT doc_id, list((char_start, char_end) ORDER BY char_start) AS a FROM ({_cap('ln', 2000)}) GROUP BY 1), b AS (SELECT doc_id, list((char_start, char_end) ORDER BY char_start) AS b FROM ({_cap(_ABS, 2000)}) GROUP BY 1) SELECT count(*) FILTER (a IS DISTINCT FROM b) AS n_different, sum(len(a))::BIGINT AS chunks_a, sum(len(b))::BIGINT AS chunks_b FROM a FULL JOIN b USING (doc_id)",
}
