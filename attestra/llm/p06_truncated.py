"""Problem 6: text values that stop before their end, and how often each backend cuts them.

Word trigrams of all claim texts are counted inside texts and where a sentence
mark follows. The last trigram of a value is then looked up: one that is
frequent inside but almost never at an end tells of a cut. Where a trigram is
too rare the last two words or the last word decide, and a last word that is
known neither itself nor by its ending was cut in the middle. Unclosed reply
structure and values that are exactly as long as a field's limit count too;
limits are the lengths, in characters, bytes or tokens, at which different
unmarked values of a backend pile up.

Exact checks follow where the data hold what a text was copied from. A
quotation may stop anywhere, so a reply's last one is held against those that
are stored with its claims: one that goes on further tells of a cut, an equal
one of a whole reply. A claim is held against its span of the reply: one that
the reply carries on was cut, one that the reply ends just as the claim does is
whole, unless the reply itself was cut there.
All of it is SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import spool
from ..plans.views import query
from ..sources.tables import once, table

#: Sightings inside lines from which a word stands for itself in trigrams; rarer ones are written ~.
SUPPORT = 20
#: Sightings inside lines that make a word known.
KNOWN = 3
#: Sightings from which a trigram (pair, word) is judged by itself.
SEEN = 10
#: Share of sightings at an end, below which trigram and pair, or the last word alone, aren't terminal.
TERMINAL, TERMINAL_WORD = 0.03, 0.01
#: Share of rare words below which an ending of three letters is unusual, and the sightings that it needs at least.
ENDING, ENDING_SEEN = 0.0008, 3
#: A value shorter than this can't be told from an empty answer.
LEAST_CHARS = 12
#: Different unmarked values of one length and source, from which that length may be a limit.
AT_LIMIT = 5
#: Times that they must outnumber those of the lengths around; and those of lengths just below a limit, where a blank or half a character went.
PILE, NEAR = 8, 2

_MARKED = r"[.!?。！？।؟][\"'”’»」』)\]）]*$|[。！？।؟][\"”’»」』）]*$"
_TOKEN = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]|[\p{L}\p{M}]++(?:[-’][\p{L}\p{M}]++)*+|[0-9]++(?:[.,][0-9]++)*+|[%)]"
# what may be put after a cut text: white space, dashes, half characters, dots; one dot alone is a sentence mark
_BLANK = " \t\n\r\x0b\x0c\u0085               　"
_TRAIL = _BLANK + "�-–—….‐"
_NOTE = r"[\[(](?:…|\.\.\.|truncated|cut)[\])]$"
_ONE_DOT = r"^\s*[.](?![.])"


def _lit(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bare(x: str) -> str:
    """``x`` without what was put after the text, however long that is; a single dot behind the text stays."""
    end = f"rtrim({_lit(_TRAIL)}, {x})"
    cut = f"rtrim({_lit(_TRAIL)}, if(right({end}, 1) IN (']', ')'), regexp_replace({end}, {_lit(_NOTE)}, ''), {end}))"
    return f"concat({cut}, regexp_extract(substr({x}, length({cut}) + 1), {_lit(_ONE_DOT)}, 0))"


def _tokens(x: str) -> str:
    """Words, characters of scripts without blanks, figures and two marks."""
    return f"regexp_extract_all(lower({x}), {_lit(_TOKEN)}, 0)"


def _word(w: str) -> str:
    """A token, all figures as one."""
    return f"if({w} >= '0' AND {w} < ':', '0', {w})"


_JSON = r"^\s*(?:```\w*\s*)?[\{\[]"
_LETTER_END = r"[\p{L}\p{M}]$"
# the last word of a quotation, which may otherwise stop anywhere, as in scripts without blanks
_PLAIN_WORD = r"(?:^|\s)[(\"“«]?\p{L}[\p{Ll}\p{M}’-]{0,19}$"
_JSON_END = r"[\]\}]$"
_FENCE = r"\s*```$"
_CITE = r"^\s*CITE\b"
_CITE_WHOLE = r"\|\|\s*\S"
_CITED = r"^\s*CITE\s*\d*\s*:(.*?)\|\|"
_CLAIM_BEFORE = r"CLAIM\s*\d+\s*:[^\n]*\S[^\n]*\n"
_HEAD_ONLY = r"^\s*(?:C|CL|CLA|CLAI|CI|CIT|CLAIM\s*\d*\s*:?|\d+[.)])\s*$"
_HEAD = r"^\s*(?:CLAIM\s*\d+\s*:|\d+[.)]|CITE\s*\d*\s*:.*?\|\|)\s*"
_TAG = r"^<[^>]*>"

_VALUES = f"""
WITH v AS (
  SELECT 'raw_generation' AS field_name, record_id AS row_id, record_id, backend, completion_tokens AS t_tokens, raw_generation AS whole,
    CAST(NULL AS int) AS source_start, CAST(NULL AS int) AS source_end
  FROM $records WHERE raw_generation IS NOT NULL
  UNION ALL
  SELECT 'claim_text', claim_key, record_id, backend, CAST(NULL AS bigint), text, source_start, source_end
  FROM $claims LEFT JOIN (SELECT record_id, backend FROM $records) USING (record_id) WHERE text IS NOT NULL),
b AS (SELECT *, {_bare('whole')} AS t, rtrim({_lit(_BLANK)}, whole) AS seen_end FROM v),
lines AS (
  SELECT *, substring_index(t, '\n', -1) AS line, field_name = 'raw_generation' AND length(t) > 4 AND t RLIKE {_lit(_JSON)} AS is_json FROM b),
bodies AS (
  SELECT *, line RLIKE {_lit(_CITE)} AS is_cite, regexp_replace(line, {_lit(_HEAD)}, '') AS body FROM lines),
u AS (
  SELECT field_name, row_id, record_id, backend, is_json, is_cite, source_start, source_end, length(whole) AS n_chars, length(t) AS t_chars, octet_length(t) AS t_bytes, t_tokens,
    xxhash64(t) AS t_hash, endswith(seen_end, '�') AS broken,
    CASE WHEN field_name = 'raw_generation' AND NOT is_json THEN trim(regexp_extract(line, {_lit(_CITED)}, 1)) END AS cited,
    CASE WHEN is_json THEN NOT regexp_replace(t, {_lit(_FENCE)}, '') RLIKE {_lit(_JSON_END)}
           OR length(replace(t, '{{', '')) <> length(replace(t, '}}', ''))
         WHEN field_name = 'claim_text' THEN false
         ELSE (is_cite AND NOT line RLIKE {_lit(_CITE_WHOLE)})
           OR (line RLIKE {_lit(_HEAD_ONLY)} AND t RLIKE {_lit(_CLAIM_BEFORE)}) END AS open_structure,
    body RLIKE {_lit(_MARKED)} AND NOT endswith(seen_end, '..') AND NOT endswith(seen_end, '…') AS marked,
    body RLIKE {_lit(_LETTER_END)} AS in_letters, body
  FROM bodies)
SELECT * EXCEPT (body), if(marked OR is_json OR body RLIKE {_lit(_TAG)}, NULL, body) AS body FROM u
"""

# words inside lines: the last one of a line may be cut
_WORDS = f"""
WITH toks AS (SELECT {_tokens('line')} AS w FROM (SELECT explode(split(raw_generation, '\n')) AS line FROM $records WHERE raw_generation IS NOT NULL)),
words AS (SELECT explode(slice(w, 1, size(w) - 1)) AS word FROM toks WHERE size(w) > 1)
SELECT {_word('word')} AS word, count(*) AS word_n FROM words GROUP BY 1 HAVING count(*) >= {KNOWN}
"""

# words are mapped before trigrams are grouped, so that only frequent ones are shuffled
_COUNTS = f"""
WITH f AS (SELECT word FROM $words WHERE word_n >= {SUPPORT}),
toks AS (SELECT {_tokens("text")} AS w, text RLIKE {_lit(_MARKED)} AND NOT endswith(text, '..') AS marked FROM $claims WHERE text IS NOT NULL),
e AS (
  SELECT posexplode(arrays_zip(a, b, w)) AS (k, t), size(w) AS n, marked
  FROM (SELECT *, slice(concat(array('^', '^'), w), 1, size(w)) AS a, slice(concat(array('^'), w), 1, size(w)) AS b FROM toks WHERE size(w) > 0)),
g AS (SELECT {_word('t.a')} AS a, {_word('t.b')} AS b, {_word('t.w')} AS c, k = n - 1 AS last, marked FROM e)
SELECT coalesce(x.word, if(a = '^', '^', '~')) AS a, coalesce(y.word, if(b = '^', '^', '~')) AS b, coalesce(z.word, '~') AS c,
  if(z.word IS NULL, right(c, 3), NULL) AS tail, count_if(NOT last) AS inner_n, count_if(last AND marked) AS end_n
FROM g LEFT JOIN f x ON a = x.word LEFT JOIN f y ON b = y.word LEFT JOIN f z ON c = z.word GROUP BY 1, 2, 3, 4
"""

# only values without a sentence mark are looked up
_ENDS = f"""
WITH w AS (SELECT field_name, row_id, {_tokens("body")} AS w FROM $values WHERE body IS NOT NULL),
l AS (SELECT field_name, row_id, coalesce(get(w, size(w) - 3), '^') AS ea, coalesce(get(w, size(w) - 2), '^') AS eb, coalesce(get(w, size(w) - 1), '') AS ec FROM w),
e AS (SELECT field_name, row_id, {_word('ea')} AS ea, {_word('eb')} AS eb, {_word('ec')} AS ec FROM l),
f AS (SELECT word FROM $words WHERE word_n >= {SUPPORT}),
m AS (SELECT e.field_name, e.row_id, e.ec, coalesce(x.word, if(ea = '^', '^', '~')) AS a, coalesce(y.word, if(eb = '^', '^', '~')) AS b,
    if(z.word_n >= {SUPPORT}, z.word, '~') AS c, right(ec, 3) AS tail, z.word IS NOT NULL AS known
  FROM e LEFT JOIN f x ON ea = x.word LEFT JOIN f y ON eb = y.word LEFT JOIN $words z ON ec = z.word),
t3 AS (SELECT a, b, c, sum(inner_n) AS i3, sum(end_n) AS e3 FROM $counts GROUP BY 1, 2, 3),
t2 AS (SELECT b, c, sum(inner_n) AS i2, sum(end_n) AS e2 FROM $counts GROUP BY 1, 2),
t1 AS (SELECT c, sum(inner_n) AS i1, sum(end_n) AS e1 FROM $counts GROUP BY 1),
s AS (SELECT tail, sum(inner_n + end_n) AS s_n FROM $counts WHERE tail IS NOT NULL GROUP BY 1),
st AS (SELECT sum(s_n) AS s_all FROM s),
n AS (SELECT m.field_name, m.row_id, m.ec, m.c, m.known, coalesce(i3, 0) AS i3, coalesce(e3, 0) AS e3, coalesce(i2, 0) AS i2, coalesce(e2, 0) AS e2,
    coalesce(i1, 0) AS i1, coalesce(e1, 0) AS e1, coalesce(s_n, 0) AS s_n, s_all
  FROM m LEFT JOIN t3 ON m.a = t3.a AND m.b = t3.b AND m.c = t3.c LEFT JOIN t2 ON m.b = t2.b AND m.c = t2.c
  LEFT JOIN t1 ON m.c = t1.c LEFT JOIN s ON m.tail = s.tail CROSS JOIN st)
SELECT field_name, row_id, ec,
  c = '~' AND ec RLIKE '^[a-zß-ÿа-я’-]+$' AND s_n < greatest({ENDING_SEEN}, s_all * {ENDING}) AND NOT known AS unknown_word,
  CASE WHEN i3 + e3 >= {SEEN} THEN e3 < {TERMINAL} * (i3 + e3) WHEN i2 + e2 >= {SEEN} THEN e2 < {TERMINAL} * (i2 + e2)
       WHEN c <> '~' AND i1 + e1 >= {SEEN} THEN e1 < {TERMINAL_WORD} * (i1 + e1) ELSE false END AS not_terminal
FROM n
"""

# lengths without what was put after a text, so that a mark put after a cut doesn't hide the limit; few lengths are left, whatever the rows, so that one row has those of a field and backend
_LIMITS = f"""
WITH u AS (SELECT field_name, backend, t_hash, t_chars, t_bytes, t_tokens FROM $values WHERE NOT marked AND (open_structure OR NOT is_json)),
l AS (SELECT field_name, backend, unit, size, approx_count_distinct(t_hash) AS n
  FROM u LATERAL VIEW stack(3, 'chars', CAST(t_chars AS bigint), 'bytes', CAST(t_bytes AS bigint), 'tokens', t_tokens) x AS unit, size WHERE size IS NOT NULL GROUP BY 1, 2, 3, 4),
around AS (SELECT *, greatest(
    coalesce(sum(n) OVER (PARTITION BY field_name, backend, unit ORDER BY size RANGE BETWEEN 24 PRECEDING AND 4 PRECEDING), 0),
    coalesce(sum(n) OVER (PARTITION BY field_name, backend, unit ORDER BY size RANGE BETWEEN 4 FOLLOWING AND 24 FOLLOWING), 0)) / 21 AS usual FROM l),
piles AS (SELECT *, n >= {AT_LIMIT} AND n > {PILE} * usual AS pile FROM around)
SELECT field_name, backend, collect_list(size) FILTER (WHERE unit = 'chars') AS chars, collect_list(size) FILTER (WHERE unit = 'bytes') AS bytes, collect_list(size) FILTER (WHERE unit = 'tokens') AS tokens FROM (
  SELECT *, bool_or(pile) OVER (PARTITION BY field_name, backend, unit ORDER BY size RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING) AS below_3,
    bool_or(pile) OVER (PARTITION BY field_name, backend, unit ORDER BY size RANGE BETWEEN CURRENT ROW AND 1 FOLLOWING) AS below_1 FROM piles)
WHERE CASE unit WHEN 'bytes' THEN below_3 WHEN 'chars' THEN below_1 ELSE pile END AND n > {NEAR} * usual GROUP BY 1, 2
"""


def _plain(x: str) -> str:
    """A quotation in small letters without outer marks, white space as single blanks."""
    return f"regexp_replace(regexp_replace(lower({_bare(x)}), {_lit(r'(?U)\s+')}, ' '), {_lit('^[ \"“”«»„「]+|[ \"“”«»„」]+$')}, '')"


# last quotations against the stored ones of their record and passage
_QUOTES = f"""
WITH q AS (SELECT row_id, cited, {_plain('body')} AS quote FROM $values WHERE cited <> '' AND body IS NOT NULL),
s AS (SELECT record_id, trim(c.passage_id) AS passage_id, c.quoted_text FROM (SELECT record_id, explode(citations) AS c FROM $cites) WHERE c.quoted_text IS NOT NULL),
j AS (SELECT row_id, quote, {_plain('quoted_text')} AS stored FROM q JOIN s ON row_id = record_id AND cited = passage_id WHERE quote <> '')
SELECT row_id, CASE WHEN bool_or(stored = quote) THEN 'equal'
  WHEN bool_or(startswith(stored, quote) AND substr(stored, length(quote) + 1) RLIKE {_lit(r'[\p{L}\p{N}]')}) THEN 'more' END AS quoted
FROM j GROUP BY row_id, quote
"""

# claims without a sentence mark against the reply that they were taken from
_SOURCES = f"""
WITH c AS (SELECT row_id, record_id, source_start, source_end, {_bare('text')} AS t FROM $values JOIN (SELECT claim_key, text FROM $claims) ON row_id = claim_key
  WHERE field_name = 'claim_text' AND NOT marked),
j AS (SELECT row_id, t, source_start, source_end, raw_generation AS whole, {_bare('raw_generation')} AS reply FROM c JOIN (SELECT record_id, raw_generation FROM $records) USING (record_id) WHERE t <> ''),
k AS (SELECT row_id, t, endswith(reply, t) AS at_end, substr(whole, source_start + 1, source_end - source_start) AS span,
  if(source_start IS NULL OR source_end IS NULL, substr(whole, nullif(instr(whole, t), 0) + length(t), 3), NULL) AS next FROM j)
SELECT row_id, at_end, CASE
  WHEN startswith(span, t) THEN if(substr(span, length(t) + 1) RLIKE {_lit(r'[\p{L}\p{N}]')}, 'more', 'same')
  WHEN next RLIKE {_lit(r'^[\p{L}\p{N}]|^ \p{Ll}(?!\p{Lu})')} THEN 'more' END AS source
FROM k
"""

# what $sources is without claims; as it has no rows, its join falls out of the plan
_NO_SOURCES = "SELECT CAST(NULL AS bigint) AS row_id, CAST(NULL AS boolean) AS at_end, CAST(NULL AS string) AS source WHERE false"

_EVIDENCE = f"""
WITH j AS (SELECT v.*, e.ec, e.not_terminal, e.unknown_word AND in_letters AND (NOT is_cite OR body RLIKE {_lit(_PLAIN_WORD)}) AS mid_word,
    coalesce(array_contains(chars, CAST(t_chars AS bigint)), false) OR coalesce(array_contains(bytes, CAST(t_bytes AS bigint)), false)
      OR coalesce(array_contains(tokens, t_tokens), false) AS full, quoted, source, at_end
  FROM $values v LEFT JOIN $ends e ON v.field_name = e.field_name AND v.row_id = e.row_id
  LEFT JOIN $quotes q ON v.field_name = 'raw_generation' AND v.row_id = q.row_id LEFT JOIN $sources s ON v.field_name = 'claim_text' AND v.row_id = s.row_id
  LEFT JOIN $limits l ON v.field_name = l.field_name AND v.backend <=> l.backend)
SELECT field_name, row_id, record_id, backend, at_end, CASE
  WHEN broken THEN 'broken_character' WHEN n_chars < {LEAST_CHARS} THEN NULL WHEN open_structure THEN 'open_structure'
  WHEN quoted = 'more' THEN 'quote' WHEN quoted = 'equal' THEN NULL
  WHEN body IS NULL OR ec = '' THEN NULL
  WHEN source = 'same' AND NOT at_end THEN NULL
  WHEN full THEN 'at_limit' WHEN mid_word THEN 'mid_word'
  WHEN NOT is_cite AND not_terminal THEN 'trigram' WHEN source = 'more' THEN 'source' END AS evidence
FROM j
"""


def judged(spark: SparkSession, d: str, claim_texts: bool = True) -> DataFrame:
    """(field_name, row_id, backend, truncated, evidence) of every value that isn't null, redelivered rows once.

    An empty, blank or very short value has no end to lack: it isn't truncated.
    Marks of omission put after a text are looked through; a text that ends with
    a sentence mark is whole. A claim that ends where its cut reply does is cut
    like that. Without ``claim_texts`` only replies are judged; the counts are
    over all claim texts either way.
    """
    records = spool(once(table(spark, d, "query_records").select("record_id", "backend", "completion_tokens", "raw_generation"), "record_id"), "records")
    claims = once(table(spark, d, "claims").select("claim_key", "record_id", "text", "source_start", "source_end"), "claim_key")
    values = spool(query(spark, _VALUES, records=records, claims=claims if claim_texts else claims.where("false")), "values")
    words = spool(query(spark, _WORDS, records=records), "words")
    counts = spool(query(spark, _COUNTS, words=words, claims=claims), "counts")
    sources = query(spark, _SOURCES, values=values, claims=claims, records=records) if claim_texts else query(spark, _NO_SOURCES)
    judged_so = query(
        spark,
        _EVIDENCE,
        values=values,
        ends=spool(query(spark, _ENDS, values=values, words=words, counts=counts), "ends"),
        quotes=query(spark, _QUOTES, values=values, cites=table(spark, d, "claims").select("record_id", "citations")),
        sources=sources,
        limits=spool(query(spark, _LIMITS, values=values), "limits"),
    )
    if claim_texts:
        judged_so = query(
            spark,
            """SELECT v.field_name, v.row_id, v.backend, coalesce(v.evidence, if(at_end AND r.row_id IS NOT NULL, 'reply', NULL)) AS evidence
            FROM $v v LEFT JOIN (SELECT row_id FROM $v WHERE field_name = 'raw_generation' AND evidence IS NOT NULL) r ON v.field_name = 'claim_text' AND v.record_id = r.row_id""",
            v=spool(judged_so, "evidence"),
        )
    return judged_so.selectExpr("field_name", "row_id", "backend", "evidence IS NOT NULL AS truncated", "evidence")


def found(spark: SparkSession, d: str) -> DataFrame:
    """The truncated values."""
    return judged(spark, d).where("truncated").select("field_name", "row_id")


def rates(spark: SparkSession, d: str) -> DataFrame:
    """How often the values of each backend are truncated, by field; claims of unknown records have a null backend."""
    by = judged(spark, d).groupBy("backend", "field_name")
    return by.agg(F.count(F.lit(1)).alias("n_values"), F.count_if("truncated").alias("n_truncated"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("truncated_share"))


QUERIES = {"p6_found": found, "p6_rates": rates}
SQL: dict[str, str] = {}
