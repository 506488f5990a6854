"""Text functions as column expressions: sentences, spans, claim headers, quotes, tokens.

Three sentence rules exist side by side and are never interchangeable:
``sentence_spans`` (a mark before white space), ``split_before_capital`` and the
script-aware units of the training-data operators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The greatest words of a claim, the header of claim lines, and the contract of line replies.
MAX_WORDS = 50
CLAIM_HEAD = r"(?im)^[ \t]*CLAIM[ \t]+\d+[ \t]*:[ \t]*"
TOKEN = r"[\p{L}\p{N}_]{2,}"

# The English stop words of the common lexical index.
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())

_MARK = "\u0001"


def words(text: Column) -> Column:
    """Words between white space of any script."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Index tokens: small letters, two characters at least, without stop words."""
    all_ = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(all_, lambda t: ~t.isin(*sorted(STOP)))


def sentences(text: Column) -> Column:
    """Pieces that end with a mark before white space; blank ones are dropped, the text between stays as it is."""
    cut = F.regexp_replace(text, r"(?U)([.!?])\s+", "$1" + _MARK)
    return F.filter(F.split(cut, _MARK), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")) != "")


def sentence_spans(text: Column) -> Column:
    """array<struct<start, end>> of ``sentences``: pieces keep the white space behind them, so their lengths add up to offsets."""
    pieces = F.split(F.regexp_replace(text, r"(?U)([.!?]\s+)", "$1" + _MARK), _MARK)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, p):
        kept = F.char_length(F.regexp_replace(p, r"(?U)(?<=[.!?])\s+$", ""))
        span = F.array(F.struct(acc["at"].alias("start"), (acc["at"] + kept).alias("end")))
        blank = F.regexp_replace(p, r"(?U)\s+", "") == ""
        return F.struct((acc["at"] + F.char_length(p)).alias("at"), F.when(blank, acc["out"]).otherwise(F.concat(acc["out"], span)).alias("out"))

    return F.aggregate(pieces, empty, step, lambda acc: acc["out"])


def split_before_capital(text: Column) -> Column:
    """The other rule: a mark, white space, and a capital ASCII letter behind it."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+(?=[A-Z])", "$1" + _MARK), _MARK)


def capped(length: Column, limit: int) -> Column:
    """Consecutive pieces [start, end) of at most ``limit`` of a span of ``length``."""
    return F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(limit)), lambda p: F.struct(p.alias("start"), F.least(p + limit, length).alias("end")))


def window_starts(n: Column, size: int, stride: int) -> Column:
    """First items of sliding windows over n items; the tail is emitted once, by the first window that reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def stem(text: Column) -> Column:
    """White space collapsed, small letters, trailing marks off."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), r"[ .,;:]+$", "")


def claim_bodies(text: Column) -> Column:
    """Bodies of CLAIM lines that aren't blank, or the whole text if it has no such line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(CLAIM_HEAD))
    bodies = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, CLAIM_HEAD, ""))), lambda x: x != "")
    return F.when(F.size(lines) == 0, F.array(text)).otherwise(bodies)


def pack_clauses(text: Column, most: int = MAX_WORDS) -> Column:
    """Greedy packing of clauses (cut behind , and ;) into pieces of at most ``most`` words; a longer clause stays whole."""
    clauses = F.split(F.regexp_replace(text, r"(?U)([;,])\s+", "$1" + _MARK), _MARK)
    n = lambda x: F.size(words(x))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc, c):
        joined = F.when(acc["held"] == "", c).otherwise(F.concat(acc["held"], F.lit(" "), c))
        fits = (acc["held"] == "") | (n(joined) <= most)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]))).alias("done"), F.when(fits, joined).otherwise(c).alias("held"))

    return F.aggregate(clauses, empty, step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["held"])), lambda p: F.trim(p) != ""))


def pack_sentences(text: Column, most: int = 500) -> Column:
    """Greedy packing of whole sentences into chunks of at most ``most`` words; never empty."""
    n = lambda x: F.size(words(x))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc, c):
        joined = F.when(acc["held"] == "", c).otherwise(F.concat(acc["held"], F.lit(" "), c))
        fits = (acc["held"] == "") | (n(joined) <= most)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["held"]))).alias("done"), F.when(fits, joined).otherwise(c).alias("held"))

    return F.aggregate(sentences(text), empty, step, lambda acc: F.concat(acc["done"], F.array(acc["held"])))


def judge_score(reply: Column) -> Column:
    """A whole number from 0 to 100, with an optional % or period behind it, as a share; null for any other reply."""
    n = F.regexp_extract(reply, r"^\s*(\d{1,3})\s*%?\.?\s*$", 1)
    v = F.when(n != "", n.cast("int"))
    return F.when(v <= 100, v / 100.0)


def quote_candidates(text: Column) -> Column:
    """Sentences of ten characters or more, the same without their end marks, and clauses of fifteen or more; sorted, each once, all in the text."""
    flat = lambda a, least: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: F.char_length(x) >= least)
    full = flat(sentences(text), 10)
    bare = F.transform(full, lambda x: F.regexp_replace(x, r"[.!?]+$", ""))
    clauses = flat(F.split(text, r"[;:]\s+"), 15)
    return F.array_sort(F.array_distinct(F.filter(F.concat(full, bare, clauses), lambda x: F.contains(text, x))))


def prompt_tokens(text: Column) -> Column:
    """The rough size of a prompt: its words, or a quarter of its characters if that is more."""
    return F.greatest(F.size(words(text)), F.floor(F.char_length(text) / 4).cast("int"))


def first_prefix(name: Column, table: tuple[tuple[str, float], ...], default: float | None) -> Column:
    """The value of the first entry, in order, that the name contains."""
    out = F.lit(default)
    for prefix, value in reversed(table):
        out = F.when(F.contains(name, F.lit(prefix)), F.lit(value)).otherwise(out)
    return out


def blind_id(kind: str, seed: int, *parts: Column) -> Column:
    """An opaque id: the kind and twelve hexadecimal digits of a hash over seed and parts."""
    return F.concat(F.lit(kind + "_"), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), F.lit(str(seed)), *parts), 256), 1, 12))
