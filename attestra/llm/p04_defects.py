"""Problem 4: question and reply pairs that fail, with the kind of defect.

For every kind several labelling functions vote, each of them noisy: families of
wording, lengths, overlap with the question, languages and scripts, ends of
texts, and the errors that parsing left. A label model per kind learns from all
votes how far each function can be trusted and turns them into a posterior;
kinds whose posterior reaches the cutoff are kept, so that one reply may have
several, and where one is wanted the highest posterior wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import spool
from ..sources.tables import once, table
from . import labelmodel, p06_truncated

#: Rows that the starting accuracies count as in the label model; few, so that the votes decide.
STRENGTH = 40.0
#: Share of a reply's sentences and lines above which those that decline are the reply, not a remark in a longer one.
DECLINE = 0.5
#: The order in which kinds with equal posteriors win, where one label is wanted.
KINDS = ("empty", "copied_question", "refusal", "wrong_language", "truncated")
#: Posterior from which a kind is kept; ``tests/llm/test_defects.py`` validates them on planted defects.
CUTOFF = {"empty": 0.5, "truncated": 0.5, "refusal": 0.5, "copied_question": 0.5, "wrong_language": 0.5}

# Function words that tell the languages of questions and replies apart.
WORDS = {
    "en": "the of and to was were that for with by on at from is are does can should than not after between given had",
    "de": "der die das und von zu mit bei ist im den nicht ein eine als auch nach um wurde unter für kann sank früh",
    "fr": "le les des du et à une dans sur par au est avec sous chez pour ont été sont ce où",
    "es": "el los las del y una con por para es más entre tras fue cuando sobre lo mejor su",
    "ru": "и в не на что с по у для при после из до",
}

# Function words that two of these languages share.
SHARED = {"en": "in a an as no", "de": "in so am", "fr": "de la en un que se a", "es": "de la en un que se a durante"}

# The speaker, words of inability, regret, what answers are drawn from, and what is asked for.
_SPEAKER = r"\b(?:i|we|me|us|my|our|i'm|i’m|i'd|i’d)\b"
_UNABLE = r"\b(?:not|cannot|can't|can’t|won't|won’t|don't|don’t|couldn't|couldn’t|wouldn't|wouldn’t|isn't|isn’t|unable|decline|refuse|refrain|rather|outside|afraid|keeps?|prevents?)\b"
_REGRET = r"\b(?:sorry|apologies|regrettably|unfortunately|leider|entschuldigung|tut mir leid|désolée?|malheureusement|lo siento|por desgracia|lamentablemente|desafortunadamente)\b|抱歉|很遗憾|对不起|申し訳"
_GIVEN = r"\b(?:passages|excerpts|context|sources|documents|evidence|quellen|auszüge|textstellen|extraits|passages|pasajes|extractos|fuentes)\b"
_LACKING = r"\b(?:not|none|silent|no|insufficient|cannot|don't|don’t|doesn't|doesn’t|keine?|nicht|ne|pas|no)\b"
_ASKED = r"\b(?:answer|answered|answering|verdict|conclusion|judge|said|assess|assessment|basis|question|request|topic|matter|rephrase|respond|comment|ask)\b"
_DEFER = r"\b(?:nothing|no|only an? \w+ should|please ask|could you|need to ask|as an? (?:ai|careful|language)\b.{0,20}\b(?:assistant|model))\b"

# The same in languages whose verbs hold the speaker.
_OTHERS = (
    r"\b(?:ich|wir) (?:kann|können|darf|dürfen|möchte|muss)\b|\b(?:kann|darf) ich\b|\bkeine (?:auskunft|antwort|aussage)\b",
    r"\bje (?:ne|n'|n’|regrette|préfère)|\bne permettent pas\b|\bpas en mesure\b",
    r"\bno (?:puedo|podemos|me es posible|permiten|es posible)\b",
    r"无法(?:回答|判断|作答|提供)|不能(?:提供|回答)|不足以|お答えできません|答えられません",
)

_LEADS = re.compile(r"^[\s>*#\"“-]*(?:(?:you asked|question|q|frage|pregunta|la question|vous demandez|sie fragen|usted pregunta|您问|问题|問題|質問)\s*[:：.]?\s+|[>]\s*)?")
_BLANKS = ("", "null", "na", "none", "nil", "answer", "answeranswer", "noanswer", "empty", "undefined", "decision", "claim1", "decisionclaim1", "text", "todo", "tbd")


def body(raw: Column) -> Column:
    """The reply's own statements: claim texts of JSON replies, else its lines without decisions, quoted evidence and numbering."""
    texts = F.array_join(F.regexp_extract_all(raw, F.lit(r'"(?:text|claim|answer|statement)"\s*:\s*"((?:[^"\\]|\\.)*)'), F.lit(1)), "\n")
    bare = F.regexp_replace(raw, r'"\w+"\s*:|\b(?:null|yes|no|maybe|true|false)\b|[{}\[\]",`]', "")
    lines = F.regexp_replace(raw, r"(?m)^[ \t]*(?:CITE\b.*|DECISION[ \t]*:?[ \t]*\w*[ \t]*$|```\w*|(?:CLAIM[ \t]*\d*[ \t]*:|\d+[.)]|[-*][ \t])[ \t]*)", "")
    return F.when(raw.rlike(r"^\s*(?:```\w*\s*)?[\{\[]"), F.coalesce(F.nullif(texts, F.lit("")), bare)).otherwise(lines)


_LATIN, _OTHER = re.compile(r"[A-Za-zÀ-ɏ]"), re.compile(r"[Ͱ-῿぀-鿿가-힯]")
LANGS = (*WORDS, "ja", "zh", "ar", "th", "hi")
_OWN = {k: frozenset(v.split()) for k, v in WORDS.items()}
_ALSO = {k: frozenset(v.split()) for k, v in SHARED.items()}
#: Languages that a word is of, and those that share it.
_TOLD = {w: ([k for k in _OWN if w in _OWN[k]], [k for k in _ALSO if w in _ALSO[k]]) for w in frozenset().union(*_OWN.values(), *_ALSO.values())}
_WORD = re.compile(r"[^\W\d_]+")
_SCRIPTS = (("ja", re.compile(r"[぀-ヿ]")), ("zh", re.compile(r"[一-鿿]")), ("ar", re.compile(r"[؀-ۿ]")), ("th", re.compile(r"[฀-๿]")), ("hi", re.compile(r"[ऀ-ॿ]")))


def language_scores(text: str, words: Counter | None = None) -> dict[str, tuple[float, float]]:
    """Per language (words of its own, all its words) in a text of small letters; scripts of their own score by characters."""
    out = dict.fromkeys(LANGS, (0.0, 0.0))
    words = Counter(_WORD.findall(text)) if words is None else words
    own, also = dict.fromkeys(WORDS, 0), dict.fromkeys(WORDS, 0)
    for w in words.keys() & _TOLD.keys():
        mine, shared = _TOLD[w]
        for k in mine:
            own[k] += words[w]
        for k in shared:
            also[k] += words[w]
    for k, n in own.items():
        out[k] = (n, 2 * n + also[k])
    if not text.isascii() and _OTHER.search(text):
        seen = {k: len(p.findall(text)) for k, p in _SCRIPTS}
        if seen["ja"] >= 2:
            seen["ja"], seen["zh"] = seen["ja"] + seen["zh"], 0
        else:
            seen["ja"] = 0
        for k, n in seen.items():
            n = n if k in ("ja", "zh") else n // 4
            out[k] = (n, 2 * n)
    return out


_FAMILIES = {
    "person": (re.compile(_SPEAKER), re.compile(_UNABLE)),
    "regret": (re.compile(_REGRET), None),
    "given": (re.compile(_GIVEN), re.compile(_LACKING)),
    "asked": (re.compile(_ASKED), re.compile(_DEFER)),
    "others": (re.compile("|".join(_OTHERS)), None),
}
#: Words without one of which a family can't be met, so that its patterns needn't be tried.
_NEEDS = {k: frozenset(re.findall(r"[^\W\d_]{2,}", re.sub(r"\\b|’|'", " ", x))) for k, x in {"regret": _REGRET, "given": _GIVEN, "asked": _ASKED, "others": "|".join(_OTHERS)}.items()}
_NEEDS["person"] = frozenset(("i", "we", "me", "us", "my", "our"))
_REPORTED = re.compile(r"\d")
_PARTS = re.compile(r"(?<=[.!?])\s+|(?<=[。！？।؟])|\n")
_NOT_TEXT = re.compile(r"[\W_]+")


def _script(text: str) -> str | None:
    """The script of most letters; characters of scripts without letters count as many."""
    if text.isascii():
        return "latin" if _LATIN.search(text) else None
    other = len(_OTHER.findall(text))
    if other == 0:
        return "latin" if _LATIN.search(text) else None
    return "other" if 3 * other > len(_LATIN.findall(text)) else "latin"


def _best(scores: dict) -> str | None:
    k = max(scores, key=lambda x: scores[x][1])
    return k if scores[k][1] else None


READ = ("empty_blank", "empty_short", "refusal_person", "refusal_given", "refusal_asked", "refusal_share", "refusal_short", "refusal_apart",
        "copied_text", "copied_words", "copied_length", "language_best", "language_margin", "language_absent", "language_script")


def read(q: str, b: str) -> tuple[int, ...]:
    """The votes of READ on a question and a reply's own statements, which are read whole."""
    low, asks = b.lower(), q.lower()
    nb, nq = _NOT_TEXT.sub("", _LEADS.sub("", low)), _NOT_TEXT.sub("", asks)
    words, sought = Counter(_WORD.findall(low)), set(_WORD.findall(asks))
    shared = sum(w in words for w in sought)
    seen = dict.fromkeys(_FAMILIES, 0)
    tried = {k: f for k, f in _FAMILIES.items() if not _NEEDS[k].isdisjoint(words) or (k in ("regret", "others") and _OTHER.search(low))}
    declining = parts = 0
    for part in _PARTS.split(low):
        if not _WORD.search(part):
            continue
        parts += 1
        hit = {k: bool(x.search(part)) and (y is None or bool(y.search(part))) for k, (x, y) in tried.items()} if tried and not _REPORTED.search(part) else {}
        declining += any(hit.values())
        for k, h in hit.items():
            seen[k] += h
    said, ql = language_scores(low, words), _best(language_scores(asks))
    bl = _best(said)
    other = ql is not None and bl is not None and ql != bl
    own, top = said[ql][0] if ql else 0, max(x for x, _ in said.values())
    sq, sb = _script(q), _script(b)
    return (
        nb in _BLANKS, len(nb) < 4,
        seen["person"] + seen["regret"] + seen["others"] > 0, seen["given"] > 0, seen["asked"] > 0,
        parts > 0 and declining > DECLINE * parts, 3 < len(nb) < 260 and not _REPORTED.search(b), parts > 0 and shared <= 0.5 * len(sought),
        len(nq) > 10 and len(nb) > 5 and nq in nb and len(nb.replace(nq, "")) <= 30,
        len(sought) > 1 and shared >= 0.85 * len(sought) and len(words) <= 1.25 * len(sought) + 2, 0.8 * len(nq) <= len(nb) <= 1.4 * len(nq) + 5,
        other, other and top >= 1 and top > 2.5 * own, other and own == 0, sq is not None and sb is not None and sq != sb,
    )


def votes(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, one 0/1 column per labelling function) of every record, redelivered rows once."""
    rec = once(table(spark, d, "query_records").select("record_id", "question", "raw_generation"), "record_id")
    err = table(spark, d, "decompositions").groupBy("record_id").agg(F.array_join(F.flatten(F.collect_set("errors")), "\n").alias("err"))
    cut = p06_truncated.judged(spark, d, claim_texts=False).where("truncated").select(F.col("row_id").alias("record_id"), F.lit(1).alias("cut"))
    raw, e = F.coalesce("raw_generation", F.lit("")), F.coalesce("err", F.lit(""))
    x = rec.join(err, "record_id", "left").join(cut, "record_id", "left").select(
        "record_id", F.coalesce("question", F.lit("")).alias("q"), body(raw).alias("b"),
        e.rlike("nothing to decompose|no claim line|body missing").alias("empty_errors"),
        F.coalesce("cut", F.lit(0)).alias("truncated_end"),
        e.rlike("ends without text|unterminated").alias("truncated_errors"),
        (~F.expr(p06_truncated._bare("coalesce(raw_generation, '')")).rlike(r"[.!?。！？।؟\]\}][\"'”’»)]*$")).alias("truncated_open"),
        (~(F.contains(raw, F.lit("CITE")) | F.contains(raw, F.lit("passage_id")))).alias("refusal_bare"),
        e.rlike("no claim line|nothing to decompose").alias("refusal_errors"),
    )
    given = [c for c in x.columns if c not in ("record_id", "q", "b")]
    x = x.select("record_id", "q", "b", *[F.col(c).cast("int").alias(c) for c in given])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([read(q, b) for q, b in zip(pdf["q"], pdf["b"])], columns=list(READ)).astype("int32")
            yield pd.concat([pdf[["record_id", *given]], out], axis=1)

    return x.mapInPandas(run, "record_id bigint, " + ", ".join(f"{c} int" for c in (*given, *READ)))


# Per kind its functions with their starting chances of a vote with and without the defect.
FUNCTIONS = {
    "empty": {"empty_blank": (0.9, 0.001), "empty_short": (0.9, 0.003), "empty_errors": (0.5, 0.03)},
    "truncated": {"truncated_end": (0.95, 0.0005), "truncated_errors": (0.4, 0.002), "truncated_open": (0.85, 0.4)},
    "refusal": {
        "refusal_person": (0.6, 0.01), "refusal_given": (0.3, 0.02), "refusal_asked": (0.5, 0.02), "refusal_share": (0.9, 0.002), "refusal_short": (0.97, 0.05),
        "refusal_apart": (0.9, 0.3), "refusal_bare": (0.85, 0.35), "refusal_errors": (0.3, 0.02),
    },
    "copied_question": {"copied_text": (0.9, 0.001), "copied_words": (0.9, 0.002), "copied_length": (0.9, 0.03)},
    "wrong_language": {"language_best": (0.95, 0.005), "language_margin": (0.9, 0.002), "language_absent": (0.8, 0.005), "language_script": (0.4, 0.003)},
}


def models(v: DataFrame) -> dict[str, labelmodel.Model]:
    """A fitted label model per kind. One pass counts the patterns of votes of all kinds, at most 2**functions of each, for the driver to fit."""
    mask = lambda names: sum((F.col(c) * F.lit(1 << i) for i, c in enumerate(names)), F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), mask(f).alias("mask")) for k, f in FUNCTIONS.items()]))
    rows = v.select(each.alias("x")).groupBy("x.kind", "x.mask").count().collect()
    out = {}
    for kind, functions in FUNCTIONS.items():
        seen = [(r["mask"], r["count"]) for r in rows if r["kind"] == kind]
        bits = np.array([[m >> i & 1 for i in range(len(functions))] for m, _ in seen], dtype=float).reshape(-1, len(functions))
        out[kind] = labelmodel.fit(bits, np.array([n for _, n in seen], dtype=float), [a for a, _ in functions.values()], [b for _, b in functions.values()], strength=STRENGTH)
    return out


def posteriors(v: DataFrame) -> DataFrame:
    """(record_id, one posterior per kind)."""
    fitted, columns = models(v), []
    for kind, functions in FUNCTIONS.items():
        m = fitted[kind]
        logit = F.lit(float(np.log(m.prior) - np.log1p(-m.prior)))
        for c, h, f in zip(functions, m.hit, m.false):
            logit = logit + F.when(F.col(c) == 1, float(np.log(h) - np.log(f))).otherwise(float(np.log1p(-h) - np.log1p(-f)))
        columns.append((1 / (1 + F.exp(-logit))).alias(kind))
    return v.select("record_id", *columns)


def _posteriors(spark: SparkSession, d: str) -> DataFrame:
    return posteriors(spool(votes(spark, d), "votes"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, defect_type, posterior): every kind above its cutoff; a null reply counts as empty."""
    p = _posteriors(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("defect_type"), F.col(k).alias("posterior"), F.lit(CUTOFF[k]).alias("cutoff")) for k in KINDS]))
    return p.select("record_id", each.alias("x")).select("record_id", "x.*").where("posterior >= cutoff").select("record_id", "defect_type", F.round("posterior", 6).alias("posterior"))


def found(spark: SparkSession, d: str) -> DataFrame:
    """The defective records, each with the kind of the highest posterior among those above their cutoffs; KINDS orders equal ones."""
    p = _posteriors(spark, d)
    over = {k: F.when(F.col(k) >= CUTOFF[k], F.round(k, 6)).otherwise(F.lit(-1.0)) for k in KINDS}
    top = F.greatest(*over.values())
    kind = F.when(top >= 0, F.coalesce(*[F.when(over[k] == top, F.lit(k)) for k in KINDS]))
    return p.select("record_id", kind.alias("defect_type")).where("defect_type is not null")


QUERIES = {"p4_found": found, "p4_labels": labels}
SQL: dict[str, str] = {}
