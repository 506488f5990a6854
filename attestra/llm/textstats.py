"""Statistics of many texts at once, and rules on them that tell prose from lists, tables and junk.

All code points of a batch are classed by one table lookup and counted per text
by one ``bincount``; only what needs words or lines is done text by text.
"""

from __future__ import annotations

import re

import numpy as np

# The thresholds of the rules.
RULES = {
    "symbol_ratio": 0.10,  # symbols per character, from here: symbol soup
    "inner_symbols": 0.10,  # symbols between letters per word, from here: damaged characters
    "vowel_share": 0.28,  # vowels per ASCII letter, below: random letters
    "blob_share": 0.50,  # characters in unbroken ASCII runs of 40 or more, from here: encoded bytes
    "dump_share": 0.50,  # words that are hexadecimal pairs, from here: memory dump
    "distinct_share": 0.50,  # distinct words per block of twelve, below: a phrase said over and over
    "wrong_bytes": 0.008,  # wrongly decoded bytes per character, from here: mojibake
    "menu_share": 0.50,  # characters in lines of short separated labels, from here: page menu
    "number_cells": 0.40,  # cells that hold a figure or a gap, from here: table
    "grid_share": 0.60,  # lines with equally many cells between tabs or framing bars, from here: table
    "bullet_share": 0.50,  # characters in lines with an item mark, from here: list
    "item_words": 5.0,  # words between line ends and separators, below, without sentence marks: list
    "sentence_rate": 0.30,  # sentence marks per twenty words, below: no sentence marks
}

# Frequent words of the languages written with Latin letters, and of Russian and Hindi.
COMMON = {
    "en": "the of and to in a is was were that for with by on as at from but not or be are this which had have than then an it no we who their after before under between",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus bei nach um wurde war unter über einen",
    "fr": "le la les de des du et à un une en dans que qui pour sur par au aux est a ont été avec sous chez ne pas plus se ce son ou",
    "es": "el la los las de del y en un una que por con para se su al es lo como más no fue con sobre entre tras o a",
    "ru": "и в не на что с по как из к у за от до для о но при после под через над или было был их",
    "hi": "के में की है को से का ने और पर यह कि था थी हैं एक तक दी गई इस ही बाद नहीं",
}
_COMMON = frozenset(w for ws in COMMON.values() for w in ws.split())

# Classes of code points; each has one.
OTHER, VOWEL, CONSONANT, DIGIT, SPACE, NEWLINE, SYMBOL, DASH, DOT, MARK, SEP, WIDE, THAI, STOP, CLOSER, LEAD, TRAIL, SLASH = range(18)


def _lookup() -> np.ndarray:
    t = np.zeros(0x110000, dtype=np.uint8)
    for chars, cls in (
        ("AEIOUYaeiouy", VOWEL),
        ("BCDFGHJKLMNPQRSTVWXZbcdfghjklmnpqrstvwxz", CONSONANT),
        ("0123456789", DIGIT),
        (" \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85      　", SPACE),
        ("\n", NEWLINE),
        ("#$%^&*+=~|<>{}\\@_¦§¤¬[]", SYMBOL),
        ("-–—", DASH),
        (".!?…", DOT),
        (":(", MARK),
        (",;", SEP),
        ("/", SLASH),
        ("。！？।؟", STOP),
        ("\"'”’»」』）)", CLOSER),
    ):
        for c in chars:
            t[ord(c)] = cls
    t[0x2000:0x200B] = SPACE
    t[0x3040:0x3100] = WIDE
    t[0x3400:0xA000] = WIDE
    t[0x0E00:0x0E80] = THAI
    # bytes of UTF-8 read as Windows-1252: a lead byte, then one of these
    for a in range(0xC2, 0xF5):
        t[a] = LEAD
    for a in [*range(0x80, 0xC0), 0x152, 0x153, 0x160, 0x161, 0x178, 0x17D, 0x17E, 0x192, 0x2C6, 0x2DC, *range(0x2018, 0x2023), 0x2026, 0x2030, 0x2039, 0x203A, 0x20AC, 0x2122, 0xFFFD]:
        if t[a] == OTHER:
            t[a] = TRAIL
    return t


_CLASS = _lookup()
BULLET = re.compile(r"^[ \t]*(?:[-*•–·▪‣◦]|->|\[[ xX]?\]|\[\d{1,3}\]|\([a-z0-9]{1,3}\)|[a-z0-9]{1,2}[.)])[ \t]+\S", re.M)
_MENU = re.compile(r"^(?:[^\W\d]{1,16}(?: [^\W\d]{1,16})?\s+[|·›»]\s+){2,}[^\W\d]{1,16}(?: [^\W\d]{1,16})?\s*$")
_HEX = re.compile(r"[0-9a-fA-F]{2}")
_INNER_CAPITAL = re.compile(r"(?<=[a-z0-9] )[A-Z][a-z]")
_BLOCK = 12

# Published rules for documents of web corpora, with their figures. Words and stop words, mean word
# length, symbols to words, alphabetic words, bullet and ellipsis lines: Rae et al. 2021, "Scaling Language Models",
# table A1. Lines that end in a mark: Raffel et al. 2020, "Exploring the Limits of Transfer Learning", section 2.2.
PUBLISHED = {
    "words_least": 50, "words_most": 100_000, "mean_word_least": 3.0, "mean_word_most": 10.0, "symbols_to_words": 0.1, "alphabetic_words": 0.8,
    "bullet_lines": 0.9, "ellipsis_lines": 0.3, "stop_words": 2, "line_ends": 0.5,
}
STOP_WORDS = frozenset("the be to of and that have with".split())

COUNTS = ("chars", "lines", "words", "terminators", "line_ends")
RATIOS = ("mean_word", "symbol_ratio", "line_end_share", "bullet_share", "common_share", "cell_share")


def _grid(rows: list[str]) -> float:
    """The share of lines that have the most frequent number of cells, where lines are divided by tabs or framed by bars."""
    cells = [x.count("\t") if "\t" in x else x.count("|") - 1 if x.strip().startswith("|") and x.strip().endswith("|") else 0 for x in rows]
    most = max((cells.count(k) for k in set(cells) if k > 0), default=0)
    return most / len(rows) if most > 1 else 0.0


def statistics(texts: list[str], full: bool = True) -> dict[str, np.ndarray]:
    """The statistics of each text; an empty text has zeros.

    Without ``full``, common_share is computed only where a rule depends on it.
    """
    n = len(texts)
    length = np.fromiter((len(t) for t in texts), dtype=np.int64, count=n)
    # one blank between texts, so that no pair of neighbours spans two of them
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cls = _CLASS[codes]
    owner = np.repeat(np.arange(n), length + 1)
    counts = np.bincount(owner * 18 + cls, minlength=n * 18).reshape(n, 18)
    counts[:, NEWLINE] -= 1

    def per(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n)

    prev = np.concatenate([[NEWLINE], cls[:-1]])
    nxt = np.concatenate([cls[1:], [NEWLINE]])
    blank = (cls == SPACE) | (cls == NEWLINE)
    prev_blank = (prev == SPACE) | (prev == NEWLINE)
    nxt_blank = np.concatenate([blank[1:], [True]])
    nxt2_blank = np.concatenate([blank[2:], [True, True]])[: len(cls)]
    words = per(~blank & prev_blank)
    ends = ((cls == DOT) & (nxt_blank | ((nxt == CLOSER) & nxt2_blank))) | (cls == STOP)
    terminators = per(ends & (prev != DOT) & (prev != STOP))
    line_ends = per(((cls == DOT) | (cls == STOP)) & ((nxt == NEWLINE) | ((nxt == CLOSER) & (np.concatenate([cls[2:], [NEWLINE, NEWLINE]])[: len(cls)] == NEWLINE))))
    letter = (cls == VOWEL) | (cls == CONSONANT)
    inner = per((cls == SYMBOL) & (letter | (cls == DIGIT))[np.maximum(np.arange(len(cls)) - 1, 0)] & np.concatenate([letter[1:], [False]]))
    wrong = per((prev == LEAD) & (cls == TRAIL)) + per(codes == 0xFFFD)
    # cells: tokens between white space and separators
    bar = blank | (codes == ord("|")) | (cls == SEP) | (codes == ord("<")) | (codes == ord(">"))
    start = ~bar & np.concatenate([[True], bar[:-1]])
    nxt_bar = np.concatenate([bar[1:], [True]])
    nxt_digit = np.concatenate([cls[1:] == DIGIT, [False]])
    figure = start & ((cls == DIGIT) | ((cls == DASH) & nxt_bar) | ((codes == ord("n")) & (nxt == SLASH)) | ((codes == ord("(")) & nxt_digit))
    rule = start & (cls == DASH) & (nxt == DASH)
    tokens, figures = per(start & ~rule), per(figure)
    separators = per(((cls == SEP) | (cls == SLASH)) & (nxt == SPACE))

    one = np.maximum(length, 1)
    w1 = np.maximum(words, 1)
    weight = words + counts[:, WIDE] * 0.5 + counts[:, THAI] * 0.2
    letters = counts[:, VOWEL] + counts[:, CONSONANT]
    lines, bullets, blob, distinct, common, menu, dump, capitals, grid, bullet_lines, ellipses, alphabetic, stops = (np.zeros(n) for _ in range(13))
    for i, t in enumerate(texts):
        rows = [x for x in t.split("\n") if x and not x.isspace()]
        lines[i] = len(rows)
        for x in rows:
            if BULLET.match(x):
                bullets[i] += len(x)
                bullet_lines[i] += 1
        grid[i] = _grid(rows) if "\t" in t or "|" in t else 0.0
        if full:
            ellipses[i] = sum(x.rstrip().endswith(("...", "…")) for x in rows)
        ws = t.lower().split()
        if not ws:
            continue
        if full:
            alphabetic[i] = sum(any(map(str.isalpha, w)) for w in ws) / len(ws)
            stops[i] = len(STOP_WORDS.intersection(ws))
        blob[i] = sum(len(w) for w in ws if len(w) >= 40 and w.isascii() and w.replace("+", "").replace("/", "").replace("=", "").isalnum())
        bare = counts[i, DOT] + counts[i, SEP] + counts[i, MARK] <= 0.02 * len(ws)
        if full or bare:
            common[i] = len(list(filter(_COMMON.__contains__, ws))) / len(ws)
        got = [len(set(ws[a : a + _BLOCK])) for a in range(0, len(ws) - _BLOCK + 1, _BLOCK)]
        distinct[i] = sum(got) / (_BLOCK * len(got)) if got else (len(set(ws)) / len(ws) if len(ws) >= 6 else 1.0)
        if t.count(" | ") + t.count(" · ") + t.count(" › ") + t.count(" » ") >= 2:
            menu[i] = sum(len(x) for x in rows if _MENU.match(x)) / len(t)
        if len(t) < 4 * len(ws):
            dump[i] = sum(len(w) == 2 and _HEX.fullmatch(w) is not None for w in ws) / len(ws)
        if bare:
            capitals[i] = len(_INNER_CAPITAL.findall(t)) / len(ws)
    return {
        "chars": length,
        "lines": lines.astype(np.int64),
        "words": words,
        "terminators": terminators,
        "line_ends": line_ends,
        "letters": letters,
        "marks": counts[:, DOT] + counts[:, SEP] + counts[:, MARK] + counts[:, CLOSER],
        "separators": separators,
        "mean_word": (length - counts[:, SPACE] - counts[:, NEWLINE]) / w1,
        "symbol_ratio": counts[:, SYMBOL] / one,
        "inner_symbols": inner / w1,
        "line_end_share": line_ends / np.maximum(lines, 1),
        "bullet_share": bullets / one,
        "common_share": common,
        "cell_share": np.where(figures >= 3, figures / np.maximum(tokens + counts[:, WIDE] * 0.25 + counts[:, THAI] * 0.1, 1), 0.0),
        "vowel_share": counts[:, VOWEL] / np.maximum(letters, 1),
        "blob_share": blob / one,
        "dump_share": dump,
        "distinct_share": distinct,
        "wrong_bytes": wrong / one,
        "menu_share": menu,
        "inner_capitals": capitals,
        "item_words": weight / np.maximum(lines + separators, 1),
        "sentence_rate": terminators / (weight / 20 + 1),
        "grid_share": grid,
        "bullet_lines": bullet_lines / np.maximum(lines, 1),
        "ellipsis_lines": ellipses / np.maximum(lines, 1),
        "alphabetic_words": alphabetic,
        "stop_words": stops,
        "symbols_to_words": np.fromiter((t.count("#") + t.count("...") + t.count("…") for t in texts), dtype=np.int64, count=n) / w1,
        "markup": np.fromiter((t.count("</t") for t in texts), dtype=np.int64, count=n),
    }


def failed_rules(s: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray]]:
    """The rules in the order in which they decide, each with the texts that fail it."""
    r = RULES
    listed = s["bullet_share"] >= r["bullet_share"]
    cells = (s["cell_share"] >= r["number_cells"]) & (s["lines"] >= 2) & ~listed
    grid = (s["grid_share"] >= r["grid_share"]) & ~listed
    tabular = cells | grid | (s["markup"] >= 4)
    return [
        ("junk_empty", s["words"] == 0),
        ("junk_blob", s["blob_share"] >= r["blob_share"]),
        ("junk_dump", s["dump_share"] >= r["dump_share"]),
        ("junk_repeat", (s["distinct_share"] < r["distinct_share"]) & (s["words"] >= 6) & ~tabular & ~listed),
        ("junk_wrong_bytes", s["wrong_bytes"] >= r["wrong_bytes"]),
        ("junk_menu", s["menu_share"] >= r["menu_share"]),
        ("junk_symbols", (s["symbol_ratio"] >= r["symbol_ratio"]) & ~tabular & (s["bullet_share"] < 0.3)),
        ("junk_damaged", (s["inner_symbols"] >= r["inner_symbols"]) & ~tabular & ~listed & (s["words"] >= 8)),
        ("junk_letters", (s["letters"] >= 0.6 * s["chars"]) & (s["letters"] >= 40) & (s["vowel_share"] < r["vowel_share"])),
        ("junk_shuffled", (s["words"] >= 15) & (s["marks"] <= 0.01 * s["words"]) & (s["inner_capitals"] >= 0.015) & (s["common_share"] >= 0.1) & (s["separators"] == 0) & (s["bullet_share"] == 0)),
        ("table_markup", s["markup"] >= 4),
        ("table_cells", cells),
        ("table_grid", grid),
        ("list_bullets", listed),
        ("list_items", (s["item_words"] < r["item_words"]) & (s["sentence_rate"] < r["sentence_rate"]) & (s["lines"] + s["separators"] >= 3)),
    ]


def failed_published(s: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray]]:
    """The published rules that a text fails. They are for English web pages, so they are recorded and decide no kind."""
    p = PUBLISHED
    return [
        ("published_words", (s["words"] < p["words_least"]) | (s["words"] > p["words_most"])),
        ("published_mean_word", (s["mean_word"] < p["mean_word_least"]) | (s["mean_word"] > p["mean_word_most"])),
        ("published_symbols", s["symbols_to_words"] > p["symbols_to_words"]),
        ("published_alphabetic", s["alphabetic_words"] < p["alphabetic_words"]),
        ("published_bullets", s["bullet_lines"] > p["bullet_lines"]),
        ("published_ellipses", s["ellipsis_lines"] > p["ellipsis_lines"]),
        ("published_stop_words", s["stop_words"] < p["stop_words"]),
        ("published_line_ends", s["line_end_share"] < p["line_ends"]),
    ]


def kinds(texts: list[str], full: bool = True) -> tuple[dict[str, np.ndarray], list[str], list[list[str]]]:
    """(statistics, kind, names of the failed rules) of each text; the first failed rule gives the kind."""
    s = statistics(texts, full)
    why: list[list[str]] = [[] for _ in texts]
    for name, hit in failed_rules(s):
        for i in np.flatnonzero(hit):
            why[i].append(name)
    decided = [w[0].split("_")[0] if w else "prose" for w in why]
    if full:
        for name, hit in failed_published(s):
            for i in np.flatnonzero(hit):
                why[i].append(name)
    return s, decided, why
