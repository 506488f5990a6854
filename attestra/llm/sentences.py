"""Sentence units of texts in many languages and scripts.

Which periods end a sentence is decided by evidence: a word that the document
itself shows with a period before a small letter, a comma or a figure is an
abbreviation there. Where the document is silent, counts over the whole corpus
decide: words that hardly occur without their period are abbreviations, and in
scripts without capitals, or without any sentence mark, the words and syllables
that open lines tell where sentences may begin.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from .textstats import BULLET

#: Lines longer than this aren't taken for wrapped ones.
WRAP_LIMIT = 130
#: Of all line openings of a script, the least share that makes a word an opener.
OPENER_SHARE = 0.003

# Abbreviations in general use, by which a document without evidence is read before corpus counts exist.
SEED = {
    "en": "dr prof mr mrs ms st vs e.g i.e cf fig figs approx incl etc al ph.d m.d a.m p.m q.i.d b.i.d t.i.d i.v p.o i.m s.c ver no vol pp dept est",
    "de": "dr prof d h z b ca abb bzw u a usw evtl ggf inkl nr vgl i v",
    "fr": "m mme mlle dr p ex env fig etc cf",
    "es": "dr dra sr sra p ej aprox fig etc núm",
    "ru": "др рис мес т е д табл г см тыс",
    "hi": "डॉ",
    "ar": "د",
}
_SEED = frozenset(w for ws in SEED.values() for w in ws.split())

_OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
_CLOSE = set(_OPEN.values()) | {"”"}
_EVENT = re.compile(r"[.!?…。！？।؟\"“”„«»「」『』()（）\[\]]")
_EDGES = "\"“”„«»「」『』()（）[],;:"
_BEFORE = re.compile(r"[^\s\"“”„«»「」『』()（）\[\],;:]+$")
_NAME = re.compile(r"(?<=[a-zß-öø-ÿа-яё,] )[A-ZÀ-ÞА-Я][^\W\d_]++(?!\.)")
_PLAIN = re.compile(r"\b[a-zß-öø-ÿа-яё][^\W\d_]+")
_SOFT = re.compile(r"\.(?=,|\s+[a-zß-öø-ÿа-яё](?![A-Z]))")
_THAI = re.compile(r"[฀-๿]")
_BIG = re.compile(r"[A-ZÀ-ÞА-Я]+")
_SMALL = re.compile(r"[a-zß-ÿа-я]+")
_LATIN_DOT = ".…"

# Months that follow an ordinal figure with a period.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
_HARD_STOPS = "。！？।؟"


def script(c: str) -> str:
    """Which group of caseless letters a character belongs to; empty for the rest."""
    o = ord(c)
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000:
        return "wide"
    if 0x0E00 <= o < 0x0E80:
        return "thai"
    if 0x0600 <= o < 0x0700:
        return "arabic"
    if 0x0900 <= o < 0x0980:
        return "deva"
    return ""


def opening(text: str, at: int, end: int) -> str:
    """What stands for the beginning of text[at:end] in the counts of openings."""
    c = text[at]
    if c.isdigit():
        return "0"
    s = script(c)
    if s == "wide":
        b = text[at + 1] if at + 1 < end else ""
        return c + (b if b and script(b) == "wide" else "")
    if s == "thai":
        j = at
        while j < end and j < at + 5 and script(text[j]) == "thai":
            j += 1
        return text[at:j]
    j = at
    while j < end and j < at + 16 and (text[j].isalpha() or script(text[j]) == s != ""):
        j += 1
    return text[at:j].lower() if j > at else c


@dataclass
class Corpus:
    """Counts over all documents; every table holds only entries above a share of its total, so its size is bounded."""

    abbreviations: frozenset = frozenset()
    titles: frozenset = frozenset()
    openers: dict = field(default_factory=dict)  # opening -> share of the openings of its script
    words: dict = field(default_factory=dict)  # small word -> (openings, occurrences)


def _back(text: str, i: int) -> int:
    """Where the word begins that ends before ``i``: behind white space, a bracket or a mark, or four periods back.

    Inner periods are limited so that a text without blanks is passed a few times, not once per period.
    """
    k, periods = i, 0
    while k > 0:
        c = text[k - 1]
        if c.isspace() or c in _EDGES:
            break
        if c == "." and (periods := periods + 1) > 4:
            break
        k -= 1
    return k


def softened(text: str) -> list[str]:
    """The words that stand with a period before a comma or a small letter."""
    out = []
    for m in _SOFT.finditer(text):
        w = _BEFORE.match(text, _back(text, m.start()), m.start())
        if w and w[0][0].isalpha() and w[0][-1] != ".":
            out.append(w[0].lower())
    return out


def count(texts: Iterable[str]) -> Counter:
    """Counts that make a Corpus: keys are (kind, word)."""
    c: Counter = Counter()
    tokens: Counter = Counter()
    for t in texts:
        tokens.update(t.split())
        for w in softened(t):
            c["inner", w] += 1
        first = True
        for s in t.split("\n"):
            size = len(s)
            if size < 25:
                first = first or not s or s.isspace()
                continue
            if s[-1] == ".":
                k = s.rfind(" ", size - 7, size - 1)
                if k > 0:
                    c["last", s[k + 1 : -1].lower()] += 1
            if first or size > WRAP_LIMIT:
                first = False
                s = s.strip()
                if not BULLET.match(s) and "|" not in s and "\t" not in s and "<t" not in s and "; " not in s[:30]:
                    j = 0
                    while j < len(s) and s[j] in "\"“„«「『¿¡([":
                        j += 1
                    if j < len(s):
                        c["open", opening(s, j, len(s))] += 1
                        c["lines", script(s[j]) or "cased"] += 1
    for w, n in tokens.items():
        if len(w) <= 10:
            if w[-1] == ".":
                k = w.strip("([\"“„«")[:-1].lower()
                if k and k[0].isalpha() and k[-1] != ".":
                    c["dot", k] += n
            elif w.isalpha() and len(w) <= 8:
                c["word", w.lower()] += n
    return c


def corpus_from(rows: Iterable[tuple[str, str, int]]) -> Corpus:
    """Turn summed counts into decisions."""
    by: dict[str, dict[str, int]] = {}
    for kind, key, n in rows:
        by.setdefault(kind, {})[key] = n
    dot, word, inner, last, lines = (by.get(k, {}) for k in ("dot", "word", "inner", "last", "lines"))
    abbr, titles = set(), set()
    for k, n in dot.items():
        if n < 3:
            continue
        bare, soft = word.get(k, 0), inner.get(k, 0)
        if "." in k or soft >= 0.3 * n or (n >= 5 and len(k) <= 4 and bare <= 0.05 * n and last.get(k, 0) <= 0.1 * n):
            abbr.add(k)
            if soft <= 0.05 * n and "." not in k:
                titles.add(k)
    openers = {}
    for k, n in by.get("open", {}).items():
        total = lines.get(script(k[0]) or "cased", 0)
        if total and n >= 2:
            openers[k] = n / total
    words = {k: (by.get("open", {}).get(k, 0), n) for k, n in word.items() if n >= 5}
    return Corpus(frozenset(abbr), frozenset(titles), openers, words)


class Splitter:
    """Sentence units of one text at a time."""

    def __init__(self, corpus: Corpus | None = None):
        self.c = corpus or Corpus()

    def units(self, text: str, kind: str = "prose") -> list[tuple[int, int]]:
        """(start, end) of each unit, without outer white space; none of a blank text."""
        lines = []
        at = 0
        for line in text.split("\n"):
            a, b = at, at + len(line)
            at = b + 1
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            lines.append((a, b))
        if kind != "prose":
            return [x for x in lines if x[0] < x[1]]
        self.own = frozenset(softened(text))
        self.text, self.shown, self.capitals = text, None, None
        out: list[tuple[int, int]] = []
        for a, b in self.blocks(text, lines):
            out.extend(self.block(text, a, b))
        return out

    def blocks(self, text: str, lines: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Stretches that no sentence crosses: lines, joined where a break is only a wrapped line's."""
        full = [x for x in lines if x[0] < x[1]]
        width = max((b - a for a, b in full), default=0)
        pairs = [(p, q) for p, q in zip(lines, lines[1:]) if p[0] < p[1] and q[0] < q[1]]

        def fits(p: tuple[int, int], q: tuple[int, int]) -> bool:
            """Whether the next line's first word would have had room on the line."""
            blank = text.find(" ", q[0], q[1])
            return (p[1] - p[0]) + 1 + ((blank if blank > 0 else q[1]) - q[0]) <= width

        wrapped = False
        if pairs and width <= WRAP_LIMIT:
            tight = [not fits(p, q) for p, q in pairs]
            cased = [text[q[0]].islower() or text[q[0]].isdigit() for p, q in pairs if not script(text[q[0]])]
            soft = [text[q[0]].islower() or text[q[0]].isdigit() or bool(script(text[q[0]])) or text[p[1] - 1] not in ".!?…\"”»)" for p, q in pairs]
            wrapped = sum(tight) >= 0.45 * len(tight) and sum(cased) >= 0.3 * len(cased) and any(x and y for x, y in zip(tight, soft))
        # without such a habit of the document, a full line without a sentence mark is a wrapped one
        single = width <= WRAP_LIMIT and bool(full) and not text[full[0][0]].islower() and any(text[b - 1] in ".!?…。！？।؟\"”»" for _, b in full)

        def goes_on(p: tuple[int, int], q: tuple[int, int]) -> bool:
            return text[p[1] - 1] not in ".!?…。！？।؟\"”»:" or text[p[1] - 1] == "." and self.abbreviation(text, p[1] - 1)

        out: list[list[int]] = []
        prev = None
        for a, b in lines:
            if a >= b:
                prev = None
                continue
            join = prev is not None and (wrapped or single and goes_on(prev, (a, b))) and not fits(prev, (a, b)) and not self.item(text, a, b)
            if join:
                out[-1][1] = b
            else:
                out.append([a, b])
            prev = (a, b)
        return [(a, b) for a, b in out]

    @staticmethod
    def item(text: str, a: int, b: int) -> bool:
        return text[a] in "-*•·▪" and BULLET.match(text[a:b]) is not None

    def block(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        if self.item(text, a, b):
            return [(a, b)]
        ends = self.ends(text, a, b, True)
        if ends is None:
            ends = self.ends(text, a, b, False)
        out, start = [], a
        for e in [*ends, b]:
            while start < e and text[start].isspace():
                start += 1
            stop = e
            while stop > start and text[stop - 1].isspace():
                stop -= 1
            if stop > start:
                out.append((start, stop))
            start = e
        if _THAI.search(text, a, b):
            out = [y for x in out for y in self.thai(text, *x)]
        return out

    def ends(self, text: str, a: int, b: int, nested: bool) -> list[int] | None:
        """Where sentences end in text[a:b]; None if quotes or brackets stay open."""
        stack: list[str] = []
        ends: list[int] = []
        skip = -1
        for m in _EVENT.finditer(text, a, b):
            i, c = m.start(), m[0]
            if i < skip:
                continue
            if c == '"' or c in _OPEN or c in _CLOSE:
                if not nested:
                    continue
                if c == '"':
                    closing = '"' in stack
                    want = '"'
                else:
                    closing = c in stack if c in _OPEN else True  # “ closes „ but opens else
                    want = c if c in _CLOSE and closing else _OPEN.get(c, c)
                if not closing:
                    stack.append(want)
                    if len(stack) > 6:
                        return None
                    continue
                if want not in stack:
                    continue  # a mark of a list or a stray one
                while stack and stack[-1] != want:
                    stack.pop()
                stack.pop()
                if not stack:
                    j = i - 1
                    while j > a and text[j].isspace():
                        j -= 1
                    k = j
                    while k > a and text[k] in "\"”’»」』）)":
                        k -= 1
                    if text[k] in _LATIN_DOT + _HARD_STOPS + "!?" and self.after_quote(text, i + 1, b, c, text[k], text, k):
                        ends.append(i + 1)
                continue
            if stack:
                continue
            j = i + 1
            while j < b and text[j] in ".!?…。！？":
                j += 1
            skip = j
            if not nested:
                while j < b and text[j] in "\"”’»」』）)]":
                    j += 1
                skip = j
            if self.is_end(text, a, i, j, b):
                ends.append(j)
        return None if stack else ends

    def after_quote(self, text: str, j: int, b: int, mark: str, stop: str, _t: str, k: int) -> bool:
        """Whether a sentence ends where a quotation or bracket closes after a sentence mark."""
        n = j
        while n < b and text[n].isspace():
            n += 1
        if n >= b:
            return True
        c = text[n]
        if mark in ")）]":
            if stop == "." and self.abbreviation(text, k) or c in ".,;:!?。，；：":
                return False
            return n > j and (c.isupper() or c in "\"“„«「¿¡(") and self.whole_bracket(text, j)
        if c in ",;:，；：、.!?。—–-)）]":
            return False
        if c.islower():
            return self.mixed(text, n, b)
        if self.upper and c.isalpha():
            return not self.running_word(text, n, b)
        if c.isupper():
            s = script(text[k - 1]) if k else ""
            return True if not s else self.c.openers.get(opening(text, n, b), 1.0) > 0
        if c.isdigit() and not script(text[k - 1]):
            return True
        if c in "\"“„«「『¿¡(（":
            return True
        return self.c.openers.get(opening(text, n, b), 0.0) >= OPENER_SHARE

    @staticmethod
    def whole_bracket(text: str, j: int) -> bool:
        """Whether the bracket that closes before ``j`` opened at the beginning of a sentence."""
        i = max(text.rfind("(", 0, j), text.rfind("（", 0, j))
        k = i - 1
        while k >= 0 and text[k].isspace():
            k -= 1
        return k < 0 or text[k] in ".!?…。！？\"”»)" or text[k + 1 : i].count("\n") > 0

    def running_word(self, text: str, n: int, b: int) -> bool:
        """Whether the word is frequent in the corpus, yet hardly ever opens a line."""
        first, total = self.c.words.get(opening(text, n, b), (0, 0))
        return total >= 20 and first < 0.02 * total

    @staticmethod
    def mixed(text: str, n: int, b: int) -> bool:
        """A word such as pH or mRNA, which keeps its small first letter where a sentence begins."""
        return any(text[q].isupper() for q in range(n + 1, min(b, n + 3)))

    def token(self, text: str, i: int) -> str:
        m = _BEFORE.match(text, _back(text, i), i)
        w = m[0].lower() if m else ""
        head, _, tail = w.rpartition(".")
        # a sentence that ran on without a blank before this word
        return tail if len(head) >= 3 and "." not in head and len(head) > len(tail) else w

    @property
    def upper(self) -> bool:
        """Whether the whole text is set in capitals."""
        if self.capitals is None:
            self.capitals = sum(map(len, _BIG.findall(self.text))) > 2 * sum(map(len, _SMALL.findall(self.text)))
        return self.capitals

    def occurs(self, word: str) -> tuple[bool, bool]:
        """Whether the document has the word with a capital inside a sentence, and in small letters."""
        if self.shown is None:
            self.shown = ({w.lower() for w in _NAME.findall(self.text)}, set(_PLAIN.findall(self.text)))
        return word in self.shown[0], word in self.shown[1]

    def abbreviation(self, text: str, i: int) -> bool:
        """Whether the word before the period at ``i`` is an abbreviation."""
        w = self.token(text, i)
        if not w or not w[0].isalpha():
            return False
        return (len(w) == 1 and not script(w)) or w in self.own or w in self.c.abbreviations or w in _SEED and (len(w) <= 2 or w not in self.c.words)

    def is_end(self, text: str, a: int, i: int, j: int, b: int) -> bool:
        """Whether the marks text[i:j] end a sentence."""
        if j >= b:
            return True
        c0 = text[i]
        if c0 in _HARD_STOPS and script(text[j]) == "wide":
            return True
        n = j
        while n < b and text[n].isspace():
            n += 1
        if n >= b:
            return True
        c = text[n]
        if c in ",;:，；：、—–)）]»”":
            return False
        if c0 in _HARD_STOPS:
            return c0 not in "؟" or not c.islower()
        dots = c0 == "…" or (c0 == "." and j - i > 1)
        if n == j:  # no white space
            if dots or i == a:
                return False
            p = text[i - 1]
            if c in "\"“„«「":
                return n + 1 < b and not text[n + 1].isspace() and not text[n + 1].islower()
            if c0 in "!?":
                return c.isupper() or bool(script(c))
            own = self.token(text, i)
            if "." in own or len(own) < 2 or own in self.own or own in _SEED:
                return False
            if c.isupper():
                return p.islower() or p in "%)" or self.upper and p.isalpha() and len(own) > 3 or bool(script(p))
            if c.isdigit():
                return p.isalpha() and len(own) > 3
            return bool(script(c)) and bool(script(p))
        if dots:
            if i > a and text[i - 1].isspace():
                return False
            return not c.islower() or self.mixed(text, n, b)
        if c.islower():
            return self.mixed(text, n, b) and not (c0 == "." and self.abbreviation(text, i))
        if c0 != ".":
            return True
        if text[i - 1].isdigit() and c.isupper() and i - a > 2 and (text[i - 2].isspace() or text[i - 3].isspace()):
            return opening(text, n, b) not in MONTHS
        if not self.abbreviation(text, i):
            return True
        w = self.token(text, i)
        if self.upper or c.isdigit() or script(c) or len(w) == 1 or w in self.c.titles:
            return False
        # an abbreviation that is no title, before a capital: the document tells a name from the first word of a sentence
        word = opening(text, n, b)
        name, plain = self.occurs(word)
        if name != plain:
            return plain
        # else the corpus: an end if the next word opens sentences
        return self.c.openers.get(opening(text, n, b), 0.0) >= OPENER_SHARE

    def thai(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """Cut at spaces before what the document or the corpus shows at the beginning of lines."""
        out, start = [], a
        for m in re.finditer(r"\s+(?=[฀-๿])", text[a:b]):
            n = a + m.end()
            if self.c.openers.get(opening(text, n, b), 0.0) >= OPENER_SHARE:
                stop = a + m.start()
                if stop > start:
                    out.append((start, stop))
                start = n
        out.append((start, b))
        return out
