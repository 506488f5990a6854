"""Problem 2: cutting oversized items at natural boundaries, with overlap.

Lexical cohesion: the words of the sentences before and after each gap are
compared in sliding blocks; a gap where the similarity forms a valley marks a
change of topic. Within each size window the deepest valley is taken. Without a
sentence gap in the window the cut falls on a clause mark, white space or any
other mark, and only inside a stretch longer than the limit on no boundary.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import once, table

#: Sentences in the block on either side of a gap.
BLOCK = 2
#: Cuts are sought beyond this share of the window, so that pieces don't get tiny.
LEAST_FILL = 0.4

# The marks that end a stretch, beside white space.
MARKS = ".!?;。！？；।؟"

_BREAK = re.compile(rf"[\s{re.escape(MARKS)}]")
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？।؟]+[\"'”’»」』）)\]]*|\n)\s*")
_CLAUSE = re.compile(r"[,;:，；：、،؛]\s*|[；，、]")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W_]+")


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    if len(b) < len(a):
        a, b = b, a
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def valleys(text: str, gaps: list[int]) -> list[float]:
    """The depth of the similarity valley at each gap between sentences; 0 where there is none."""
    edges = [0, *gaps, len(text)]
    bags = [Counter(w.lower() for w in _WORD.findall(text, a, b)) for a, b in zip(edges, edges[1:])]
    sims = []
    for g in range(1, len(bags)):
        left, right = Counter(), Counter()
        for x in bags[max(0, g - BLOCK) : g]:
            left.update(x)
        for x in bags[g : g + BLOCK]:
            right.update(x)
        sims.append(_cosine(left, right))
    # the peak on each side is that of the neighbour as long as similarity doesn't fall towards it
    left_peak, right_peak = list(sims), list(sims)
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            left_peak[i] = left_peak[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            right_peak[i] = right_peak[i + 1]
    return [x + y - 2 * z for x, y, z in zip(left_peak, right_peak, sims)]


def longest_stretch(text: str) -> int:
    """Code points of the longest stretch without white space or a mark."""
    return max(map(len, _BREAK.split(text)), default=0)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary at the end) of the pieces of ``text``, none longer than ``limit``.

    Consecutive pieces share exactly ``overlap`` code points, or fewer where
    only that lets the next cut fall on a boundary. An overlap that leaves no
    room to advance is reduced to ``limit // 2``. Together the pieces cover the
    text. A text within the limit is one piece.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    overlap = max(0, min(overlap, limit // 2))
    gaps = [m.end() for m in _SENTENCE.finditer(text) if 0 < m.end() < n]
    depth = dict(zip(gaps, valleys(text, gaps)))
    clauses = [m.end() for m in _CLAUSE.finditer(text)]
    spaces = [m.end() for m in _SPACE.finditer(text)]
    marks = sorted({p for m in _BREAK.finditer(text) for p in (m.start(), m.end()) if 0 < p < n} | {n})
    tiers = [("clause", clauses), ("space", spaces), ("mark", marks)]
    from bisect import bisect_left, bisect_right

    def within(xs: list[int], low: int, high: int) -> list[int]:
        """The members of xs in (low, high]."""
        return xs[bisect_right(xs, low) : bisect_right(xs, high)]

    pieces, start, last = [], 0, 0
    while True:
        if n - start <= limit:
            pieces.append((start, n, "end"))
            return pieces
        top, low = start + limit, max(last, start + int(limit * LEAST_FILL))
        near = within(gaps, low, top) or within(gaps, last, top)
        if near:
            end, kind = max(near, key=lambda g: (depth[g], g)), "sentence"
        else:
            end, kind = top, "hard"
            for name, xs in tiers:
                if own := within(xs, low, top) or within(xs, last, top):
                    end, kind = own[-1], name
                    break
        pieces.append((start, end, kind))
        last, start = end, end - overlap
        k = bisect_left(marks, last + 1)
        if k < len(marks) and (nxt := marks[k]) > start + limit:
            # only a smaller overlap, if any, lets the next piece reach the boundary
            start = min(last, nxt - limit) if nxt - last <= limit else start


def pieces(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """The pieces of every chunk longer than its config's max_chars.

    ``chunks`` needs chunk_id, text, char_start, config_id; ``configs`` config_id,
    max_chars, overlap_chars. Null texts and chunks without a config or with a
    limit below one have no pieces; a null overlap is none, a null char_start
    leaves the absolute offsets null. Repeated chunk_ids count once.
    """
    src = chunks.select("chunk_id", "text", "char_start", "config_id")
    conf = configs.select("config_id", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars")).where("max_chars >= 1").dropDuplicates(["config_id"])
    big = src.join(conf, "config_id").where(F.char_length("text") > F.col("max_chars"))
    # redelivered rows are equal, so only oversized texts need be compared
    big = once(big.select("chunk_id", "text", "char_start", "max_chars", "overlap_chars"), "chunk_id")
    schema = "chunk_id bigint, piece_index int, piece_start int, piece_end int, char_start bigint, char_end bigint, boundary string, cut_kind string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                kind = "hard" if longest_stretch(r.text) > r.max_chars else "natural"
                base = None if pd.isna(r.char_start) else int(r.char_start)
                for i, (a, b, why) in enumerate(cut(r.text, int(r.max_chars), int(r.overlap_chars))):
                    rows.append((r.chunk_id, i, a, b, None if base is None else base + a, None if base is None else base + b, why, kind, r.text[a:b]))
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_index", "piece_start", "piece_end", "char_start", "char_end", "boundary", "cut_kind", "text"]).astype({"char_start": "Int64", "char_end": "Int64"})

    return big.mapInPandas(run, schema)


def all_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk in pieces within its limit, as the operator cuts it."""
    return pieces(table(spark, d, "chunks"), table(spark, d, "chunk_configs"))


def found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized chunks, ``hard`` where some cut could fall on no boundary."""
    return all_pieces(spark, d).where("piece_index = 0").select("chunk_id", "cut_kind")


QUERIES = {"p2_found": found, "p2_pieces": all_pieces}

SQL = {
    "p2_found": r"""
SELECT DISTINCT chunk_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s\p{Z}\x{1c}-\x{1f}\x{85}.!?;。！？；।؟]'), lambda s: length(s))) > max_chars THEN 'hard' ELSE 'natural' END AS cut_kind
FROM chunks JOIN chunk_configs USING (config_id) WHERE length(text) > max_chars"""
}
