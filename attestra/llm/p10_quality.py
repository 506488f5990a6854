"""Problem 10: statistics of each text, and from them whether it is prose, a list, a table or junk.

Fixed thresholds on the statistics. Every failed rule is recorded by name. The
published rules for web corpora (``textstats.PUBLISHED``, with their sources) are
recorded as ``published_...``; they are about English pages of some length, so
the kind is decided by the first failed rule of ``textstats.RULES``, which hold
for short texts and every script.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import textstats as S


def assess(df: DataFrame, key: str = "doc_id", text: str = "text", full: bool = True) -> DataFrame:
    """(key, statistics, doc_kind, reasons) of every row of ``df``.

    Without ``full``, statistics that decide no kind and the published rules are
    left out where only kinds are wanted. A null or empty text is junk by the rule ``junk_empty``. Other columns of
    ``df`` are not read. Rows stay where they are: there is no shuffle.
    """
    cols = [f"{c} bigint" for c in S.COUNTS] + [f"{c} double" for c in S.RATIOS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stats, kinds, why = S.kinds([t or "" for t in pdf["t"]], full)
            out = {key: pdf["k"], **{c: stats[c] for c in S.COUNTS}, **{c: stats[c].round(6) for c in S.RATIOS}}
            yield pd.DataFrame({**out, "doc_kind": kinds, "reasons": [",".join(w) for w in why]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("k"), df[text].alias("t")).mapInPandas(run, f"{key} {kind}, {', '.join(cols)}, doc_kind string, reasons string")


def statistics(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the statistics of its text, its kind and the failed rules."""
    return assess(table(spark, d, "documents"))


def found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are not natural prose."""
    return assess(table(spark, d, "documents"), full=False).where("doc_kind <> 'prose'").select("doc_id", "doc_kind")


QUERIES = {"p10_found": found, "p10_statistics": statistics}
SQL: dict[str, str] = {}
