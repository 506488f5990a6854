"""Problem 3: every document, chunk and claim as sentence units with offsets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import once, table
from . import textstats
from .sentences import Corpus, Splitter, corpus_from, count

#: Entries of a count below this share of all of its kind are left out, so a kind has at most 1 / SHARE entries.
SHARE = 1e-5
#: Distinct keys that a partition holds before it writes its counts out.
HELD_KEYS = 1_000_000


def corpus(df: DataFrame, text: str = "text") -> Corpus:
    """Counts over every text of ``df``: summed per partition, then by key; at most 1 / SHARE keys of a kind reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for pdf in batches:
            held.update(count(t for t in pdf["t"] if t))
            if len(held) > HELD_KEYS:
                yield pd.DataFrame([(k, w, n) for (k, w), n in held.items()], columns=["kind", "key", "n"])
                held = Counter()
        yield pd.DataFrame([(k, w, n) for (k, w), n in held.items()], columns=["kind", "key", "n"]).astype({"n": "int64"})

    parts = df.select(df[text].alias("t")).mapInPandas(run, "kind string, key string, n bigint")
    sums = parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    totals = sums.groupBy("kind").agg(F.sum("n").alias("total"))
    kept = sums.where("n >= 2").join(totals, "kind").where(F.col("n") >= F.col("total") * SHARE).select("kind", "key", "n")
    return corpus_from((r.kind, r.key, r.n) for r in kept.toLocalIterator())


def units(df: DataFrame, key: str, known: Corpus, text: str = "text") -> DataFrame:
    """(key, unit_start, unit_end) of every unit; a null or blank text has none. Offsets are in code points."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = Splitter(known)
        for pdf in batches:
            texts = [t or "" for t in pdf["t"]]
            _, kinds, _ = textstats.kinds(texts, full=False)
            keys, starts, ends = [], [], []
            for k, t, what in zip(pdf["k"], texts, kinds):
                for a, b in split.units(t, what):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({key: pd.Series(keys, dtype=pdf["k"].dtype), "unit_start": pd.Series(starts, dtype="int64"), "unit_end": pd.Series(ends, dtype="int64")})

    return df.select(df[key].alias("k"), df[text].alias("t")).mapInPandas(run, f"{key} {kind}, unit_start bigint, unit_end bigint")


def found(spark: SparkSession, d: str) -> DataFrame:
    """The units of every document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return units(docs, "doc_id", corpus(docs))


def chunk_units(spark: SparkSession, d: str) -> DataFrame:
    """The units of every chunk, redelivered rows once."""
    rows = once(table(spark, d, "chunks").select("chunk_id", "text"), "chunk_id")
    return units(rows, "chunk_id", corpus(rows))


def claim_units(spark: SparkSession, d: str) -> DataFrame:
    """The units of every claim text, redelivered rows once."""
    rows = once(table(spark, d, "claims").select("claim_key", "text"), "claim_key")
    return units(rows, "claim_key", corpus(rows))


QUERIES = {"p3_found": found, "p3_chunk_units": chunk_units, "p3_claim_units": claim_units}
SQL: dict[str, str] = {}
