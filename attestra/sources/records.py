"""The run data in relational form: records, ranked passages, gold ids, claims, citations, passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import once, table


def records(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Query records, redelivered rows once; only the named columns are read."""
    return once(table(spark, d, "query_records").select("record_id", *[c for c in cols if c != "record_id"]), "record_id")


def ranked(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row per retrieved passage of a record: passage_id, rank_no, score, retriever."""
    r = records(spark, d, *cols, "retrieved")
    return r.select("record_id", *cols, F.explode("retrieved").alias("p")).select("record_id", *cols, "p.passage_id", "p.rank_no", "p.score", "p.retriever")


def gold(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (record_id, passage_id) of the gold sets."""
    return records(spark, d, "gold_passage_ids").select("record_id", F.explode(F.array_distinct("gold_passage_ids")).alias("passage_id"))


def claims(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Claims, redelivered rows once."""
    return once(table(spark, d, "claims").select("claim_key", *[c for c in cols if c != "claim_key"]), "claim_key")


def citations(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row per citation of a claim, with its 0-based place."""
    c = claims(spark, d, "citations", *cols)
    return c.select("claim_key", *cols, F.posexplode("citations").alias("citation_index", "c")).select("claim_key", *cols, "citation_index", "c.passage_id", "c.char_start", "c.char_end", "c.quoted_text")


def passages(spark: SparkSession, d: str) -> DataFrame:
    """passage_id and text of the chunks; of several chunks with one id the smallest chunk_id counts."""
    c = once(table(spark, d, "chunks").select("chunk_id", "passage_id", "source_id", "chunk_index", "text"), "chunk_id").where("passage_id is not null and text is not null")
    return c.groupBy("passage_id").agg(F.min_by(F.struct("source_id", "chunk_index", "text"), "chunk_id").alias("x")).select("passage_id", "x.source_id", "x.chunk_index", "x.text")
