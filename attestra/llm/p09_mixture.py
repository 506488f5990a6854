"""Problem 9: mixing sources to target shares of all tokens.

A low-discrepancy schedule: slot n takes the point frac(n * golden ratio), and
the source whose stretch of the cumulative target weights holds the point. So
every stretch of the schedule has nearly the target shares. Each source's
documents are shuffled by a hash and cut into blocks of equal tokens; the k-th
slot of a source takes its k-th block, beginning anew when all are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import spool
from ..sources.tables import table
from .tokens import Tokenizer, sizes

#: Tokens of a block, at most and at least; within these it is a 64th of the smallest source's part.
BLOCK_MOST, BLOCK_LEAST = 65_536, 512
#: Documents of a source that share a bucket of its shuffled order, about.
BUCKET_DOCS = 20_000
#: Slots that are ranked together.
RUN = 65_536
#: Sources with targets that are read to the driver at most.
MOST_SOURCES = 10_000

GOLDEN = 0.6180339887498949
_FAR = (GOLDEN * (1 << 20)) % 1.0


@dataclass(frozen=True)
class Plan:
    """What the mixture will hold: total tokens, tokens of a block, and per source (share, repeats, tokens, documents)."""

    total: float
    block: int
    sources: dict


def source_name(c):
    """One spelling per source: small letters, no outer blanks, _ for - and blanks."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def plan(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> Plan:
    """Decide the size: ``total_tokens``, or all that the scarcest source allows with its repeats."""
    rows = targets.select("source", "target_share", "max_repeats").where("target_share > 0 and source is not null").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have targets")
    want = {r.source: (float(r.target_share), max(1, int(r.max_repeats or 1))) for r in rows}
    have = docs.where(F.col("source").isin(list(want))).groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    got = {r.source: (*want[r.source], int(r.t), int(r.n)) for r in have if r.t}
    if not got:
        return Plan(0.0, BLOCK_LEAST, {})
    most = min(t * rep / share for share, rep, t, _ in got.values())
    total = min(most, total_tokens) if total_tokens else most
    block = int(max(BLOCK_LEAST, min(BLOCK_MOST, min(t for *_, t, _ in got.values()) / 64)))
    return Plan(total, block, got)


def schedule(docs: DataFrame, p: Plan) -> DataFrame:
    """(slot, source, repeat_no, doc_id, token_start, token_end, tokens): the mixture in its order of slots.

    Blocks hold equally many tokens, but for the last of a source: a document
    that crosses a block's edge is in both, each with its part of the tokens.
    """
    spark = docs.sparkSession
    weight = sum(s[0] for s in p.sources.values())
    names = sorted(p.sources)
    ends, acc = [], 0.0
    for s in names:
        acc += p.sources[s][0] / weight
        ends.append(acc)
    slots = int(p.total * weight / p.block)
    # documents in shuffled order with the tokens before each: sums per bucket, then within the bucket
    known = docs.where(F.col("source").isin(names)).withColumn("h", F.xxhash64("doc_id", F.lit(9)))
    n_docs = F.element_at(F.create_map(*[F.lit(x) for s in names for x in (s, p.sources[s][3])]), F.col("source")) if names else F.lit(0)
    cut = F.greatest(F.lit(1), F.ceil(n_docs / BUCKET_DOCS))
    bucketed = spool(known.select("doc_id", "source", "tokens", "h", F.floor((F.col("h") / 1.8446744073709552e19 + 0.5) * cut).alias("bucket")), "bucketed")
    before = bucketed.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).withColumn("base", F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t"))
    order = Window.partitionBy("source", "bucket").orderBy("h", "doc_id")
    placed = bucketed.join(before.select("source", "bucket", "base"), ["source", "bucket"]).withColumn("start", F.col("base") + F.sum("tokens").over(order) - F.col("tokens"))
    last = F.greatest(F.col("start"), F.col("start") + F.col("tokens") - 1)
    blocks = placed.select("source", "doc_id", "tokens", "start", F.explode(F.sequence(F.floor(F.col("start") / p.block), F.floor(last / p.block))).alias("block"))
    edge = lambda b: F.greatest(F.lit(0), F.least(F.col("tokens"), b * p.block - F.col("start")))
    blocks = blocks.select("source", "doc_id", "block", edge(F.col("block")).alias("token_start"), edge(F.col("block") + 1).alias("token_end"))
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for s in names for x in (s, max(1, -(-p.sources[s][2] // p.block)))]), F.col("source")) if names else F.lit(1)
    repeats = F.element_at(F.create_map(*[F.lit(x) for s in names for x in (s, p.sources[s][1])]), F.col("source")) if names else F.lit(1)
    # the schedule, ranked per source: counts per run of slots, then within the run
    point = F.pmod(F.floor(F.col("slot") / (1 << 20)) * _FAR + F.pmod(F.col("slot"), F.lit(1 << 20)) * GOLDEN, F.lit(1.0))
    which = F.least(F.size(F.filter(F.array(*[F.lit(e) for e in ends]) if ends else F.array(F.lit(1.0)), lambda e: e <= F.col("u"))), F.lit(max(0, len(ends) - 1)))
    s = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / RUN).alias("run")).withColumn("u", point)
    s = s.withColumn("source", F.get(F.array(*[F.lit(x) for x in names]) if names else F.array(F.lit("")), which)).select("slot", "run", "source")
    ahead = s.groupBy("source", "run").agg(F.count(F.lit(1)).alias("c")).withColumn("base", F.sum("c").over(Window.partitionBy("source").orderBy("run")) - F.col("c"))
    ranked = s.join(ahead.select("source", "run", "base"), ["source", "run"]).withColumn("k", F.col("base") + F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1)
    take = ranked.select("slot", "source", F.pmod(F.col("k"), n_blocks.cast("bigint")).alias("block"), F.floor(F.col("k") / n_blocks).alias("repeat_no")).where(F.col("repeat_no") < repeats)
    return take.join(blocks, ["source", "block"]).select("slot", "source", F.col("repeat_no").cast("int").alias("repeat_no"), "doc_id", "token_start", "token_end", (F.col("token_end") - F.col("token_start")).alias("tokens"))


def _sized(spark: SparkSession, d: str, tokenizer: Tokenizer) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", source_name(F.col("source")).alias("source"))
    return spool(sizes(docs, "doc_id", ["source"], tokenizer=tokenizer), "sizes")


def mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of the documents for mix_targets; documents without a source, or of one without a target, are no part of it."""
    docs = _sized(spark, d, Tokenizer())
    return schedule(docs, plan(docs, table(spark, d, "mix_targets")))


def shares(spark: SparkSession, d: str) -> DataFrame:
    """Per source of mix_targets: its target, the tokens it has, those used, the share reached and how often its documents repeat."""
    docs = _sized(spark, d, Tokenizer())
    targets = table(spark, d, "mix_targets").select("source", "target_share", "max_repeats")
    mixed = schedule(docs, plan(docs, targets)).groupBy("source").agg(F.sum("tokens").alias("used_tokens"), (F.max("repeat_no") + 1).alias("most_repeats"))
    have = docs.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    out = targets.join(have, "source", "left").join(mixed, "source", "left")
    total = mixed.agg(F.sum("used_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.crossJoin(total).select("source", "target_share", "max_repeats", zero("available_tokens").alias("available_tokens"), zero("used_tokens").alias("used_tokens"), F.round(zero("used_tokens") / F.col("all_tokens"), 6).alias("reached_share"), zero("most_repeats").alias("most_repeats"))


QUERIES = {"p9_mixture": mixture, "p9_shares": shares}
SQL: dict[str, str] = {}
