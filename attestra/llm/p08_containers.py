"""Problem 8: filling containers of fixed capacity with documents.

Bounded-space online best fit: each task keeps a fixed number of open bins. A
bitset has a bit for every free space that some open bin has, so the bin that
an item fits best is one shift and one lowest-bit away. When nothing fits and
all places are taken, the fullest bin closes first. What tasks leave open at
their end is packed once more across tasks, bins being the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import spool
from ..sources.tables import table
from .tokens import Tokenizer, count

#: Open bins of a task, for each kind of container.
OPEN = 128
#: Tasks whose open bins are packed together afterwards.
GATHER = 512
#: Kinds of containers that are read to the driver at most.
MOST_KINDS = 10_000


class BestFit:
    """Bins of one capacity, of which at most ``most`` are open."""

    def __init__(self, capacity: int, most: int = OPEN, first: int = 0):
        self.capacity, self.most, self.serial = capacity, most, first
        self.free: dict[int, list[int]] = {}  # free space -> open bins
        self.mask = 0
        self.n_open = 0
        self.closed: list[int] = []

    def put(self, size: int) -> int:
        """The bin that takes an item of ``size``, which must not exceed the capacity."""
        fits = self.mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.n_open >= self.most:
                self.closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
                self.n_open -= 1
            bin_, space = self.serial, self.capacity
            self.serial += 1
            self.n_open += 1
        left = space - size
        if left:
            self.free.setdefault(left, []).append(bin_)
            self.mask |= 1 << left
        else:
            self.closed.append(bin_)
            self.n_open -= 1
        return bin_

    def _take(self, space: int) -> int:
        bins = self.free[space]
        bin_ = bins.pop()
        if not bins:
            del self.free[space]
            self.mask ^= 1 << space
        return bin_


def fill(docs: DataFrame, containers: DataFrame, tokenizer: Tokenizer = Tokenizer(), most: int = OPEN) -> DataFrame:
    """(container_name, capacity_tokens, bin_id, doc_id, piece_no, token_start, token_end) of every piece.

    A document is one piece unless it is larger than the capacity; then all
    pieces but the last are as large as it. Empty and null texts take no space
    but get a bin. Containers without a positive capacity are left out.
    """
    kinds = [(r.container_name, int(r.capacity_tokens)) for r in containers.select("container_name", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(MOST_KINDS + 1).collect()]
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"container_name string, capacity_tokens int, part int, bin int, doc_id {kind}, piece_no int, token_start bigint, token_end bigint"
    cols = ["container_name", "capacity_tokens", "part", "bin", "doc_id", "piece_no", "token_start", "token_end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        packs = [(name, cap, BestFit(cap, most)) for name, cap in kinds]
        for pdf in batches:
            n = count(pdf["text"].tolist(), tokenizer)
            ids = pdf["doc_id"].tolist()
            for name, cap, pack in packs:
                put = pack.put
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc, size in zip(ids, n):
                    at = piece = 0
                    while True:
                        end = min(size, at + cap)
                        for x, v in zip(rows, (put(end - at), doc, piece, at, end)):
                            x.append(v)
                        at, piece = end, piece + 1
                        if at >= size:
                            break
                yield pd.DataFrame({"container_name": name, "capacity_tokens": cap, "part": part, **dict(zip(cols[3:], rows))})[cols]
        for name, cap, pack in packs:  # rows that only mark the bins that are open at the end
            left = [x for bins_ in pack.free.values() for x in bins_]
            yield pd.DataFrame({"container_name": name, "capacity_tokens": cap, "part": part, "bin": pd.Series(left, dtype="int64"), "doc_id": pd.Series([None] * len(left), dtype=object), "piece_no": -1, "token_start": 0, "token_end": 0})[cols]

    placed = spool(docs.select("doc_id", "text").mapInPandas(run, schema), "placed")
    loads = placed.groupBy("container_name", "capacity_tokens", "part", "bin").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("load"), F.min("piece_no").alias("first"))
    # at most ``most`` bins of a task are open at its end
    loose = loads.where("first = -1").withColumn("lot", (F.col("part") / GATHER).cast("int"))

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["load", "part", "bin"], ascending=[False, True, True], kind="stable")
        pack = BestFit(int(pdf["capacity_tokens"].iloc[0]), most)
        return pdf[["container_name", "part", "bin"]].assign(lot=pdf["lot"], joined=[pack.put(int(x)) for x in pdf["load"]])

    joined = loose.groupBy("container_name", "capacity_tokens", "lot").applyInPandas(again, "container_name string, part int, bin int, lot int, joined int")
    full = placed.where("piece_no >= 0").join(joined, ["container_name", "part", "bin"], "left")
    name = F.when(F.col("joined").isNull(), F.format_string("%d-%d", "part", "bin")).otherwise(F.format_string("r%d-%d", "lot", "joined"))
    return full.select("container_name", "capacity_tokens", name.alias("bin_id"), "doc_id", "piece_no", "token_start", "token_end")


def bins(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a bin of every kind of container."""
    return fill(table(spark, d, "documents"), table(spark, d, "containers"))


def report(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of container: bins, pieces, tokens, the least possible number of bins, and the share of space used."""
    b = bins(spark, d).groupBy("container_name", "capacity_tokens", "bin_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))
    r = b.groupBy("container_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_bins"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest"))
    return r.withColumns({"least_bins": F.ceil(F.col("n_tokens") / F.col("capacity_tokens")), "used_share": F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6)})


QUERIES = {"p8_bins": bins, "p8_report": report}
SQL: dict[str, str] = {}
