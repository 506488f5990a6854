"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Approximate quantiles that divide a group before the exact selection.
PARTS = 256


def at_rank(df: DataFrame, by: str, value: str, position: Column) -> DataFrame:
    """(by, n, value): the value at 1-based ``position``, an expression over the count ``n``, of each group.

    Approximate quantiles divide each group into parts; exact counts tell which
    part holds the rank, and only the distinct values of that part are ranked.
    No group passes through one task as a whole. Null values are left out.
    """
    x = df.where(F.col(value).isNotNull()).select(by, value)
    edges = x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], PARTS * 20).alias("edges"))
    part = F.size(F.filter("edges", lambda e: e < F.col(value)))
    parted = x.join(edges, by).withColumn("want", position.cast("bigint")).groupBy(by, "n", "want", part.alias("part"), value).agg(F.count(F.lit(1)).alias("c"))
    sums = parted.groupBy(by, "want", "part").agg(F.sum("c").alias("in_part"))
    before = sums.withColumn("before", F.sum("in_part").over(Window.partitionBy(by).orderBy("part")) - F.col("in_part"))
    hit = before.where((F.col("before") < F.col("want")) & (F.col("want") <= F.col("before") + F.col("in_part"))).select(by, "part", "before")
    rank = F.col("before") + F.sum("c").over(Window.partitionBy(by).orderBy(value))
    found = parted.join(hit, [by, "part"]).withColumn("upto", rank).where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("c") < F.col("want")))
    return found.select(by, "n", value)
