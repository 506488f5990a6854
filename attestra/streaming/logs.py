"""Append-only logs as streams: the best snapshot so far, a running bottom-k draw, and refused rows set aside."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import SEED, hash_key
from ..plans.durable import shared_dir
from ..sources.tables import table


def _drain(stream: DataFrame, spark: SparkSession, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there, with its checkpoint in the shared folder, and read the last state written."""
    base = f"{shared_dir(spark)}/attestra/{name}-{uuid.uuid4().hex}"

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch:09d}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch") if mode == "complete" else out.drop("batch")


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table read as a stream of files."""
    schema = table(spark, d, name).schema
    path = f"{shared_dir(spark)}/attestra/in-{name}-{uuid.uuid4().hex}"
    table(spark, d, name).repartition(3).write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def best_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Per annotator the labels saved so far and the latest time, kept up as the log grows."""
    s = _source(spark, d, "human_labels").where("annotator_id is not null")
    g = s.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max_by("label_id", F.struct("saved_at", "label_id")).alias("last_label"))
    return _drain(g, spark, "complete", "snapshots")


def running_draw(spark: SparkSession, d: str, k: int = 25) -> DataFrame:
    """The k documents with the smallest keys, kept over batches: each batch's own k and those kept so far are enough."""
    base = f"{shared_dir(spark)}/attestra/draw-{uuid.uuid4().hex}"
    s = _source(spark, d, "documents").select("doc_id").withColumn("key", hash_key(SEED, F.col("doc_id")))

    def merge(df: DataFrame, batch: int) -> None:
        mine = df.orderBy("key", "doc_id").limit(k)
        if batch:
            mine = mine.unionByName(spark.read.parquet(f"{base}/state-{batch - 1}")).distinct().orderBy("key", "doc_id").limit(k)
        mine.write.mode("overwrite").parquet(f"{base}/state-{batch}")
        merge.last = batch

    merge.last = 0
    q = s.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/state-{merge.last}")


def refused(spark: SparkSession, d: str) -> DataFrame:
    """Label rows that a collector refuses, without a unit or with a label off the scale, counted by reason; the rest passes."""
    s = _source(spark, d, "human_labels")
    name = F.regexp_replace(F.upper(F.trim("support_label")), r"[\s_-]+", "_")
    why = F.when(F.col("unit_id").isNull(), "no unit").when(F.col("support_label").isNull(), "no label").when(~name.isin("SUPPORTED", "PARTIAL", "NOT_SUPPORTED", "CONTRADICTED"), "unknown label").otherwise("accepted")
    return _drain(s.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n")), spark, "complete", "refused")


QUERIES = {"st1_running_draw": running_draw, "st2_best_snapshot": best_snapshot, "st3_refused": refused}

SQL = {
    "st1_running_draw": "SELECT doc_id, md5('17:' || doc_id) AS key FROM documents ORDER BY key, doc_id LIMIT 25",
    "st2_best_snapshot": "SELECT annotator_id, count(*) AS n_rows, arg_max(label_id, (coalesce(saved_at, '1900-01-01'::TIMESTAMPTZ), label_id)) AS last_label FROM human_labels WHERE annotator_id IS NOT NULL GROUP BY 1",
    "st3_refused": r"SELECT CASE WHEN unit_id IS NULL THEN 'no unit' WHEN support_label IS NULL THEN 'no label' WHEN regexp_replace(upper(trim(support_label)), '[\s_-]+', '_', 'g') NOT IN ('SUPPORTED', 'PARTIAL', 'NOT_SUPPORTED', 'CONTRADICTED') THEN 'unknown label' ELSE 'accepted' END AS reason, count(*) AS n FROM human_labels GROUP BY 1",
}
