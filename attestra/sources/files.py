"""JSON Lines and Parquet sources and sinks of runs, with strict decoding, optional parts, and incremental score tables."""

from __future__ import annotations

import re


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import shared_dir
from . import records as R
from .tables import table

# Schemas as DDL, which needs no session.
RECORD = (
    "record_id bigint, run_id string, query_id string, question string, system_name string, seed int, retrieved array<struct<passage_id:string,rank_no:int,score:double,retriever:string>>, "
    "gold_passage_ids array<string>, raw_generation string, final_decision string, gold_final_decision string, latency_s double, prompt_tokens bigint, completion_tokens bigint, schema_version string"
)
COST = ("run_id string, query_id string, component string, backend string, input_tokens bigint, output_tokens bigint, usd double, wall_s double")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite a folder of JSON Lines: columns in sorted order, text unescaped, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read JSON Lines under a schema; only newlines end a record, blank lines are skipped, malformed lines fail."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def names(schema: str) -> list[str]:
    """The top-level names of a DDL schema."""
    return re.findall(r"(\w+) [a-z]", re.sub(r"<[^<>]*(?:<[^<>]*>)*[^<>]*>", "", schema))


def unknown_keys(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Keys of the lines that the schema does not know, with how many lines have them; a strict reader demands none."""
    raw = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    keys = F.explode(F.array_except(F.json_object_keys("value"), F.array(*[F.lit(n) for n in names(schema)])))
    return raw.select(keys.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Query records with the known schema; an unknown key is an error, not a loss."""
    bad = [r.key for r in unknown_keys(spark, path, RECORD).limit(20).collect()]
    if bad:
        raise ValueError(f"unknown keys: {bad}")
    return read_jsonl(spark, path, RECORD)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_run(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Records and costs of a run; a run without costs has an empty table of them."""
    costs = f"{prefix}.costs.jsonl"
    return read_records(spark, f"{prefix}.records.jsonl"), read_jsonl(spark, costs, COST) if exists(spark, costs) else spark.createDataFrame([], COST)


def save_index(index: DataFrame, texts: DataFrame, vectors: DataFrame, path: str) -> None:
    """The parts of an index as tables of their own, so that a reader scans only what it needs."""
    index.write.mode("overwrite").parquet(f"{path}/postings")
    texts.write.mode("overwrite").parquet(f"{path}/texts")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def merge_scores(known: DataFrame, wanted: DataFrame, scorer, keys: tuple[str, ...] = ("premise", "hypothesis")) -> DataFrame:
    """Known scores and those of the pairs that lack one: an anti-join finds these, each distinct pair is scored once."""
    missing = wanted.select(*keys).distinct().join(known, list(keys), "left_anti")
    return known.unionByName(scorer(missing))


def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON Lines and read again: rows, and how many came back the same."""
    r = R.records(spark, d, *[c for c in names(RECORD) if c != "record_id"])
    path = f"{shared_dir(spark)}/attestra/records-{abs(hash(d)) % 10**8}"
    write_jsonl(r, path)
    back = read_records(spark, path)
    h = lambda x: x.select("record_id", F.xxhash64(*[F.to_json(c) if c in ("retrieved", "gold_passage_ids") else F.col(c) for c in names(RECORD)]).alias("h"))
    a, b = h(r), h(back).withColumnRenamed("h", "g")
    return a.join(b, "record_id", "full").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h").eqNullSafe(F.col("g"))).alias("same"))


def key_audit(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the written records that a narrower schema would not know."""
    path = f"{shared_dir(spark)}/attestra/audit-{abs(hash(d)) % 10**8}"
    write_jsonl(R.records(spark, d, "run_id", "seed", "question"), path)
    return unknown_keys(spark, path, "record_id bigint, run_id string, seed int")


def scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows, bytes and newest time of every source spelling of the documents."""
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("n_bytes"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank lines of documents as sections with running offsets."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("a"))
    x = t.select("doc_id", F.posexplode("a").alias("i", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("at", F.coalesce(F.sum(F.char_length("line") + 1).over(w), F.lit(0))).where(F.trim(F.regexp_replace("line", r"(?U)\s+", " ")) != "")
    return x.select("doc_id", F.col("i").cast("bigint").alias("line_no"), F.col("at").cast("bigint").alias("char_start"), (F.col("at") + F.char_length("line")).cast("bigint").alias("char_end"))



QUERIES = {"src2_round_trip": round_trip, "src2_unknown_keys": key_audit, "src3_scan": scan, "src4_sections": sections}

SQL = {
    "src2_round_trip": "SELECT count(DISTINCT record_id) AS n, count(DISTINCT record_id) AS same FROM query_records",
    "src2_unknown_keys": "SELECT 'question' AS key, count(DISTINCT record_id) AS n FROM query_records",
    "src3_scan": "SELECT source, count(*) AS n, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY 1",
    "src4_sections": r"SELECT doc_id, i - 1 AS line_no, p0::BIGINT AS char_start, (p0 + length(l))::BIGINT AS char_end FROM (SELECT doc_id, i, l, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1 AS p0 FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))) WHERE regexp_replace(l, '[\s\p{Z}\x{1c}-\x{1f}\x{85}]+', '', 'g') <> ''",
}
