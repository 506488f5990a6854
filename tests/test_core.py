"""Configuration, strict sources, exact selection and draws."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.functions.select import at_rank
from attestra.operators import sampling, text_units
from attestra.plans import config
from attestra.sources import files


def test_hash_diff_and_ablation():
    a = config.RunConfig()
    b = config.ablate(a, "chunk.max_chars", 600)
    assert config.canonical_hash(a) != config.canonical_hash(b)
    assert config.config_diff(a, b) == {"chunk.max_chars": (2000, 600)}
    with pytest.raises(KeyError):
        config.ablate(a, "nothing", 1)
    with pytest.raises(ValueError):
        config.ChunkConfig("sentence_window", 2, 3)
    assert config.RunConfig(dense=False, fuse=False, rerank=False).arm() == "lexical_only"


def test_frozen_files_and_manifests(tmp_path):
    p = tmp_path / "ids.json"
    config.write_once(p, {"ids": [1, 2]})
    assert config.read_frozen(p) == {"ids": [1, 2]}
    with pytest.raises(FileExistsError):
        config.write_once(p, {})
    p.write_text(p.read_text().replace("2", "3", 1))
    with pytest.raises(ValueError):
        config.read_frozen(p)
    m = config.start_run(str(tmp_path / "run"), config.RunConfig(), ["joint"])
    assert config.verify_run(config.read_frozen(m), 0, {"vanilla"}, False) == ["unfinished", "no rows", "arm joint has no rows", "arm vanilla was not declared"]


def test_strict_reading(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    with open(path, "w") as f:
        f.write('{"record_id": 1, "question": "a b"}\n\n{"record_id": 2, "other": 1}\n')
    with pytest.raises(ValueError, match="other"):
        files.read_records(spark, path)
    assert files.read_jsonl(spark, path, files.RECORD).where("question is not null").first().question == "a b"


def test_run_without_costs(spark, tmp_path):
    files.write_jsonl(spark.createDataFrame([(1, "x")], "record_id bigint, question string"), str(tmp_path / "run.records.jsonl"))
    r, c = files.load_run(spark, str(tmp_path / "run"))
    assert r.count() == 1 and c.count() == 0


def test_scores_are_merged_once(spark):
    known = spark.createDataFrame([("a", "b", 0.5)], "premise string, hypothesis string, score double")
    want = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "c")], "premise string, hypothesis string")
    got = files.merge_scores(known, want, lambda m: m.withColumn("score", F.lit(0.1)))
    assert sorted(map(tuple, got.collect())) == [("a", "b", 0.5), ("a", "c", 0.1)]


def test_selection_by_rank(spark):
    rows = [("a", float(i % 7)) for i in range(1000)] + [("b", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.v for r in at_rank(df, "g", "v", F.floor(F.col("n") / 2) + 1).collect()}
    a = sorted(float(i % 7) for i in range(1000))
    assert got == {"a": a[500], "b": 1.0}


def test_exact_keys(spark):
    df = spark.createDataFrame([("x",), ("y",)], "id string")
    got = {r.id: r.key for r in sampling.exact_key(df, "id", 3).collect()}
    assert got["x"] == hashlib.blake2b(b"3:x", digest_size=8).hexdigest()
    assert sampling.prescan_cutoff(10, 10) == 2**64


@pytest.mark.parametrize("strategy", text_units.STRATEGIES)
def test_chunks_cover_texts(spark, strategy):
    texts = ["One. Two! Three? four", "", "  \n ", "a" * 50, "Line one\n\nLine two. And more.", None, "x. " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").where("text is not null")
    for r in text_units.chunk(df, strategy, 2, 1, 40).groupBy("doc_id").agg(F.collect_list(F.struct("char_start", "char_end")).alias("p")).collect():
        covered = {i for a, b in r.p for i in range(a, b)}
        assert all(0 < b - a <= 40 for a, b in r.p)
        assert {i for i, c in enumerate(texts[r.doc_id]) if not c.isspace()} <= covered


def test_chunk_configs_are_checked(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    for bad in ({"strategy": "other"}, {"strategy": "abstract", "max_chars": 0}, {"strategy": "sentence_window", "size": 1, "stride": 2}):
        with pytest.raises(ValueError):
            text_units.chunk(df, **bad)


def test_judge_scores(spark):
    df = spark.createDataFrame([(" 85% ",), ("100.",), ("101",), ("about 5",), ("",)], "r string")
    assert [r[0] for r in df.select(X.judge_score(F.col("r"))).collect()] == [0.85, 1.0, None, None, None]
