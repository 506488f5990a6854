"""Operators over whole inputs, where their SQL is narrower or missing."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq

from attestra import catalog


def _with(data, tmp, **tables):
    """A copy of the data in which the named tables are replaced."""
    for f in os.listdir(data):
        if f.split(".")[0] not in tables:
            os.symlink(f"{data}/{f}", f"{tmp}/{f}")
    for name, t in tables.items():
        pq.write_table(t, f"{tmp}/{name}.parquet")
    return str(tmp)


def _decoded(raw):
    if raw.startswith('"'):
        try:
            return back if isinstance(back := json.loads(raw), str) else raw
        except json.JSONDecodeError:
            pass
    return raw


def test_wrapped_replies_are_decoded_whole(spark, data, tmp_path):
    t = pq.read_table(f"{data}/query_records.parquet")
    t = t.take([list(t["record_id"].to_pylist()).index(i) for i in dict.fromkeys(t["record_id"].to_pylist())])
    long = "CLAIM 1: größer 😀 \\ \"so\"\n" * 400
    odd = [json.dumps(long), json.dumps(long, ensure_ascii=False), '""', '"a" b', '"a" "b"', '"open', '"a\nb"', '"\\q"', '"é\\u00e9" \n', long, '{"a": 1}', ' "a"', '"' + "\\n" * 300000 + '"']
    raw = odd + t["raw_generation"].to_pylist()[len(odd) :]
    t = t.set_column(t.column_names.index("raw_generation"), "raw_generation", pa.array(raw, t.schema.field("raw_generation").type))
    got = {r["record_id"]: r["n_chars"] for r in catalog.QUERIES["fn28_unwrapped"](spark, _with(data, tmp_path, query_records=t)).collect()}
    assert got == {i: len(_decoded(x)) for i, x in zip(t["record_id"].to_pylist(), raw) if x is not None}


def test_control_draw_is_over_all_passages(spark, data, tmp_path):
    t = pq.read_table(f"{data}/query_records.parquet")
    ids = [f"q{i}" for i in range(len(t))]
    chunks = {p for p, x in zip(*(pq.read_table(f"{data}/chunks.parquet")[c].to_pylist() for c in ("passage_id", "text"))) if p and x and x.strip()}
    some = sorted(chunks)
    for name, values in (("record_id", range(len(t))), ("query_id", ids), ("gold_passage_ids", [some[i % 7 :: 7] for i in range(len(t))])):
        t = t.set_column(t.column_names.index(name), name, pa.array(list(values), t.schema.field(name).type))
    got = catalog.QUERIES["top12_control_draw"](spark, _with(data, tmp_path, query_records=t)).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], {})[r["slot"]] = r["passage_id"]
    assert by.keys() == set(ids)
    for i, q in enumerate(ids):
        assert sorted(by[q]) == [1, 2, 3] and len(set(by[q].values())) == 3
        assert not set(by[q].values()) & set(some[i % 7 :: 7]) and set(by[q].values()) <= chunks
    counts = [sum(p in x.values() for x in by.values()) for p in some]
    assert sum(c > 0 for c in counts) >= 0.95 * len(some) * (1 - (1 - 1 / len(some)) ** (3 * len(ids)))
    assert max(counts) < 3 * len(ids) / len(some) + 6 * (3 * len(ids) / len(some)) ** 0.5 + 3
