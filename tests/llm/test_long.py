"""Long texts, field limits and stored quotes in problems 4 and 6."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

from attestra.llm import p04_defects, p06_truncated


def _with(data, tmp, **tables):
    """A copy of the data in which the named tables are replaced."""
    for f in os.listdir(data):
        if f.split(".")[0] not in tables:
            os.symlink(f"{data}/{f}", f"{tmp}/{f}")
    for name, t in tables.items():
        pq.write_table(t, f"{tmp}/{name}.parquet")
    return str(tmp)


def _replies(data, tmp, rows, **more):
    """The data with these (record_id, backend, raw_generation) as its records, other columns as in the first rows."""
    t = pq.read_table(f"{data}/query_records.parquet")
    t = t.take([i % len(t) for i in range(len(rows))])
    for name, values in zip(("record_id", "backend", "raw_generation"), zip(*rows)):
        t = t.set_column(t.column_names.index(name), name, pa.array(values, t.schema.field(name).type))
    return _with(data, tmp, query_records=t, **more)


def test_limits_are_lengths_at_which_values_pile_up(spark, data, tmp_path):
    word = lambda i, n: "".join(f"{(i * 7919 + k * 104729) % 99991} of " for k in range(n // 5 + 1))[: n - 2] + "of"
    cut = {i: ("vllm:a", word(i, 700) + (" ..." if i % 5 == 0 else "")) for i in range(1, 31)}
    cut |= {i: ("vllm:b", word(i, 399) + "é" * 150 + "of") for i in range(31, 41)}  # 701 bytes
    whole = {i: ("vllm:a", word(i, 400 + i * 3) + ".") for i in range(41, 201)}
    whole |= {i: ("vllm:a", word(i, 900 + 11 * i) + "of") for i in range(201, 211)}  # beyond the limit, so not cut by it
    whole |= {i: ("vllm:a", word(1, 300)) for i in range(211, 221)}  # one reply given ten times
    rows = [(i, b, t) for i, (b, t) in (cut | whole).items()]
    j = p06_truncated.judged(spark, _replies(data, tmp_path, rows)).where("field_name = 'raw_generation' and evidence = 'at_limit'")
    assert {r["row_id"] for r in j.collect()} == set(cut)


def test_last_quotes_are_held_against_stored_ones(spark, data, tmp_path):
    long, other = "Of 212 adults with gout, the drug lowered pain at rest in most of them", "Of 212 adults"
    reply = lambda q, p="7:1": f"DECISION: yes\nCLAIM 1: It helps.\nCITE 1: 7:0 || It was so.\nCLAIM 2: It works.\nCITE 2: {p} || {q}"
    quotes = {1: long, 2: long[:40].rstrip(), 3: long[:12].upper() + " ...", 4: "«" + long + "»", 5: "the drug lowered pain", 6: other, 7: long[:41], 8: long[:24] + " [truncated]"}
    rows = [(i, "vllm:a", reply(q)) for i, q in quotes.items()] + [(9, "vllm:a", reply(long[:20], "7:2")), (10, "vllm:a", reply(long[:20]) + "\nCITE 3: 7:0 || It was so.")]
    c = pq.read_table(f"{data}/claims.parquet").slice(0, 12)
    cites = [[{"passage_id": "7:0", "char_start": 0, "char_end": 10, "quoted_text": "It was so."}, {"passage_id": "7:1", "char_start": 0, "char_end": 70, "quoted_text": long}] for _ in range(12)]
    cites[10] = [{"passage_id": "7:1", "char_start": 0, "char_end": 13, "quoted_text": other}]
    for name, values in (("claim_key", range(1, 13)), ("record_id", [*range(1, 11), 6, 99]), ("citations", cites)):
        c = c.set_column(c.column_names.index(name), name, pa.array(list(values), c.schema.field(name).type))
    j = p06_truncated.judged(spark, _replies(data, tmp_path, rows, claims=c)).where("field_name = 'raw_generation' and evidence = 'quote'")
    assert {r["row_id"] for r in j.collect()} == {2, 3, 7, 8}


def test_long_refusals_and_long_frames_are_told(spark, data, tmp_path):
    no = "I am sorry, but I cannot answer this question from the passages. The excerpts do not allow a verdict on it. Unfortunately, no conclusion is possible here. "
    answer = "".join(f"In week {i} the drug lowered pain in {i + 20} of 90 adults. " for i in range(40))
    rows = [(1, "vllm:a", (no * 6).strip()), (2, "vllm:a", "CLAIM 1: " + answer + "Unfortunately, week 41 is missing.\nCITE 1: 7:0 || In week 3"), (3, "vllm:a", "- -\n" * 700)]
    rows += [(i, "vllm:a", "DECISION: yes\nCLAIM 1: " + answer[: 400 + 5 * i].rsplit(".", 1)[0] + ".\nCITE 1: 7:0 || In week 3") for i in range(4, 60)]
    v = {r["record_id"]: r for r in p04_defects.votes(spark, _replies(data, tmp_path, rows)).collect()}
    assert (v[1]["refusal_person"], v[1]["refusal_share"]) == (1, 1)
    assert v[2]["refusal_share"] == 0
    assert v[3]["empty_short"] == 1
    assert v[9]["refusal_person"] == v[9]["refusal_share"] == v[9]["empty_short"] == 0
