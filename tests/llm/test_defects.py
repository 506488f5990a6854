"""Problems 4 and 6 on planted defects and cuts: how many are told, and how many that are told are true."""

import itertools
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from attestra.llm import p04_defects, p06_truncated

DRUGS = ["Ralomib", "Tesovane", "Quindarol", "Mevotrin", "Ostavir", "Pelucine"]
SAID = {
    "en": ["In week {n} {d} lowered pain at rest in most of the adults with gout.", "Compared with {d}, the other arm had more visits to the ward.", "The drop in mean weight was seen in both arms after {n} weeks of {d}.", "Patients given {d} reported less fatigue than those given placebo."],
    "de": ["Unter {d} sank der Blutdruck in {n} Wochen bei den meisten Personen mit Gicht.", "Die Gruppe mit {d} hatte nach {n} Wochen weniger Schmerzen als die andere.", "Der Unterschied für die Griffkraft blieb auch nach {n} Wochen mit {d} bestehen."],
    "fr": ["Sous {d}, la pression artérielle a baissé en {n} semaines chez les sujets avec goutte.", "Le groupe avec {d} a eu moins de douleur que les autres pour la durée du séjour.", "La différence pour la force est restée stable sous {d} dans les deux groupes."],
}
ASKED = {"en": "Does {d} improve pain at rest in adults over {n}?", "de": "Kann {d} bei Personen über {n} mit Gicht früh abgesetzt werden?", "fr": "Le {d} améliore-t-il la douleur au repos chez les sujets de {n} ans ?"}
# none of these sentences stands in the data
NO = ["I'm afraid I cannot answer that.", "We are unable to give a verdict on this.", "Sorry, I will not comment on this matter.", "The sources do not contain an answer.", "Unfortunately, our instructions do not let us judge it.", "I would rather not respond to this request."]
NO_OTHER = {"de": "Leider kann ich dazu keine Auskunft geben.", "fr": "Désolé, je ne peux pas répondre."}


def claims_of(rng, lang, n):
    more = {"en": ", as {n} charts had shown", "de": ", wie {n} Akten zeigten", "fr": ", selon {n} dossiers"}[lang]
    texts = []
    for _ in range(n):
        t = rng.choice(SAID[lang])
        t = t[:-1] + more * rng.randrange(3) + "."
        texts.append(t.format(d=rng.choice(DRUGS), n=rng.randint(2, 10 ** rng.randint(1, 5))))
    return texts


def dressed(rng, texts):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(texts)
    if kind == 1:
        return '{"decision": "yes", "claims": [' + ", ".join(f'{{"index": {i + 1}, "text": "{t}", "citations": []}}' for i, t in enumerate(texts)) + "]}"
    return "DECISION: yes\n" + "\n".join(f"CLAIM {i + 1}: {t}\nCITE {i + 1}: 7:{i} || {' '.join(rng.choice(SAID['en']).split()[2 : rng.randint(4, 9)])}" for i, t in enumerate(texts))


def planted(n=900, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        lang = rng.choice(["en", "en", "en", "de", "fr"])
        q = ASKED[lang].format(d=rng.choice(DRUGS), n=rng.randint(40, 70))
        kind = rng.choice(["empty", "refusal", "copied_question", "wrong_language", "truncated"]) if i % 6 == 0 else None
        if kind == "empty":
            raw = rng.choice(["", " \n", "DECISION:", "CLAIM 1:", "-", '{"decision": null, "claims": []}'])
        elif kind == "refusal":
            raw = dressed(rng, [NO_OTHER.get(lang) or rng.choice(NO)]).split("\nCITE")[0]
        elif kind == "copied_question":
            raw = rng.choice(["", "Q: ", "> "]) + rng.choice([q, q.lower(), q.replace(" ", "  "), q.rstrip("? ") + "!"])
        elif kind == "wrong_language":
            raw = dressed(rng, claims_of(rng, rng.choice([x for x in SAID if x != lang]), rng.randint(1, 4)))
        elif kind == "truncated":
            whole = dressed(rng, claims_of(rng, lang, rng.randint(2, 6)))
            # not where a sentence ends, nor in a quotation, which may stop anywhere
            ends = [k for k in range(20, len(whole) - 2) if whole[k - 1].isalpha() and whole[k] in " abcdefghij" and "CITE" not in whole[:k].rsplit("\n", 1)[-1]]
            raw = whole[: rng.choice(ends)] + rng.choice(["", "", "...", " […]"])
        else:
            raw = dressed(rng, claims_of(rng, lang, rng.randint(1, 6)) + (["Of them, 12% said that they could not answer the question on sleep."] if lang == "en" and i % 9 == 0 else []))
        rows.append((i, "vllm:x", q, raw, kind))
    return rows


def tables(data, tmp, rows):
    t = pq.read_table(f"{data}/query_records.parquet")
    t = t.take([i % len(t) for i in range(len(rows))])
    for name, values in zip(("record_id", "backend", "question", "raw_generation"), zip(*[r[:4] for r in rows])):
        t = t.set_column(t.column_names.index(name), name, pa.array(values, t.schema.field(name).type))
    t = t.set_column(t.column_names.index("completion_tokens"), "completion_tokens", pa.nulls(len(t), pa.int64()))
    rng, lines = random.Random(1), itertools.count()
    texts = [(next(lines), r[0], x) for r in rows if r[4] is None for x in claims_of(rng, "en", 3) + claims_of(rng, rng.choice(["de", "fr"]), 2)]
    c = pq.read_table(f"{data}/claims.parquet")
    c = c.take([i % len(c) for i in range(len(texts))])
    for name, values in zip(("claim_key", "record_id", "text"), zip(*texts)):
        c = c.set_column(c.column_names.index(name), name, pa.array(values, c.schema.field(name).type))
    for name in ("source_start", "source_end", "citations"):
        c = c.set_column(c.column_names.index(name), name, pa.nulls(len(c), c.schema.field(name).type))
    d = pq.read_table(f"{data}/decompositions.parquet").slice(0, 0)
    for f in os.listdir(data):
        if f.split(".")[0] not in ("query_records", "claims", "decompositions"):
            os.symlink(f"{data}/{f}", f"{tmp}/{f}")
    for name, x in (("query_records", t), ("claims", c), ("decompositions", d)):
        pq.write_table(x, f"{tmp}/{name}.parquet")
    return str(tmp)


@pytest.fixture(scope="module")
def rows():
    return planted()


@pytest.fixture(scope="module")
def folder(data, rows, tmp_path_factory):
    return tables(data, tmp_path_factory.mktemp("planted"), rows)


def test_cutoffs_on_planted_defects(spark, folder, rows):
    truth = {r[0]: r[4] for r in rows if r[4]}
    got = {r.record_id: r.defect_type for r in p04_defects.found(spark, folder).collect()}
    for kind in p04_defects.KINDS:
        want, have = {i for i, k in truth.items() if k == kind}, {i for i, k in got.items() if k == kind}
        both = len(want & have)
        print(kind, len(want), len(have), both)
        assert both >= 0.9 * len(want) and both >= 0.9 * len(have), kind
    several = p04_defects.labels(spark, folder).groupBy("record_id").count().where("count > 1").count()
    assert several <= len(truth)


def test_planted_cuts(spark, folder, rows):
    truth = {r[0] for r in rows if r[4] == "truncated"}
    sound = {r[0] for r in rows if r[4] in (None, "wrong_language")}
    got = {r.row_id for r in p06_truncated.found(spark, folder).where("field_name = 'raw_generation'").collect()}
    assert len(got & truth) >= 0.9 * len(truth)
    assert len(got & sound) <= 0.01 * len(sound)


def test_evidence_lies_beyond_any_window(spark, data, tmp_path):
    answer = "".join(f"In week {i} the drug lowered pain in {i + 20} of 90 adults. " for i in range(60))
    q = "Does Ralomib improve pain at rest in adults over 50? " * 60
    rows = [(i, "vllm:x", "Does it help?", "DECISION: yes\nCLAIM 1: " + answer, None) for i in range(1, 60)]
    rows += [(100, "vllm:x", q, q.lower().strip(), None), (101, "vllm:x", "Does it help?", answer[:2001] + "wherea" + " ..." + " " * 500, None)]
    got = {r.record_id: r.defect_type for r in p04_defects.found(spark, tables(data, tmp_path, rows)).collect()}
    assert got == {100: "copied_question", 101: "truncated"}


def test_marks_put_after_are_looked_through(spark):
    cases = {"abc": "abc", "abc.": "abc.", "abc...": "abc", "abc … ": "abc", "abc. \n": "abc.", "abc [truncated]": "abc", "abc (cut) ": "abc", "abc -": "abc", "abc�": "abc", "": "", " .": " .", "abc" + " …" * 50_000: "abc"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, y string")
    assert not df.selectExpr(f"{p06_truncated._bare('x')} AS got", "y").where("got <> y").collect()
