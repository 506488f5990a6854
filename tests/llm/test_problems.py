"""The operators against brute force, bounds, round trips and hand-made cases."""

import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest
from comparing import rows_of, rows_of_sql
from pyspark.sql import functions as F

from attestra.llm import labelmodel, p02_pieces, p05_neardup, p07_consensus, p08_containers, p09_mixture, queries, quantiles, textstats
from attestra.llm.sentences import Splitter


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    cols, got = rows_of(queries.QUERIES[name](spark, data))
    names, want = rows_of_sql(duck, queries.SQL[name])
    assert cols == names and got == want


# 1 percentiles


@pytest.mark.parametrize("n,k", [(10, 64), (5_000, 64), (20_000, 128)])
def test_rank_bounds_hold(n, k):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(0, 2, n), 3)
    parts = []
    for x in np.array_split(values, 7):
        b = quantiles.Buffers(k)
        b.add(x)
        parts.append(b.row())
    merged = quantiles.Buffers(k)
    row = lambda r: pd.Series(dict(zip([f.name for f in quantiles.SKETCH], r)))
    for p in parts:
        merged.merge(row(p))
    s = row(merged.row())
    assert s.n == n and s.rank_err <= n * (np.log2(max(2, n / k)) + 3) / k
    for q, (est, lo, hi) in zip((0.0, 0.1, 0.5, 0.9, 0.99, 1.0), quantiles.read_quantiles(s, (0.0, 0.1, 0.5, 0.9, 0.99, 1.0))):
        true = np.quantile(values, q)
        assert lo - 1e-9 <= true <= hi + 1e-9 and lo - 1e-9 <= est <= hi + 1e-9


def test_sketches_merge_over_partitions(spark):
    df = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("g")).alias("g"), (F.col("id") * 7919 % 30_011).cast("double").alias("v"))
    got = {r.g: r for r in quantiles.percentiles(quantiles.sketches(df, ["g"], "v", 256), ["g"], {"p": 0.5}).collect()}
    for g, rows in df.toPandas().groupby("g", dropna=False):
        r = got[None if g is None or g != g else g]
        assert r.n == len(rows) and r.p_lo <= rows.v.median() <= r.p_hi


# 2 pieces


def test_pieces_round_trip():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["word ", "x", "End. ", "\n", "。", "长", "a" * 30, "; ", "!"]) for _ in range(rng.randint(0, 120)))
        limit, overlap = rng.choice([20, 50, 100]), rng.choice([0, 5, 19])
        ps = p02_pieces.cut(text, limit, overlap)
        assert ps[0][0] == 0 and ps[-1][1] == len(text) and all(b - a <= limit for a, b, _ in ps)
        assert all(x[1] > y[0] - 1 and y[1] > x[1] and x[1] - y[0] <= overlap for x, y in zip(ps, ps[1:]))
        assert any(k == "hard" for *_, k in ps) == (len(text) > limit and p02_pieces.longest_stretch(text) > limit)


# 3 sentences


@pytest.mark.parametrize(
    "text,units",
    [
        ("Dr. Ames saw 3.5 mg work. It did!", ["Dr. Ames saw 3.5 mg work.", "It did!"]),
        ('One wrote, "I slept. Then it got worse." and left. The end.', ['One wrote, "I slept. Then it got worse." and left.', "The end."]),
        ("Methods\nWe used e.g. two scans (see Fig. 3). pH fell.", ["Methods", "We used e.g. two scans (see Fig. 3).", "pH fell."]),
        ("一名患者写道：“我睡不好。还很冷。”他走了。结束了！", None),
        ("यह एक है। यह दो है।", ["यह एक है।", "यह दो है।"]),
        ("हाल ... ठीक है।", ["हाल ... ठीक है।"]),
        ("", []),
        ("   \n ", []),
    ],
)
def test_sentences(text, units):
    got = [text[a:b] for a, b in Splitter().units(text)]
    if units is not None:
        assert got == units
    assert all(x == x.strip() and x for x in got)


def test_wrapped_lines_join():
    text = "The effect of the drug on grip strength was larger in\nteenage boys than in adults over sixty who had been\ntreated before. A second sentence follows here and is\nwrapped too."
    assert len(Splitter().units(text)) == 2


def test_lines_of_lists_are_units():
    assert Splitter().units("- a. b\n- c", "list") == [(0, 6), (7, 10)]


# 4 and 7 models


def test_label_model_recovers_classes():
    rng = np.random.default_rng(1)
    y = rng.random(5000) < 0.05
    v = np.column_stack([np.where(y, rng.random(5000) < 0.9, rng.random(5000) < f) for f in (0.02, 0.05, 0.1)]).astype(float)
    seen, counts = np.unique(v, axis=0, return_counts=True)
    m = labelmodel.fit(seen, counts.astype(float), [0.8] * 3, [0.05] * 3)
    assert ((m.posterior(v) > 0.5) == y).mean() > 0.99
    assert labelmodel.fit(np.zeros((0, 2)), np.zeros(0), [0.9, 0.9], [0.1, 0.1]).prior == 0.02


def test_consensus_sees_through_mirrored_annotators(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    for u in range(400):
        truth[u] = rng.choice([0, 0, 1, 2, 3])
        for a, skill in (("good1", 0.95), ("good2", 0.9), ("mirror", -1), ("random", 0.25), ("fair", 0.75)):
            if rng.random() < 0.8:
                lab = 3 - truth[u] if skill < 0 else truth[u] if rng.random() < skill else rng.randrange(4)
                rows.append((str(u), a, lab))
    units, annotators = p07_consensus.consensus(spark.createDataFrame(rows, "unit_id string, annotator_id string, lab int"))
    got = {r.unit_id: r.support_label for r in units.select("unit_id", p07_consensus._best().alias("support_label")).collect()}
    assert np.mean([p07_consensus.LABELS.index(got[str(u)]) == t for u, t in truth.items() if str(u) in got]) > 0.93
    skill = {r.annotator_id: r.r for r in annotators.collect()}
    assert skill["good1"] > skill["fair"] > skill["random"] > skill["mirror"]


# 5 near-duplicates


@pytest.mark.parametrize("hot,block", [(4096, 512), (6, 4)])
def test_pairs_equal_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(p05_neardup, "HOT", hot)
    monkeypatch.setattr(p05_neardup, "BLOCK", block)
    rng = random.Random(9)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(60)) for _ in range(70)] for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(rng.randrange(8)):
            w[rng.randrange(70)] = f"z{rng.randrange(1000)}"
        rows.append((i, f"s{i % 7}", " ".join(w)))
    rows += [(100, "s0", rows[1][2]), (101, None, rows[1][2]), (102, "s9", None), (103, "s9", "short")]
    df = spark.createDataFrame(rows, "chunk_id bigint, source_id string, text string")
    monkeypatch.setattr(p05_neardup, "table", lambda *_: df)
    got = {tuple(r) for r in p05_neardup.found(spark, "").collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, _, t in rows if t and len(t.split()) > 50}
    src = {i: s or "" for i, s, _ in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if src[a] != src[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert got == want and want
    groups = p05_neardup.groups(spark, "").toPandas()
    link = {r.chunk_id: r.group_id for r in groups.itertuples()}
    assert all(link[a] == link[b] for a, b in want)


# 8 containers and 9 mixture


def test_best_fit_never_overfills():
    rng = random.Random(2)
    pack, load = p08_containers.BestFit(100, 8), {}
    for _ in range(3000):
        x = rng.randrange(0, 101)
        b = pack.put(x)
        load[b] = load.get(b, 0) + x
        assert load[b] <= 100
        assert pack.n_open <= 8 and pack.n_open == sum(map(len, pack.free.values()))
    assert sum(load.values()) / (100 * len(load)) > 0.85


def test_pieces_of_documents_are_whole(spark, data):
    b = p08_containers.bins(spark, data).toPandas()
    for (_, cap, _), g in b.groupby(["container_name", "capacity_tokens", "bin_id"]):
        assert (g.token_end - g.token_start).sum() <= cap
    for (_, cap, _), g in b.groupby(["container_name", "capacity_tokens", "doc_id"]):
        g = g.sort_values("piece_no")
        assert list(g.token_start) == [0, *list(g.token_end)[:-1]]
        assert len(g) == max(1, -(-int(g.token_end.max()) // cap))


def test_mixture_meets_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "rare").otherwise("common").alias("source"), (F.col("id") % 90 + 10).alias("tokens"))
    targets = spark.createDataFrame([("rare", 0.5, 2), ("common", 0.4, 1), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    p = p09_mixture.plan(docs, targets)
    m = p09_mixture.schedule(docs, p).toPandas()
    share = m.groupby("source").tokens.sum() / m.tokens.sum()
    assert abs(share["rare"] - 5 / 9) < 0.02 and abs(share["common"] - 4 / 9) < 0.02
    size = dict(docs.select("doc_id", "tokens").collect())
    assert m.repeat_no.max() <= 1 and all(n == size[i] for (i, _), n in m[m.repeat_no == 0].groupby(["doc_id", "repeat_no"]).tokens.sum().items() if i % 4 == 0)
    assert not m.duplicated(["doc_id", "repeat_no", "token_start"]).any()
    assert (m.groupby("slot").tokens.sum() == p.block).mean() > 0.97
    first = m[m.slot < m.slot.max() / 10]
    assert abs(first[first.source == "rare"].tokens.sum() / first.tokens.sum() - 5 / 9) < 0.02


# 10 quality


@pytest.mark.parametrize(
    "text,kind",
    [
        ("We followed the boys for two weeks, and most of them slept well. Then the study ended.", "prose"),
        ("- one\n- two things\n- three", "list"),
        ("arm\tn\tp\nx\t1\t2.5\ny\t3\t-\nz\t4\tn/a", "table"),
        ("| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |\n| z | 3 |", "table"),
        ("Home | Menu | Cart | Home\nHelp | Share | Home", "junk"),
        ("dose dose dose dose dose dose dose dose dose dose dose dose dose", "junk"),
        ("", "junk"),
        ("参加者はこの薬を毎日服用した。体重は変わらなかった。", "prose"),
    ],
)
def test_kinds(text, kind):
    assert textstats.kinds([text])[1] == [kind]


def test_statistics_do_not_depend_on_the_batch():
    texts = ["One two. Three!", "", "a|b|c 1 2 3", "é" * 10, "x\n\ny."]
    together = textstats.statistics(texts)
    for i, t in enumerate(texts):
        alone = textstats.statistics([t])
        assert all(np.isclose(together[k][i], alone[k][0]) for k in together)


def test_published_rules_are_recorded():
    prose = " ".join("We have seen that the adults of the ward slept well with it and that the drop in weight was to be lasting." for _ in range(4))
    cases = {
        "published_words": "Too short to be kept.", "published_mean_word": "a b c " * 40, "published_symbols": prose + " #" * 40, "published_alphabetic": prose + " 1 2 3" * 40,
        "published_bullets": "- one thing\n- two things", "published_ellipses": "One ...\nTwo ...", "published_stop_words": "Zwei Gruppen nahmen zehn Wochen lang Tropfen.", "published_line_ends": "No mark here\nnor here",
    }
    _, kinds, why = textstats.kinds([prose, *cases.values()])
    assert kinds[0] == "prose" and why[0] == []
    assert all(name in w for name, w in zip(cases, why[1:]))


@pytest.mark.parametrize("n", [2_000, 40_000])
def test_valleys_in_one_pass(n):
    text = ". ".join(f"w{i}" for i in range(n))
    gaps = [m.end() for m in re.finditer(r"\. ", text)]
    assert p02_pieces.valleys(text, gaps) == [0.0] * (n - 1)
    text = "a b. a b. a c. d e. d e. d f."
    gaps = [m.end() for m in re.finditer(r"\. ", text)]
    depth = p02_pieces.valleys(text, gaps)
    assert max(range(len(depth)), key=depth.__getitem__) == 2


def test_names_and_first_words_are_told_by_the_document():
    s = Splitter()
    text = "They went to the E.U. Patients stayed. All the patients slept."
    assert [text[a:b] for a, b in s.units(text)] == ["They went to the E.U.", "Patients stayed.", "All the patients slept."]
    text = "They saw St. Oridal ward. Then, approx. Ralomib at noon, and with Ralomib all slept."
    assert len(s.units(text)) == 2
    text = "mg " * 200 + "THIS IS NOT SET IN CAPITALS. so it ends."
    assert not s.units(text) or s.upper is False


def test_long_abbreviations_and_unbroken_texts():
    text = "He used antiinflammatorial. drugs, and antiinflammatorial. Ralomib again."
    assert len(Splitter().units(text)) == 1
    assert Splitter().units("a." * 60_000)


def test_reliability_is_the_leading_eigenvector(spark):
    rng = random.Random(8)
    skill, rows = {"a": 0.9, "b": 0.8, "c": 0.6, "d": 0.3, "e": 0.0}, []
    for u in range(3000):
        t = rng.randrange(4)
        rows += [(str(u), a, t if rng.random() < s else rng.randrange(4)) for a, s in skill.items() if rng.random() < 0.8]
    votes = spark.createDataFrame(rows, "unit_id string, annotator_id string, lab int")
    m = p07_consensus.agreements(votes).toPandas().pivot(index="a", columns="b", values="m").fillna(0.0)
    value, vector = np.linalg.eigh(m.to_numpy())
    lead = vector[:, -1] * np.sign(vector[:, -1].sum())
    got = {r.annotator_id: r.r for r in p07_consensus.reliabilities(votes).collect()}
    r = np.array([got[a] for a in m.index])
    assert np.allclose(r / np.linalg.norm(r), lead, atol=0.01)
    assert sorted(got, key=got.get, reverse=True) == list("abcde")


def test_found_names():
    assert {n for n in queries.QUERIES if n.endswith("_found")} == {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)}
    assert all(re.match(r"p\d+_", n) for n in queries.QUERIES)
