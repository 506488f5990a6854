"""Quotes in passages, and resampling against exact figures."""

import itertools

import pytest
from pyspark.sql import functions as F

from attestra.operators import agreement, quotes

TEXT = "The  drug lowered\npain at rest; ANN 😀 said “well”. End."


@pytest.mark.parametrize(
    "quote,tier,span",
    [
        ("pain at rest", 1, "pain at rest"),
        (' "pain at rest" ', 1, "pain at rest"),
        ("“'lowered'”", None, None),
        ("\"'lowered'\"", 1, "lowered"),
        ("The drug lowered pain", 2, "The  drug lowered\npain"),
        ("ann 😀 SAID", 3, "ANN 😀 said"),
        ("lowered pain,", 4, "lowered\npain"),
        (".end", 5, "End"),
        ("drug raised", None, None),
        ("a.b*", None, None),
        ("", 1, ""),
        ("  ", 1, ""),
        (None, None, None),
    ],
)
def test_quotes_are_located_by_tiers(spark, quote, tier, span):
    r = quotes.locate(spark.createDataFrame([(quote, TEXT)], "q string, t string"), "q", "t").first()
    assert (r.tier, r.span_text) == (tier, span)
    if tier:
        assert TEXT[r.span_start : r.span_end] == span


def test_missed_quotes_by_kind():
    text = "In week four the drug lowered pain at rest in most adults with gout. Nobody left the study before its planned end, and the mean weight of the adults stayed as it was."
    assert quotes.miss_kind("IN WEEK FOUR the drug", text) == "case"
    assert quotes.miss_kind("something that was never said by anybody here", text) == "fabricated"
    assert quotes.miss_kind("In week four the drug lowered pain the mean weight of the adults stayed", text) == "spliced"
    assert quotes.miss_kind("the mean weight of the adults stayed as it was. And then more was said.", text) == "overrun"
    assert quotes.miss_kind("the drug lowered pain at rest in some of the adults", text) == "reworded"


def test_permutation_comes_near_the_exact_share(spark):
    rows = [(True, 9.0), (True, 8.0), (True, 5.0), (False, 4.0), (False, 3.0), (False, 5.0), (False, 1.0), (False, None), (None, 2.0)]
    values = [v for m, v in rows if v is not None and m is not None]
    apart = lambda chosen: abs(sum(values[i] for i in chosen) / 3 - sum(v for i, v in enumerate(values) if i not in chosen) / 4)
    all_of = [apart(set(c)) for c in itertools.combinations(range(7), 3)]
    exact = sum(x >= apart({0, 1, 2}) - 1e-9 for x in all_of) / len(all_of)
    r = agreement.permutation_p(spark.createDataFrame(rows, "miss boolean, v double")).first()
    assert (r.n_miss, r.n) == (3, 7) and abs(r.p_value - exact) < 0.005
    one_kind = spark.createDataFrame([(True, 1.0)], "miss boolean, v double")
    assert agreement.permutation_p(one_kind).first().p_value is None
    assert agreement.permutation_p(one_kind.where("false")).count() == 0


def test_intermediates_can_be_removed(spark):
    from attestra.plans import durable

    df = durable.spool(spark.range(5).withColumn("x", F.col("id") * 2), "five")
    assert df.count() == 5
    path = df.inputFiles()[0].removeprefix("file://")
    durable.clear(spark)
    import os

    assert not os.path.exists(path)
