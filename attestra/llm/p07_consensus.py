"""Problem 7: a consensus label per unit, an agreement figure, and a reliability per annotator.

Reliability is spectral. Each vote is centred by the annotator's own label
shares, so agreement by chance counts as nothing. One join on units gives, per
pair of annotators, their centred agreement and the units that they share; a
unit has at most one vote of each annotator, so the table of pairs grows with
the annotators, who are few, not with the votes. The agreement over the shared
units is the matrix whose leading eigenvector gives the reliabilities, by power
iteration: joins of the pairs with the vector, until it stays as it is.

The reliabilities weight the vote. Annotators who confuse labels in a regular
way (mirrored or shifted scales) are then read through their confusion with
that vote, in a few rounds of joins; README states how many labels that changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import spool
from ..sources.tables import once, table

# The labels.
LABELS = ("SUPPORTED", "PARTIAL", "NOT_SUPPORTED", "CONTRADICTED")
K = len(LABELS)
#: Rounds of the power iteration at most, the change of the vector at which it stops, and rounds of the reading through confusions.
ROUNDS, STILL, REFINE = 60, 1e-4, 5
#: Units that every pair's overlap is counted as having beside, in which the pair agrees by chance.
SHRINK = 4.0
#: Votes that the prior of a confusion row counts as.
SMOOTH = 6.0
#: A unit is reported from so many annotators with usable labels.
LEAST_ANNOTATORS = 3


def usable_votes(labels: DataFrame) -> DataFrame:
    """(unit_id, annotator_id, lab) with the latest usable label of each annotator for each unit.

    Unusable are null and anything but the four values, give or take case,
    blanks and - for _. Rows without unit or annotator are left out. Of equal
    times the larger label_id is the later; a null time is the earliest.
    """
    name = F.regexp_replace(F.upper(F.trim("support_label")), r"[\s_-]+", "_")
    code = reduce(lambda acc, i: F.when(name == LABELS[i], i).otherwise(acc), range(K), F.lit(None).cast("int"))
    rows = once(labels.select("label_id", "unit_id", "annotator_id", "saved_at", code.alias("lab")), "label_id").where("lab is not null and unit_id is not null and annotator_id is not null")
    return rows.groupBy("unit_id", "annotator_id").agg(F.max_by("lab", F.struct("saved_at", "label_id")).alias("lab"))


def _is(i: int) -> Column:
    return (F.col("lab") == i).cast("double")


def agreements(votes: DataFrame) -> DataFrame:
    """(a, b, m): mean centred agreement of every two annotators over the units that they share, both ways round."""
    shares = votes.groupBy("annotator_id").agg(*[F.avg(_is(i)).alias(f"p{i}") for i in range(K)])
    z = votes.join(shares, "annotator_id").select("unit_id", "annotator_id", *[(_is(i) - F.col(f"p{i}")).alias(f"z{i}") for i in range(K)])
    other = z.select("unit_id", F.col("annotator_id").alias("b"), *[F.col(f"z{i}").alias(f"y{i}") for i in range(K)])
    both = z.withColumnRenamed("annotator_id", "a").join(other, "unit_id").where("a <> b")
    product = reduce(lambda x, y: x + y, [F.col(f"z{i}") * F.col(f"y{i}") for i in range(K)])
    return both.groupBy("a", "b").agg((F.sum(product) / (F.count(F.lit(1)) + SHRINK)).alias("m"))


def reliabilities(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(annotator_id, r): the leading eigenvector of the agreements, scaled so that the product of two entries estimates theirs.

    A row with few partners is raised to what all partners would give. The sign
    is that of the majority. An annotator who shares no unit with others has no
    estimate (r is 0).
    """
    pairs = spool(agreements(votes), "agreements")
    every = spool(votes.select("annotator_id").distinct(), "annotators")
    n = every.count()
    row = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    pairs = spool(pairs.join(row, "a").select("a", "b", (F.col("m") * (n - 1) / F.col("partners")).alias("m")), "corrected")
    v = every.select("annotator_id", F.lit(1 / max(1, n) ** 0.5).alias("v"))
    for _ in range(rounds):
        # the vector itself is added, which keeps the iteration from swinging where eigenvalues are negative
        moved = pairs.join(v.withColumnRenamed("annotator_id", "b"), "b").groupBy(F.col("a").alias("annotator_id")).agg(F.sum(F.col("m") * F.col("v")).alias("mv"))
        step = spool(v.join(moved, "annotator_id", "left").select("annotator_id", "v", F.coalesce("mv", F.lit(0.0)).alias("mv")), "step")
        size = step.agg(F.sqrt(F.sum((F.col("mv") + F.col("v")) * (F.col("mv") + F.col("v")))).alias("x")).first()["x"] or 1.0
        v = step.select("annotator_id", ((F.col("mv") + F.col("v")) / size).alias("v"))
        change = step.agg(F.max(F.abs((F.col("mv") + F.col("v")) / size - F.col("v"))).alias("x")).first()["x"]
        if change is None or change < STILL:
            break
    v = spool(v, "eigenvector")
    # v'Mv is the eigenvalue less what the empty diagonal lacks
    w = v.join(pairs.join(v.withColumnRenamed("annotator_id", "b"), "b").groupBy(F.col("a").alias("annotator_id")).agg(F.sum(F.col("m") * F.col("v")).alias("mv")), "annotator_id", "left")
    x = w.agg(F.sum(F.col("v") * F.coalesce("mv", F.lit(0.0))).alias("q"), F.sum(F.pow("v", F.lit(4))).alias("f"), F.sum("v").alias("s")).first()
    scale = (max(0.0, x["q"] or 0.0) / max(1e-9, 1 - min(0.9, x["f"] or 0.0))) ** 0.5 * (-1.0 if (x["s"] or 0.0) < 0 else 1.0)
    return w.select("annotator_id", F.when(F.col("mv").isNull(), 0.0).otherwise(F.col("v") * F.lit(scale)).alias("r"))


def _softmax(cols: list[Column]) -> list[Column]:
    top = F.greatest(*cols)
    e = [F.exp(c - top) for c in cols]
    total = reduce(lambda a, b: a + b, e)
    return [x / total for x in e]


def consensus(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, annotators): posteriors t0.. per unit with n_annotators; r, skill and n_labels per annotator."""
    votes = spool(votes, "usable")
    r = reliabilities(votes)
    share = votes.agg(*[F.avg(_is(i)).alias(f"g{i}") for i in range(K)])
    spread = reduce(lambda a, b: a + b, [F.col(f"g{i}") * F.col(f"g{i}") for i in range(K)])
    n = votes.groupBy("annotator_id").agg(F.count(F.lit(1)).alias("n_labels"))
    # r estimates skill times the spread of the true labels, of which the votes' own spread is the measure
    skill = F.greatest(F.lit(-0.3), F.least(F.lit(0.98), F.col("r") / F.sqrt("u")))
    annotators = r.join(n, "annotator_id").crossJoin(share.select((1 - spread).alias("u")))
    annotators = spool(annotators.select("annotator_id", "r", "n_labels", skill.alias("skill")), "annotators")
    accuracy = F.greatest(F.lit(0.02), F.col("skill") + (1 - F.col("skill")) / K)
    weighted = votes.join(annotators.select("annotator_id", F.log(accuracy * (K - 1) / (1 - accuracy)).alias("w"), accuracy.alias("acc")), "annotator_id")
    units = weighted.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_annotators"), *[F.sum(F.col("w") * _is(i)).alias(f"l{i}") for i in range(K)])
    post = _softmax([F.col(f"l{i}") for i in range(K)])
    units = spool(units.select("unit_id", "n_annotators", *[p.alias(f"t{i}") for i, p in enumerate(post)]), "posterior")
    for _ in range(REFINE):
        # confusion: how often an annotator gives a label where the vote says another
        seen = votes.join(units.where("n_annotators > 1"), "unit_id").groupBy("annotator_id", "lab").agg(*[F.sum(f"t{i}").alias(f"c{i}") for i in range(K)])
        total = seen.groupBy("annotator_id").agg(*[F.sum(f"c{i}").alias(f"n{i}") for i in range(K)])
        acc = annotators.select("annotator_id", accuracy.alias("acc"))
        prior = lambda i: F.when(F.col("lab") == i, F.col("acc")).otherwise((1 - F.col("acc")) / (K - 1))
        ll = seen.join(total, "annotator_id").join(acc, "annotator_id").select("annotator_id", "lab", *[F.log((F.col(f"c{i}") + SMOOTH * prior(i)) / (F.col(f"n{i}") + SMOOTH)).alias(f"l{i}") for i in range(K)])
        base = units.agg(*[F.log(F.greatest(F.avg(f"t{i}"), F.lit(1e-6))).alias(f"b{i}") for i in range(K)])
        sums = votes.join(ll, ["annotator_id", "lab"]).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_annotators"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(K)]).crossJoin(base)
        post = _softmax([F.col(f"l{i}") + F.col(f"b{i}") for i in range(K)])
        units = spool(sums.select("unit_id", "n_annotators", *[p.alias(f"t{i}") for i, p in enumerate(post)]), "posterior")
    return units, annotators


def _best() -> Column:
    top = F.greatest(*[F.col(f"t{i}") for i in range(K)])
    return reduce(lambda acc, i: F.when(F.col(f"t{i}") >= top, LABELS[i]).otherwise(acc), reversed(range(K)), F.lit(None).cast("string"))


def unit_labels(spark: SparkSession, d: str) -> DataFrame:
    """Per unit its consensus label, the posterior of it, and the share of annotators who gave it."""
    votes = spool(usable_votes(table(spark, d, "human_labels")), "votes")
    units, _ = consensus(votes)
    best = units.select("unit_id", "n_annotators", _best().alias("support_label"), F.greatest(*[F.col(f"t{i}") for i in range(K)]).alias("posterior"))
    given = reduce(lambda acc, i: F.when(F.col("lab") == i, LABELS[i]).otherwise(acc), range(K), F.lit(None).cast("string"))
    agree = votes.select("unit_id", given.alias("given")).join(best, "unit_id").groupBy("unit_id").agg(F.avg((F.col("given") == F.col("support_label")).cast("double")).alias("agreement"))
    return best.join(agree, "unit_id").select("unit_id", "n_annotators", "support_label", F.round("posterior", 6).alias("posterior"), F.round("agreement", 6).alias("agreement"))


def found(spark: SparkSession, d: str) -> DataFrame:
    """The consensus label of every unit with usable labels from at least three annotators."""
    units, _ = consensus(usable_votes(table(spark, d, "human_labels")))
    return units.where(F.col("n_annotators") >= LEAST_ANNOTATORS).select("unit_id", _best().alias("support_label"))


def annotator_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Per annotator the eigenvector entry and the skill: 1 is always right, 0 no better than chance, below 0 misleading."""
    _, annotators = consensus(usable_votes(table(spark, d, "human_labels")))
    return annotators.select("annotator_id", "n_labels", F.round("r", 6).alias("eigen_reliability"), F.round("skill", 6).alias("skill"))


QUERIES = {"p7_found": found, "p7_unit_labels": unit_labels, "p7_annotators": annotator_reliability}
SQL: dict[str, str] = {}
