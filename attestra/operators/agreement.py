"""Agreement, calibration and resampling: alpha, AUROC, ECE, threshold sweeps, rank correlation, bootstrap and permutation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import r6
from ..plans.durable import spool
from ..sources import records as R
from ..sources.tables import once, table

# The support labels on their scale.
SCALE = ("CONTRADICTED", "NOT_SUPPORTED", "PARTIAL", "SUPPORTED")
#: Scores are compared on this many decimals, so that ties are the same everywhere.
DIGITS = 6


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """(unit_id, annotator_id, lab): the latest usable label per unit and annotator, as a place on the scale."""
    x = once(table(spark, d, "human_labels").select("label_id", "unit_id", "annotator_id", "support_label", "saved_at"), "label_id")
    name = F.regexp_replace(F.upper(F.trim("support_label")), r"[\s_-]+", "_")
    code = reduce(lambda a, i: F.when(name == SCALE[i], i).otherwise(a), range(4), F.lit(None).cast("int"))
    return x.withColumn("lab", code).where("lab is not null").groupBy("unit_id", "annotator_id").agg(F.max_by("lab", F.struct("saved_at", "label_id")).alias("lab"))


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the labels in the order of the scale, zeros included."""
    n = ratings(spark, d).groupBy("lab").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(list(enumerate(SCALE)), "lab int, label string").join(n, "lab", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def coincidence(spark: SparkSession, d: str) -> DataFrame:
    """The coincidence matrix: per unit with m >= 2 ratings, pairs of labels weighted by 1 / (m - 1). Four counts per unit stand for its pairs."""
    u = ratings(spark, d).groupBy("unit_id").agg(*[F.count_if(F.col("lab") == i).alias(f"n{i}") for i in range(4)], F.count(F.lit(1)).alias("m")).where("m >= 2")
    cells = [F.sum((F.col(f"n{c}") * F.col(f"n{k}") - (F.col(f"n{c}") if c == k else F.lit(0))) / (F.col("m") - 1)).alias(f"o{c}{k}") for c in range(4) for k in range(4)]
    wide = u.agg(*cells)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(k).alias("k"), F.col(f"o{c}{k}").alias("o")) for c in range(4) for k in range(4)])).alias("x")).select("x.*")


def alpha(spark: SparkSession, d: str) -> DataFrame:
    """Krippendorff's alpha on the two-way collapse and on the ordinal scale; 1 if no disagreement was to be expected."""
    o = coincidence(spark, d).where("o is not null")
    n = o.groupBy("c").agg(F.sum("o").alias("n"))
    upto = n.select("c", "n", F.sum("n").over(Window.orderBy("c")).alias("upto"))  # four rows
    lo, hi = (upto.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("upto").alias(f"upto_{x}")) for x in ("c", "k"))
    x = o.join(lo, "c").join(hi, "k")
    # the weight of all labels between the two, the ends counting half
    between = F.abs(F.col("upto_k") - F.col("upto_c")) + F.when(F.col("c") < F.col("k"), F.col("n_c")).otherwise(F.col("n_k")) - (F.col("n_c") + F.col("n_k")) / 2
    x = x.withColumns({"two": ((F.col("c") >= 2) != (F.col("k") >= 2)).cast("double"), "ord": F.when(F.col("c") != F.col("k"), between * between).otherwise(F.lit(0.0)), "chance": F.col("n_c") * F.col("n_k")})
    total = F.sum("o")

    def result(delta: str):
        chance = F.sum(F.col("chance") * F.col(delta))
        return F.when(total > 0, F.when(chance == 0, F.lit(1.0)).otherwise(1 - (total - 1) * F.sum(F.col("o") * F.col(delta)) / chance))

    return x.agg(r6(total, "n_values"), r6(result("two"), "alpha_binary"), r6(result("ord"), "alpha_ordinal"))


def gate_g4(spark: SparkSession, d: str) -> DataFrame:
    """The agreement gate: alpha of at least .6 over at least 250 claims."""
    n = once(table(spark, d, "human_labels").select("label_id", "claim_key", "unit_id"), "label_id").agg(F.count_distinct("claim_key").alias("n_claims"), F.count_distinct("unit_id").alias("n_units"))
    return alpha(spark, d).crossJoin(n).select("n_claims", "n_units", "alpha_binary", ((F.col("alpha_binary") >= 0.6) & (F.col("n_claims") >= 250)).alias("passes"))


def scored(spark: SparkSession, d: str, verifier: str = "minifact") -> DataFrame:
    """(score_id, claim_key, s, y): scores of one verifier with the majority judgement of the claim; ties of votes are left out."""
    good = ratings(spark, d).join(once(table(spark, d, "human_labels").select("label_id", "unit_id", "claim_key"), "label_id").select("unit_id", "claim_key").distinct(), "unit_id")
    y = good.groupBy("claim_key").agg(F.avg((F.col("lab") >= 2).cast("double")).alias("p")).where("p <> 0.5").select("claim_key", (F.col("p") > 0.5).alias("y"))
    s = once(table(spark, d, "verifier_scores").select("score_id", "claim_key", "verifier_name", "score"), "score_id")
    s = s.where((F.col("verifier_name") == verifier) & F.col("score").isNotNull() & ~F.isnan("score"))
    return s.select("score_id", "claim_key", F.round("score", DIGITS).alias("s")).join(y, "claim_key")


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    """Positives and negatives per distinct score: what all the curves need."""
    return scored(spark, d).groupBy("s").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))


def auroc(spark: SparkSession, d: str) -> DataFrame:
    """Area under the ROC curve with ties as one half; null if a class is missing."""
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    v = value_counts(spark, d).withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    x = v.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"))
    return x.select("n_pos", "n_neg", r6(F.col("u") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0)), "auroc"))


def ece_bins(spark: SparkSession, d: str, bins: int = 10) -> DataFrame:
    """Calibration bins of equal width, right-closed, the first closed on both sides; boundaries from a table, scores clipped to [0, 1]."""
    edges = spark.createDataFrame([(j, j / bins, (j + 1) / bins) for j in range(bins)], "bin int, lo double, hi double")
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s")))
    x = scored(spark, d).select(s.alias("s"), "y").groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("pos"))
    b = x.join(F.broadcast(edges), ((F.col("s") > F.col("lo")) | ((F.col("bin") == 0) & (F.col("s") == 0))) & (F.col("s") <= F.col("hi")))
    g = b.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("s") * F.col("n")).alias("sum_s"))
    return edges.join(g, "bin", "left").select(F.col("bin").cast("bigint").alias("bin"), F.coalesce("n", F.lit(0)).alias("n"), r6(F.col("pos") / F.col("n"), "accuracy"), r6(F.col("sum_s") / F.col("n"), "confidence"))


def ece(spark: SparkSession, d: str) -> DataFrame:
    """Expected calibration error: the mean gap of accuracy and confidence, weighted by the bins' sizes."""
    b = ece_bins(spark, d)
    return b.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n"), 5).alias("ece"))


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct score as a threshold (predict at or above it): counts, precision, recall and F1, 0 where undefined."""
    w = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    v = value_counts(spark, d)
    t = v.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    x = v.select("s", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp")).crossJoin(t).withColumns({"fn": F.col("all_pos") - F.col("tp"), "tn": F.col("all_neg") - F.col("fp")})
    zero = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return x.select(F.col("s").alias("threshold"), "tp", "fp", "fn", "tn", r6(zero(tp, tp + fp), "precision"), r6(zero(tp, tp + fn), "recall"), r6(zero(2.0 * tp, 2 * tp + fp + fn), "f1"))


def paired_scores(spark: SparkSession, d: str, a: str = "minifact", b: str = "alignprobe") -> DataFrame:
    """Mean scores of two verifiers on the claims that both scored."""
    s = once(table(spark, d, "verifier_scores").select("score_id", "claim_key", "verifier_name", "score"), "score_id").where("score is not null and not isnan(score)")
    g = s.groupBy("claim_key").agg(F.round(F.avg(F.when(F.col("verifier_name") == a, F.col("score"))), DIGITS).alias("a"), F.round(F.avg(F.when(F.col("verifier_name") == b, F.col("score"))), DIGITS).alias("b"))
    return g.where("a is not null and b is not null")


def spearman(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation with ties at their mean rank. Ranks come from counts per distinct score, so ties cost nothing."""
    p = paired_scores(spark, d)

    def ranks(c: str) -> DataFrame:
        n = p.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy(c))
        return n.select(c, (upto - F.col("n") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    x = p.join(ranks("a"), "a").join(ranks("b"), "b")
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("ra", "rb"), 5).alias("spearman"))


def separation(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of supported minus mean score of unsupported claims, and their numbers."""
    return scored(spark, d).agg(F.count_if("y").alias("n_pos"), F.count_if(~F.col("y")).alias("n_neg"), F.round(F.avg(F.when(F.col("y"), F.col("s"))) - F.avg(F.when(~F.col("y"), F.col("s"))), 5).alias("separation"))


def crossings(spark: SparkSession, d: str) -> DataFrame:
    """Claims on which two verifiers fall on different sides of each threshold."""
    p = paired_scores(spark, d)
    return p.select("a", "b", F.explode(F.array(*[F.lit(t) for t in (0.1, 0.3, 0.5, 0.7, 0.9)])).alias("tau")).groupBy("tau").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("a") >= F.col("tau")) != (F.col("b") >= F.col("tau"))).alias("crossings"))


def draws(spark: SparkSession, clusters: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(replicate, idx): for each replicate as many draws with replacement as there are clusters, by hash, so reproducible everywhere."""
    n = clusters.agg(F.count(F.lit(1)).alias("n"))
    x = spark.range(n_boot).withColumnRenamed("id", "replicate").crossJoin(n).select("replicate", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("pos").cast("string"))), 1, 8), 16, 10).cast("bigint")
    return x.select("replicate", F.pmod(h, F.col("n")).alias("idx"))


#: Draws that are hashed at once.
HASHED = 32_768
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _first_words(prefix: bytes, pos: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 digests of ``prefix`` with each number of ``pos`` behind it; all numbers have as many digits."""
    size = len(prefix) + len(str(int(pos[0])))
    if size > 55:
        raise ValueError("more than one block to hash")
    text = np.zeros((64, len(pos)), dtype=np.uint8)
    text[: len(prefix)] = np.frombuffer(prefix, dtype=np.uint8)[:, None]
    left = pos.astype(np.uint32)
    for i in range(size - 1, len(prefix) - 1, -1):
        rest = left // np.uint32(10)
        text[i] = 48 + (left - rest * np.uint32(10))
        left = rest
    text[size], text[56], text[57] = 128, size * 8 & 255, size * 8 >> 8
    # words that no digit touches are one number for all
    touched = range(len(prefix) // 4, (size - 1) // 4 + 1)
    words = [np.ascontiguousarray(text[4 * i : 4 * i + 4].T).view("<u4").ravel() if i in touched else np.uint32(int.from_bytes(text[4 * i : 4 * i + 4, 0].tobytes(), "little")) for i in range(16)]
    full = lambda x: np.full(len(pos), x, dtype=np.uint32)
    a, b, c, d = full(0x67452301), full(0xEFCDAB89), full(0x98BADCFE), full(0x10325476)
    f, t = full(0), full(0)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        w, shift = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16], _SHIFTS[turn][i % 4]
        np.add(f, a, out=f)
        if isinstance(w, np.ndarray):
            np.add(f, w, out=f), np.add(f, np.uint32(_SINES[i]), out=f)
        else:
            np.add(f, np.uint32((int(w) + _SINES[i]) & 0xFFFFFFFF), out=f)
        np.left_shift(f, np.uint32(shift), out=t), np.right_shift(f, np.uint32(32 - shift), out=f), np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(0x67452301)).byteswap()


def drawn(replicate: int, n: int, seed: int) -> Iterator[np.ndarray]:
    """The clusters of one replicate as of ``draws``, in pieces."""
    at = 0
    while at < n:
        end = min(n, at + HASHED, 10 ** len(str(at)))
        yield (_first_words(f"{seed}:{replicate}:".encode(), np.arange(at, end)) % np.uint32(n)).astype(np.int64)
        at = end


def replicates(spark: SparkSession, n_boot: int) -> DataFrame:
    """Numbers of replicates as ``id``, in a part of the work for each of 64 tasks at most."""
    return spark.range(0, n_boot, 1, min(n_boot, 64))


def packed(df: DataFrame, *cols: str) -> list[np.ndarray]:
    """Whole-number columns on the driver, each in the smallest type that holds it."""
    t = df.select(*[F.col(c).cast("bigint").alias(c) for c in cols]).toArrow()
    x = [t[c].to_numpy() for c in cols]
    return [v.astype(np.promote_types(np.min_scalar_type(v.min()), np.min_scalar_type(v.max()))) if len(v) else v.astype(np.int64) for v in x]


def bootstrap(stats: DataFrame, spark: SparkSession, top: str, bottom: str, n_boot: int = 10_000, seed: int = 7) -> DataFrame:
    """Percentile interval of sum(top) / sum(bottom) over resampled clusters.

    ``stats`` has one row (cluster, idx 0..n-1, top, bottom) of whole numbers:
    each cluster is reduced to its sums before it is resampled. The sums go to
    every task in a few bytes a cluster; a task adds up its replicates draw by
    draw, so no draw is ever a row.
    """
    stats = spool(stats.select("idx", top, bottom), "clusters")
    idx, a, b = packed(stats, "idx", top, bottom)
    order = np.argsort(idx)
    shared = spark.sparkContext.broadcast((a[order], b[order]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = shared.value
        for pdf in batches:
            sums = [[(int(a[i].sum(dtype=np.int64)), int(b[i].sum(dtype=np.int64))) for i in drawn(r, len(a), seed)] for r in pdf["id"].tolist()] if len(a) else []
            pairs = [tuple(map(sum, zip(*x))) for x in sums]
            yield pd.DataFrame({"t": [x for x, _ in pairs], "b": [y for _, y in pairs]}, dtype="int64")

    r = replicates(spark, n_boot).mapInPandas(run, "t bigint, b bigint").select((F.col("t") / F.nullif(F.col("b"), F.lit(0))).alias("v"))
    ci = r.agg(F.count("v").alias("n_boot"), F.round(F.percentile("v", F.lit(0.025)), 5).alias("lower"), F.round(F.percentile("v", F.lit(0.975)), 5).alias("upper"))
    point = stats.agg(F.count(F.lit(1)).alias("n_clusters"), F.round(F.sum(top) / F.nullif(F.sum(bottom), F.lit(0)), 5).alias("point"))
    return point.crossJoin(ci).withColumn("width", F.round(F.col("upper") - F.col("lower"), 5))


def _indexed(df: DataFrame, key: str) -> DataFrame:
    """Clusters numbered from 0 in the order of their key; one row per cluster."""
    return df.withColumn("idx", F.row_number().over(Window.orderBy(key)) - 1)


def accuracy_units(spark: SparkSession, d: str) -> DataFrame:
    """Per query the right and the judged decisions."""
    x = R.records(spark, d, "query_id", "final_decision", "gold_final_decision").select("query_id", F.lower(F.trim("final_decision")).alias("p"), F.lower(F.trim("gold_final_decision")).alias("g")).where("p in ('yes', 'no', 'maybe') and g in ('yes', 'no', 'maybe')")
    return x.groupBy("query_id").agg(F.count_if(F.col("p") == F.col("g")).alias("good"), F.count(F.lit(1)).alias("n"))


def bootstrap_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy with its query-clustered bootstrap interval."""
    return bootstrap(_indexed(accuracy_units(spark, d), "query_id"), spark, "good", "n")


def design_effect(spark: SparkSession, d: str) -> DataFrame:
    """Clustered over unclustered interval width of accuracy, the design effect and the effective number of records."""
    q = accuracy_units(spark, d)
    flat = q.select("query_id", "good", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).select(F.concat_ws("#", "query_id", F.format_string("%06d", "i")).alias("u"), (F.col("i") <= F.col("good")).cast("bigint").alias("good"), F.lit(1).cast("bigint").alias("n"))
    a = bootstrap(_indexed(q, "query_id"), spark, "good", "n").select(F.col("width").alias("clustered"))
    b = bootstrap(_indexed(flat, "u"), spark, "good", "n").select(F.col("width").alias("flat"), F.col("n_clusters").alias("n_units"))
    ratio = F.col("clustered") / F.col("flat")
    return a.crossJoin(b).select("n_units", "clustered", "flat", F.round(ratio, 3).alias("width_ratio"), F.round(ratio * ratio, 3).alias("design_effect"), F.round(F.col("n_units") / (ratio * ratio), 1).alias("n_effective"))


#: Permutations that one task draws at a time.
DRAWN = 2_000
#: Distinct values that a permutation test may have, as they are sent to every task.
MOST_VALUES = 100_000


def permutation_p(units: DataFrame, n_perm: int = 200_000, seed: int = 11) -> DataFrame:
    """(n_miss, n, observed, extreme, p_value): two-sided permutation test of the difference of means of v between miss and hit.

    ``units`` has one row (miss, v) per unit. Units of equal value are alike, so
    a permutation is a draw of how many misses each distinct value gets: its
    size is the number of values, not of units. Without units of both kinds
    there is no difference: the figures are null.
    """
    spark = units.sparkSession
    kept = units.where("v is not null and miss is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.count_if("miss").alias("k")).orderBy("v").limit(MOST_VALUES + 1).collect()
    if len(kept) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} distinct values")
    v, n, k = (np.array([r[c] for r in kept], dtype=t) for c, t in (("v", float), ("n", np.int64), ("k", np.int64)))
    misses, size = int(k.sum()), int(n.sum())
    schema = "n_miss bigint, n bigint, observed double, extreme bigint, p_value double"
    if misses == 0 or misses == size:
        return spark.createDataFrame([(misses, size, None, None, None)] if size else [], schema)
    total = float(v @ n)
    apart = lambda s: np.abs(s / misses - (total - s) / (size - misses))
    observed = float(apart(float(v @ k)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = 0
            for block in pdf["id"]:
                rng = np.random.default_rng([seed, int(block)])
                drawn = rng.multivariate_hypergeometric(n, misses, size=min(DRAWN, n_perm - int(block) * DRAWN), method="marginals")
                hits += int((apart(drawn @ v) >= observed - 1e-9).sum())
            yield pd.DataFrame({"hits": [hits]})

    blocks = -(-n_perm // DRAWN)
    drawn = spark.range(0, blocks, 1, min(blocks, 64)).mapInPandas(run, "hits bigint").agg(F.sum("hits").alias("extreme"))
    return drawn.select(F.lit(misses).cast("bigint").alias("n_miss"), F.lit(size).cast("bigint").alias("n"), F.lit(round(observed, 5)).alias("observed"), "extreme", F.round((F.col("extreme") + 1) / (n_perm + 1), 6).alias("p_value"))


def permutation(spark: SparkSession, d: str) -> DataFrame:
    """Do the questions of queries with and without a wrong decision differ in length?"""
    q = accuracy_units(spark, d).select("query_id", (F.col("good") < F.col("n")).alias("miss"))
    size = R.records(spark, d, "query_id", "question").where("question is not null").groupBy("query_id").agg(F.max(F.char_length("question")).alias("v"))
    return permutation_p(q.join(size, "query_id"))


QUERIES = {
    "agg12_label_distribution": label_distribution,
    "agg13_coincidence": lambda s, d: coincidence(s, d).select(F.col("c").cast("bigint").alias("c"), F.col("k").cast("bigint").alias("k"), r6(F.col("o"), "o")),
    "sc18_alpha": alpha,
    "sc19_gate_g4": gate_g4,
    "sc8_auroc": auroc,
    "sc9_ece_bins": ece_bins,
    "sc9_ece": ece,
    "sc10_sweep": sweep,
    "win8_spearman": spearman,
    "sc25_separation": separation,
    "sc25_crossings": crossings,
    "sc11_bootstrap_accuracy": bootstrap_accuracy,
    "sc21_design_effect": design_effect,
    "sc20_permutation": permutation,
}

_RT = r"""WITH hl AS (SELECT DISTINCT ON (label_id) label_id, unit_id, claim_key, annotator_id, saved_at, list_position(['CONTRADICTED', 'NOT_SUPPORTED', 'PARTIAL', 'SUPPORTED'], regexp_replace(upper(trim(support_label)), '[\s_-]+', '_', 'g')) - 1 AS lab FROM human_labels),
rt AS (SELECT unit_id, annotator_id, arg_max(lab, (coalesce(saved_at, '1900-01-01'::TIMESTAMPTZ), label_id)) AS lab FROM hl WHERE lab >= 0 GROUP BY 1, 2)"""
_CO = _RT + ", u AS (SELECT unit_id, list_transform(range(0, 4), lambda i: len(list_filter(list(lab), lambda x: x = i))) AS n, count(*) AS m FROM rt GROUP BY 1 HAVING count(*) >= 2), co AS (SELECT c, k, sum((n[c + 1] * n[k + 1] - CASE WHEN c = k THEN n[c + 1] ELSE 0 END) / (m - 1)) AS o FROM u, (SELECT unnest(range(0, 4)) AS c), (SELECT unnest(range(0, 4)) AS k) GROUP BY 1, 2), nn AS (SELECT c, sum(o) AS n FROM co GROUP BY 1), tt AS (SELECT sum(n) AS t FROM nn), dl AS (SELECT a.c, b.c AS k, a.n AS na, b.n AS nb, ((a.c >= 2) <> (b.c >= 2))::INT AS db, CASE WHEN a.c = b.c THEN 0 ELSE power((SELECT sum(n) FROM nn WHERE c BETWEEN least(a.c, b.c) AND greatest(a.c, b.c)) - (a.n + b.n) / 2, 2) END AS dо FROM nn a, nn b), al AS (SELECT round(any_value(t), 6) AS n_values, round(1 - (any_value(t) - 1) * sum(o * db) / sum(na * nb * db), 6) AS alpha_binary, round(1 - (any_value(t) - 1) * sum(o * dо) / sum(na * nb * dо), 6) AS alpha_ordinal FROM dl JOIN co USING (c, k), tt)".replace("dо", "d_o")
_SC = _RT + ", y AS (SELECT claim_key, avg((lab >= 2)::INT) > 0.5 AS y FROM rt JOIN (SELECT DISTINCT unit_id, claim_key FROM hl) USING (unit_id) GROUP BY 1 HAVING avg((lab >= 2)::INT) <> 0.5), v AS (SELECT DISTINCT ON (score_id) * FROM verifier_scores), sc AS (SELECT round(score, 6) AS s, y FROM v JOIN y USING (claim_key) WHERE verifier_name = 'minifact' AND score IS NOT NULL AND NOT isnan(score))"
_BIN = ", bn AS (SELECT bin, count(s) AS n, round(avg(y::INT), 6) AS accuracy, round(avg(s), 6) AS confidence FROM (SELECT bin, bin / 10 AS lo, (bin + 1) / 10 AS hi FROM (SELECT unnest(range(0, 10)) AS bin)) LEFT JOIN (SELECT greatest(0, least(1, s)) AS s, y FROM sc) ON (s > lo OR (bin = 0 AND s = 0)) AND s <= hi GROUP BY 1)"
_PA = "WITH v AS (SELECT DISTINCT ON (score_id) * FROM verifier_scores), p AS (SELECT claim_key, round(avg(score) FILTER (verifier_name = 'minifact'), 6) AS a, round(avg(score) FILTER (verifier_name = 'alignprobe'), 6) AS b FROM v WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1), pp AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL)"
_AC = "WITH r AS (SELECT DISTINCT ON (record_id) * FROM query_records), x AS (SELECT query_id, lower(trim(final_decision)) AS p, lower(trim(gold_final_decision)) AS g FROM r), q AS (SELECT query_id, count(*) FILTER (p = g) AS good, count(*) AS n FROM x WHERE p IN ('yes', 'no', 'maybe') AND g IN ('yes', 'no', 'maybe') GROUP BY 1)"


def _boot(src: str, key: str, n_boot: int, seed: int = 7) -> str:
    return f"""(SELECT any_value(point) AS point, any_value(nc) AS n_clusters, count(v) AS n_boot, round(quantile_cont(v, 0.025), 5) AS lower, round(quantile_cont(v, 0.975), 5) AS upper, round(round(quantile_cont(v, 0.975), 5) - round(quantile_cont(v, 0.025), 5), 5) AS width FROM (
SELECT replicate, sum(good) / nullif(sum(n), 0) AS v FROM (SELECT replicate, ('0x' || substr(md5('{seed}:' || replicate || ':' || pos), 1, 8))::BIGINT % nc AS idx FROM (SELECT count(*) AS nc FROM {src}), (SELECT unnest(range(0, {n_boot})) AS replicate), LATERAL (SELECT unnest(range(0, nc)) AS pos)) JOIN (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS idx FROM {src}) USING (idx) GROUP BY 1),
(SELECT round(sum(good) / sum(n), 5) AS point, count(*) AS nc FROM {src}))"""


SQL = {
    "agg12_label_distribution": _RT + "SELECT l AS label, count(lab) AS n FROM (SELECT unnest(range(0, 4)) AS i, unnest(['CONTRADICTED', 'NOT_SUPPORTED', 'PARTIAL', 'SUPPORTED']) AS l) LEFT JOIN rt ON lab = i GROUP BY 1",
    "agg13_coincidence": _CO + "SELECT c, k, round(o, 6) AS o FROM co",
    "sc18_alpha": _CO + "SELECT * FROM al",
    "sc19_gate_g4": _CO + "SELECT n_claims, n_units, alpha_binary, alpha_binary >= 0.6 AND n_claims >= 250 AS passes FROM al, (SELECT count(DISTINCT claim_key) AS n_claims, count(DISTINCT unit_id) AS n_units FROM hl)",
    "sc8_auroc": _SC + ", rk AS (SELECT y, avg(i) OVER (PARTITION BY s) AS rank FROM (SELECT s, y, row_number() OVER (ORDER BY s) AS i FROM sc)) SELECT count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg, round((sum(rank) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auroc FROM rk",
    "sc9_ece_bins": _SC + _BIN + "SELECT * FROM bn",
    "sc9_ece": _SC + _BIN + "SELECT sum(n)::BIGINT AS n, round(sum(n * abs(accuracy - confidence)) / sum(n), 5) AS ece FROM bn",
    "sc10_sweep": _SC + ", d AS (SELECT s, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM sc GROUP BY 1), w AS (SELECT s, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM d) SELECT s AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (ap - tp)::BIGINT AS fn, (an - fp)::BIGINT AS tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(ap, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(tp + fp + ap, 0), 0), 6) AS f1 FROM w",
    "win8_spearman": _PA + ", k AS (SELECT avg(i) OVER (PARTITION BY a) AS ra, avg(j) OVER (PARTITION BY b) AS rb FROM (SELECT a, b, row_number() OVER (ORDER BY a) AS i, row_number() OVER (ORDER BY b) AS j FROM pp)) SELECT count(*) AS n, round(corr(ra, rb), 5) AS spearman FROM k",
    "sc25_separation": _SC + "SELECT count(*) FILTER (y) AS n_pos, count(*) FILTER (NOT y) AS n_neg, round(avg(s) FILTER (y) - avg(s) FILTER (NOT y), 5) AS separation FROM sc",
    "sc25_crossings": _PA + "SELECT tau, count(*) AS n, count(*) FILTER ((a >= tau) <> (b >= tau)) AS crossings FROM pp, (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS tau) GROUP BY 1",
    "sc11_bootstrap_accuracy": _AC + f"SELECT * FROM {_boot('q', 'query_id', 10_000)}",
    "sc21_design_effect": _AC + f", f AS (SELECT query_id || '#' || lpad(i::VARCHAR, 6, '0') AS u, (i <= good)::BIGINT AS good, 1::BIGINT AS n FROM (SELECT query_id, good, unnest(range(1, n + 1)) AS i FROM q)) SELECT n_units, clustered, flat, round(clustered / flat, 3) AS width_ratio, round((clustered / flat) * (clustered / flat), 3) AS design_effect, round(n_units / ((clustered / flat) * (clustered / flat)), 1) AS n_effective FROM (SELECT width AS clustered FROM {_boot('q', 'query_id', 10_000)}), (SELECT width AS flat, n_clusters AS n_units FROM {_boot('f', 'u', 10_000)})",
}
