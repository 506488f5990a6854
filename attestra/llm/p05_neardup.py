"""Problem 5: chunks of different sources that say almost the same, as pairs and as groups.

Every distinct set of word triples gets a 256-bit fingerprint of one-bit
minima, whose Hamming distance measures the Jaccard distance: at similarity J
it is 128 (1 - J) on average. Vantage points partition fingerprints by Hamming
distance; a fingerprint is compared only in shards that the triangle bound
leaves open, and the survivors' sets are compared exactly.

In so many dimensions unrelated fingerprints all lie about 128 from each other,
so one tree over everything would prune nothing at the radius needed here. The
shards are therefore first split by the rare triples that two similar sets must
share (a set's rarest n - ceil(0.7 n) + 1 triples: no similar pair is lost), and
vantage points divide each such shard, however large, further.

Equal sets are one class from the beginning; only classes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import spool
from ..sources.tables import once, table

#: Words in a sequence, least similarity, and least number of sequences of a set that takes part.
WIDTH, THRESHOLD, LEAST = 3, 0.7, 40
BITS = 256
#: Standard deviations beyond the mean distance at the threshold that still count as near; a miss has a chance of about 1e-9.
SIGMAS = 6.0
RADIUS = int(BITS * (1 - THRESHOLD) / 2 + SIGMAS * np.sqrt(BITS * (1 - THRESHOLD) / 2 * (1 + THRESHOLD) / 2))
#: Cells of the table of approximate counts by which rare triples are told; its size is fixed, whatever the data.
CELLS = 1 << 20
#: Members from which a shard is divided by vantage points over the cluster, and how many points divide it.
HOT, VANTAGES = 4096, 64
#: Members of a shard that are compared at once within a task.
BLOCK = 512

_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 1 << 63, BITS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BITS, dtype=np.uint64)


def _fingerprints(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One bit of the minimum of each of BITS hash functions, packed into 64-bit words, for each set in ``flat``."""
    bits = np.empty((len(starts), BITS), dtype=np.uint8)
    with np.errstate(over="ignore"):
        for k in range(BITS):
            h = flat * _A[k] + _B[k]
            h ^= h >> np.uint64(29)
            low = np.minimum.reduceat(h, starts)
            bits[:, k] = ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64).astype(np.uint64)


def _prefix(sh: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest triples of a set, of which any similar set must hold one."""
    n = len(sh)
    size = n - int(np.ceil(THRESHOLD * n - 1e-9)) + 1
    rare = np.lexsort((sh, counts[sh & np.uint64(CELLS - 1)]))
    return sh[rare[:size]]


def sketch(classes: DataFrame, counts: np.ndarray) -> DataFrame:
    """(rep, n, f0..f3, prefix) of every class."""
    shared = classes.sparkSession.sparkContext.broadcast(counts)  # CELLS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = shared.value
        for pdf in batches:
            sets = [np.asarray(x, dtype=np.int64).view(np.uint64) for x in pdf["sh"]]
            if not sets:
                continue
            starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
            fp = _fingerprints(np.concatenate(sets), starts).view(np.int64)
            yield pd.DataFrame({"rep": pdf["rep"], "n": pdf["n"], **{f"f{i}": fp[:, i] for i in range(4)}, "prefix": [_prefix(x, table_).view(np.int64) for x in sets]})

    return classes.select("rep", "n", "sh").mapInPandas(run, "rep bigint, n int, f0 bigint, f1 bigint, f2 bigint, f3 bigint, prefix array<bigint>")


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between all rows of a and all rows of b."""
    d = np.zeros((len(a), len(b)), dtype=np.int32)
    for i in range(4):
        d += np.bitwise_count(a[:, i, None] ^ b[None, :, i])
    return d


def _near(rep: np.ndarray, n: np.ndarray, fp: np.ndarray, other: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members within RADIUS whose sizes allow the similarity.

    Shards are divided by vantage points: a member is stored with its nearest
    point, and asks only at points p with d(q, p) <= cover(p) + RADIUS.
    """
    out = []

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        for a in range(0, len(i), BLOCK):
            x = i[a : a + BLOCK]
            for b in range(0, len(j), BLOCK):
                y = j[b : b + BLOCK]
                hit = _hamming(fp[x], fp[y]) <= RADIUS
                small, big = np.minimum(n[x][:, None], n[y][None, :]), np.maximum(n[x][:, None], n[y][None, :])
                hit &= (small >= THRESHOLD * big - 1e-9) & (rep[x][:, None] < rep[y][None, :])
                if other is not None:
                    hit &= other[x][:, None] | other[y][None, :]
                u, v = np.nonzero(hit)
                if len(u):
                    out.append((rep[x[u]], rep[y[v]]))

    m = len(rep)
    every = np.arange(m)
    if m <= BLOCK:
        compare(every, every)
        return out
    points = np.linspace(0, m - 1, int(np.sqrt(m)) // 2 + 2).astype(int)
    d = np.vstack([_hamming(fp[a : a + BLOCK], fp[points]) for a in range(0, m, BLOCK)])
    home = d.argmin(1)
    for p in range(len(points)):
        stored = every[home == p]
        if len(stored):
            asking = every[d[:, p] <= d[stored, p].max() + RADIUS]
            compare(asking, stored)
            compare(stored, asking)
    return out


def _candidates_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare the members of each shard; rows come sorted by shard, so one shard is held at a time."""

    def pairs(df: pd.DataFrame) -> pd.DataFrame:
        key = df["shard"].to_numpy()
        rep, n = df["rep"].to_numpy(), df["n"].to_numpy()
        fp = df[["f0", "f1", "f2", "f3"]].to_numpy(dtype=np.int64).view(np.uint64)
        stored = df["stored"].to_numpy(dtype=bool)
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        sizes = np.diff(cuts)
        out = []
        two = cuts[:-1][sizes == 2]
        if len(two):  # most shards hold two members: all at once
            d = np.bitwise_count(fp[two] ^ fp[two + 1]).sum(1)
            ok = (d <= RADIUS) & (np.minimum(n[two], n[two + 1]) >= THRESHOLD * np.maximum(n[two], n[two + 1]) - 1e-9) & (rep[two] != rep[two + 1]) & (stored[two] | stored[two + 1])
            a, b = rep[two[ok]], rep[two[ok] + 1]
            out.append((np.minimum(a, b), np.maximum(a, b)))
        for at, size in zip(cuts[:-1][sizes > 2], sizes[sizes > 2]):
            s = slice(at, at + size)
            out.extend(_near(rep[s], n[s], fp[s], None if stored[s].all() else stored[s]))
        if not out:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])}).drop_duplicates()

    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        if pdf.empty:
            continue
        held.append(pdf)
        rows += len(pdf)
        if rows >= 20_000 and held[0]["shard"].iloc[0] != pdf["shard"].iloc[-1]:
            df = pd.concat(held, ignore_index=True)
            open_ = df["shard"].to_numpy() == df["shard"].iloc[-1]
            yield pairs(df[~open_].reset_index(drop=True))
            held = [df[open_].reset_index(drop=True)]
            rows = len(held[0])
    if held:
        yield pairs(pd.concat(held, ignore_index=True))


def _divide(posts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Shards of up to HOT members as they are; larger ones divided by vantage points.

    A member is stored in the shard of its nearest point and sent, to ask, to
    every shard whose cover the triangle bound does not rule out.
    """
    fp = ["f0", "f1", "f2", "f3"]
    kept = ["rep", "n", *fp]
    cold = posts.join(sizes.where(F.col("size") <= HOT).select("key"), "key").select(F.xxhash64("key").alias("shard"), *kept, F.lit(True).alias("stored"))
    hot = spool(posts.join(sizes.where(F.col("size") > HOT).select("key"), "key"), "hot")
    slot = F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(VANTAGES)).cast("int")
    point = hot.groupBy("key", slot.alias("point")).agg(F.min_by(F.struct(*fp), F.xxhash64("rep", F.lit(11))).alias("p"))
    points = point.groupBy("key").agg(F.collect_list(F.struct("point", "p")).alias("points"))  # at most VANTAGES each
    far = hot.join(points, "key").select("key", *kept, F.transform("points", lambda x: F.struct(sum((F.bit_count(F.col(f).bitwiseXOR(x["p"][f])) for f in fp), F.lit(0)).alias("d"), x["point"].alias("point"))).alias("ds"))
    far = spool(far.withColumn("home", F.array_min("ds")), "far")
    cover = far.groupBy("key", F.col("home.point").alias("point")).agg(F.max("home.d").alias("cover")).select(F.col("key").alias("ck"), F.col("point").alias("cp"), "cover")
    ask = far.select("key", *kept, "home", F.explode("ds").alias("x")).select("key", *kept, F.col("home.point").alias("own"), F.col("x.d").alias("d"), F.col("x.point").alias("xp"))
    ask = ask.join(cover, (F.col("key") == F.col("ck")) & (F.col("xp") == F.col("cp"))).where(F.col("d") <= F.col("cover") + RADIUS)
    ask = ask.select(F.xxhash64("key", "cp").alias("shard"), *kept, (F.col("own") == F.col("cp")).alias("stored"))
    return cold.unionByName(ask)


def similar_classes(classes: DataFrame) -> DataFrame:
    """(a, b, jaccard): pairs a < b of classes at or above THRESHOLD. ``classes`` has rep, n, sh, one row each."""
    cells = classes.select(F.explode("sh").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).count()
    counts = np.zeros(CELLS, dtype=np.int64)
    got = cells.toPandas()  # at most CELLS rows
    counts[got["cell"].to_numpy(dtype=np.int64)] = got["count"].to_numpy()
    posts = spool(sketch(classes, counts).select(F.explode("prefix").alias("key"), "rep", "n", "f0", "f1", "f2", "f3"), "postings")
    sizes = spool(posts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shards")
    hot = sizes.where(F.col("size") > HOT).limit(1).count()
    if hot:
        shards = _divide(posts, sizes)
    else:
        shards = posts.join(sizes.select("key"), "key").select(F.col("key").alias("shard"), "rep", "n", "f0", "f1", "f2", "f3", F.lit(True).alias("stored"))
    placed = shards.repartition("shard").sortWithinPartitions("shard")
    near = spool(placed.mapInPandas(_candidates_in, "a bigint, b bigint").distinct(), "near")
    left = classes.select(F.col("rep").alias("a"), F.col("sh").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("rep").alias("b"), F.col("sh").alias("sb"), F.col("n").alias("nb"))
    both = near.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") >= THRESHOLD - 1e-12)


def classes_of(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): one row rep, n, sh per distinct set; chunk_id, source_id, rep of every chunk that takes part."""
    rows = once(chunks.select("chunk_id", "source_id", "text"), "chunk_id")
    sets = spool(shingle_sets(rows), "sets")
    first = sets.groupBy("h1", "h2").agg(F.min("chunk_id").alias("rep"))
    members = spool(sets.select("chunk_id", "source_id", "h1", "h2").join(first, ["h1", "h2"]).select("chunk_id", "source_id", "rep"), "members")
    classes = sets.join(first.select(F.col("rep").alias("chunk_id")), "chunk_id").select(F.col("chunk_id").alias("rep"), "n", "sh")
    return spool(classes, "classes"), members


def shingle_sets(rows: DataFrame) -> DataFrame:
    """The distinct hashed word sequences of every text that has at least LEAST of them, with two hashes of the set."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    w = rows.select("chunk_id", "source_id", words.alias("w")).where(F.size("w") >= LEAST + WIDTH - 1)
    seq = F.transform(F.sequence(F.lit(0), F.size("w") - WIDTH), lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(WIDTH)]))
    sets = w.select("chunk_id", "source_id", F.array_sort(F.array_distinct(seq)).alias("sh"))
    key = F.md5(F.to_binary(F.array_join("sh", ","), F.lit("utf-8")))
    return sets.withColumns({"n": F.size("sh"), "h1": F.xxhash64("sh"), "h2": key}).where(F.col("n") >= LEAST)


def found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks of different sources at or above the threshold.

    Pairs of classes are spread over their members, and the members of one
    class pair with each other, as the definition of the result asks. A null
    text takes no part; a null source counts as a source of its own name.
    """
    classes, members = classes_of(table(spark, d, "chunks"))
    pairs = similar_classes(classes).select("a", "b")
    src = lambda c: F.coalesce(F.col(c), F.lit(""))
    x = members.select(F.col("chunk_id").alias("ca"), F.col("source_id").alias("sa"), F.col("rep").alias("a"))
    y = members.select(F.col("chunk_id").alias("cb"), F.col("source_id").alias("sb"), F.col("rep").alias("b"))
    across = pairs.join(x, "a").join(y, "b")
    several = members.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("rep")
    within = x.join(several, x["a"] == several["rep"]).join(y, F.col("a") == F.col("b")).where("ca < cb")
    both = across.select("ca", "sa", "cb", "sb").unionByName(within.select("ca", "sa", "cb", "sb")).where(src("sa") != src("sb"))
    return both.select(F.least("ca", "cb").alias("chunk_id_a"), F.greatest("ca", "cb").alias("chunk_id_b"))


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, group): connected components as the smallest node of each, by spreading minima and jumping along them."""
    edges = spool(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    label = spool(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("g")), "labels")
    while True:
        near = edges.join(label.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("ng"))
        step = label.join(near, "u").select("u", "g", F.least("g", "ng").alias("h"))
        jump = step.join(label.select(F.col("u").alias("h"), F.col("g").alias("hg")), "h", "left")
        new = spool(jump.select("u", F.least("h", F.coalesce("hg", "h")).alias("g"), (F.least("h", F.coalesce("hg", "h")) != F.col("g")).alias("changed")), "labels")
        label = new.select("u", "g")
        if not new.where("changed").limit(1).count():
            break
    return nodes.join(label.withColumnRenamed("u", "rep"), "rep", "left").select("rep", F.coalesce("g", "rep").alias("group_id"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk that takes part, with its class of equal sets, its group of near-duplicates, and the links of its class to other classes."""
    classes, members = classes_of(table(spark, d, "chunks"))
    pairs = spool(similar_classes(classes).select("a", "b"), "pairs")
    group = components(pairs, classes.select("rep"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(group, "rep").join(links, "rep", "left").select("chunk_id", F.col("rep").alias("class_id"), "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p5_found": found, "p5_groups": groups}
SQL: dict[str, str] = {}
