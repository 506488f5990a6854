"""Percentiles of very large columns by deterministic buffer collapsing.

A sketch holds sorted buffers of ``k`` values. A buffer at level L stands for
values of weight 2**L. Two buffers of one level collapse into one of the next:
merge, then keep every second position, starting at the first and at the second
position in turn. One collapse at level L moves no rank by more than 2**L, so
the sum of these amounts is a proven bound on the rank error of any answer; it
travels with the sketch. Sketches made on separate partitions, days or runs
merge by the same rule, in a tree, so the bound grows with the depth of the
tree and not with the number of parts.

Groups of at most ``k`` values are answered exactly (bound 0).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values per buffer. The relative rank error is about log2(n / K) / (2 K).
K = 2048
#: A partition writes its sketches out and starts anew when it holds this many values, whatever the number of groups.
HELD_VALUES = 4_000_000
#: Partial sketches merged by one task in the first round of the tree.
FAN_IN = 64

SKETCH = [
    T.StructField("lvls", T.ArrayType(T.IntegerType())),
    T.StructField("lens", T.ArrayType(T.IntegerType())),
    T.StructField("vals", T.ArrayType(T.DoubleType())),
    T.StructField("n", T.LongType()),
    T.StructField("rank_err", T.DoubleType()),
    T.StructField("vmin", T.DoubleType()),
    T.StructField("vmax", T.DoubleType()),
]


class Buffers:
    """The buffers of one group."""

    __slots__ = ("k", "full", "loose", "n_loose", "n", "err", "lo", "hi", "turn")

    def __init__(self, k: int = K):
        self.k, self.full, self.loose, self.n_loose = k, {}, [], 0
        self.n, self.err, self.lo, self.hi, self.turn = 0, 0.0, np.inf, -np.inf, {}

    def held(self) -> int:
        return self.n_loose + self.k * len(self.full)

    def add(self, values: np.ndarray) -> None:
        """Take values of weight one, without NaN."""
        if not len(values):
            return
        self.n += len(values)
        self.lo, self.hi = min(self.lo, values.min()), max(self.hi, values.max())
        self._take(values)

    def _take(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.n_loose += len(values)
        if self.n_loose >= self.k:
            every = np.concatenate(self.loose)
            whole = len(every) // self.k * self.k
            for part in every[:whole].reshape(-1, self.k):
                self._push(0, np.sort(part))
            self.loose, self.n_loose = [every[whole:]], len(every) - whole

    def _push(self, level: int, buffer: np.ndarray) -> None:
        while level in self.full:
            both = np.concatenate([self.full.pop(level), buffer])
            both.sort(kind="stable")
            start = self.turn.get(level, 0)
            self.turn[level] = 1 - start
            buffer = both[start::2]
            self.err += 2.0**level
            level += 1
        self.full[level] = buffer

    def merge(self, row) -> None:
        """Take another sketch, given as a row of it."""
        self.n += int(row.n)
        self.err += float(row.rank_err)
        if row.n:
            self.lo, self.hi = min(self.lo, row.vmin), max(self.hi, row.vmax)
        vals, at = np.asarray(row.vals, dtype=float), 0
        for level, size in zip(row.lvls, row.lens):
            part = vals[at : at + size]
            at += size
            if level < 0:
                self._take(part)
            else:
                self._push(int(level), part)

    def row(self) -> tuple:
        parts = [(-1, np.concatenate(self.loose) if self.loose else np.empty(0))] + sorted(self.full.items())
        return (
            [int(p[0]) for p in parts],
            [len(p[1]) for p in parts],
            np.concatenate([p[1] for p in parts]),
            self.n,
            self.err,
            float(self.lo) if self.n else None,
            float(self.hi) if self.n else None,
        )


def read_quantiles(row, quantiles: Sequence[float]) -> list[tuple[float, float, float]]:
    """(estimate, lower, upper) of each quantile; the true one lies within the bounds.

    The estimate interpolates linearly at ``(n - 1) * q``.
    """
    vals = np.asarray(row.vals, dtype=float)
    if not len(vals):
        return [(None, None, None)] * len(quantiles)
    weights = np.concatenate([np.full(s, 2.0 ** max(lv, 0)) for lv, s in zip(row.lvls, row.lens)])
    order = np.argsort(vals, kind="stable")
    vals, ranks = vals[order], np.cumsum(weights[order])

    def at(rank: float, beyond: float) -> float:
        if rank <= 0:
            return float(row.vmin)
        i = int(np.searchsorted(ranks, rank - 1e-9))
        return float(vals[i]) if i < len(vals) else beyond

    out = []
    for q in quantiles:
        h = (row.n - 1) * q
        low, high = int(np.floor(h)) + 1, int(np.ceil(h)) + 1
        a, b = at(low, row.vmax), at(high, row.vmax)
        est = a + (b - a) * (h - (low - 1))
        e = row.rank_err
        out.append((est, est, est) if e == 0 else (est, at(low - e, row.vmax), at(high + e, row.vmax)))
    return out


def _schema(df: DataFrame, keys: Sequence[str], *more: T.StructField) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + list(more) + SKETCH)


def sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """One mergeable sketch per group of ``keys`` over the usable numbers of ``value``.

    Null, NaN and infinite values are left out. A null key is a group of its
    own. An empty table gives no rows. Only sketches are shuffled, never values,
    so a group that holds a third of all rows costs no more than any other.
    """
    keys = list(keys)
    src = df.select(*keys, F.col(value).cast("double").alias("__v"))
    src = src.where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < F.lit(float("inf"))))
    names = keys + ["part_no"] + [f.name for f in SKETCH]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, Buffers] = {}
        held = serial = 0

        def out() -> pd.DataFrame:
            return pd.DataFrame([(*g, serial, *b.row()) for g, b in state.items()], columns=names)

        for pdf in batches:
            values = pdf["__v"].to_numpy(dtype=float)
            codes, groups = pd.factorize(pd.MultiIndex.from_frame(pdf[keys].astype(object)), use_na_sentinel=False)
            order = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[order], np.arange(len(groups) + 1))
            for i, g in enumerate(groups):
                g = tuple(None if x is None or x is pd.NaT or x != x else x for x in g)
                b = state.get(g)
                if b is None:
                    b = state[g] = Buffers(k)
                held -= b.held()
                b.add(values[order[cuts[i] : cuts[i + 1]]])
                held += b.held()
            if held > HELD_VALUES:
                yield out()
                state, held, serial = {}, 0, serial + 1
        if state:
            yield out()

    parts = src.mapInPandas(fold, _schema(src, keys, T.StructField("part_no", T.IntegerType())))
    parts = parts.withColumn("part_no", (F.spark_partition_id() + F.col("part_no") * 7919) % FAN_IN)
    return merge_sketches(merge_sketches(parts, [*keys, "part_no"], k), keys, k)


def merge_sketches(df: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """Combine sketches over all rows of each group of ``keys``, e.g. days into weeks or runs into systems."""
    keys = list(keys)
    fields = [f.name for f in SKETCH]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by group: one group is open at a time, whatever the number of groups
        group, b, done = None, None, []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                g = tuple(None if x is None or x is pd.NaT or x != x else x for x in (getattr(r, c) for c in keys))
                if b is None or g != group:
                    if b is not None:
                        done.append((*group, *b.row()))
                    group, b = g, Buffers(k)
                b.merge(r)
            if len(done) >= 256:
                yield pd.DataFrame(done, columns=keys + fields)
                done = []
        if b is not None:
            done.append((*group, *b.row()))
        yield pd.DataFrame(done, columns=keys + fields)

    placed = df.select(*keys, *fields).repartition(*keys).sortWithinPartitions(*keys, "n", "vmin", "vmax")
    return placed.mapInPandas(join, _schema(df, keys))


def percentiles(sketched: DataFrame, keys: Sequence[str], named: dict[str, float]) -> DataFrame:
    """Read percentiles from sketches: for each name its estimate, ``_lo`` and ``_hi`` bounds, with n and rank_err."""
    keys = list(keys)
    cols = [T.StructField(f"{c}{s}", T.DoubleType()) for c in named for s in ("", "_lo", "_hi")]
    head = [T.StructField("n", T.LongType()), T.StructField("rank_err", T.DoubleType())]
    schema = T.StructType([sketched.schema[k] for k in keys] + head + cols)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (*(getattr(r, k) for k in keys), r.n, r.rank_err, *(x for t in read_quantiles(r, list(named.values())) for x in t))
                for r in pdf.itertuples(index=False)
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    return sketched.select(*keys, *[f.name for f in SKETCH]).mapInPandas(read, schema)
