"""Attributes as they were known at an event's time, from persistent search trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

P = "__ka_"


class Tree:
    """A persistent search tree: every insertion copies the path it touches, so that each earlier root still holds.

    A treap: priorities come from a hash of the key, which keeps the depth
    logarithmic whatever the order of insertion. Nodes live in flat lists; node
    0 is the empty tree. roots[i] is the tree once the first i known-times are in.
    """

    def __init__(self) -> None:
        self.key, self.val, self.left, self.right, self.pri = [0], [0], [0], [0], [0]
        self.known: list[int] = []
        self.roots: list[int] = [0]

    def _node(self, key: int, val: int, left: int, right: int) -> int:
        self.key.append(key), self.val.append(val), self.left.append(left), self.right.append(right)
        self.pri.append((key * 0x9E3779B97F4A7C15 ^ (key >> 7) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFF)
        return len(self.key) - 1

    def insert(self, known: int, key: int, val: int) -> None:
        """key now has val; known must not fall from one call to the next."""
        root = self.roots[-1]
        path, at = [], root
        while at and self.key[at] != key:
            path.append(at)
            at = self.left[at] if key < self.key[at] else self.right[at]
        new = self._node(key, val, self.left[at], self.right[at])  # of the empty node both are 0
        for p in reversed(path):
            up = self.pri[new] > self.pri[p]  # then new turns over the copy of its parent
            if key < self.key[p]:
                copy = self._node(self.key[p], self.val[p], self.right[new] if up else new, self.right[p])
                if up:
                    self.right[new] = copy
            else:
                copy = self._node(self.key[p], self.val[p], self.left[p], self.left[new] if up else new)
                if up:
                    self.left[new] = copy
            new = new if up else copy
        if self.known and self.known[-1] == known:
            self.roots[-1] = new
        else:
            self.known.append(known)
            self.roots.append(new)

    def search(self, known: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """For each pair the val of the greatest key <= valid in the tree as known at that time; -1 where there is none."""
        key, val, left, right = (np.asarray(x, dtype=np.int64) for x in (self.key, self.val, self.left, self.right))
        at = np.asarray(self.roots, dtype=np.int64)[np.searchsorted(np.asarray(self.known, dtype=np.int64), known, side="right")]
        best = np.full(len(at), -1, dtype=np.int64)
        while at.any():
            ok = (at > 0) & (key[at] <= valid)
            best[ok] = val[at[ok]]
            at = np.where(ok, right[at], left[at])
        return best


def known_at(
    events: DataFrame,
    facts: DataFrame,
    *,
    entity: str,
    event_time: str,
    known_time: str,
    valid_time: str,
    order: str,
    columns: Sequence[str],
    keep: Sequence[str],
    rows_per_task: int = 200_000,
) -> DataFrame:
    """``keep`` of every event with, for each of ``columns`` c, c_known: the value of the fact with the latest valid_time <= event_time among those known by then.

    Of facts on one valid_time the one known last holds, among these the one
    with the greatest ``order``. Each column has a tree of its own, into which
    NULL and NaN values are not put: they fall back to the fact before.
    event_time, known_time and valid_time are DATEs, columns numeric (DOUBLE
    comes out); entity, event_time must not be in keep twice.

    Scale: the facts of an entity meet its events in one task, the events of a
    large entity in several: each entity's events are counted and dealt out to
    as many tasks as hold ``rows_per_task`` each, its facts copied to each of
    them. Every event is shuffled once, with no columns but ``keep`` and the time.

    Nulls: facts without entity or times are left out; events without entity
    or time come out with NULLs, as do those of an entity without facts.
    Repeated events come out each, repeated facts change nothing. A column of
    keep that bears an output's name is dropped.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    keep = [c for c in keep if c not in {f"{x}_known" for x in columns}]
    ev = events.select(*[F.col(c).alias(f"{P}e{i}") for i, c in enumerate(keep)], F.col(entity).alias(f"{P}k"), day(event_time).alias(f"{P}t"))
    size = ev.groupBy(f"{P}k").agg(F.ceil(F.count("*") / F.lit(rows_per_task)).cast("int").alias(f"{P}n"))
    size = size.select(F.col(f"{P}k").alias(f"{P}k2"), f"{P}n")
    # entities are few beside events; where they are not, this is a common shuffled join
    ev = ev.join(size, on=F.col(f"{P}k").eqNullSafe(F.col(f"{P}k2")), how="left").drop(f"{P}k2")
    ev = ev.withColumn(f"{P}s", F.pmod(F.xxhash64(*[c for c in ev.columns if c.startswith(f"{P}e")], f"{P}t"), F.col(f"{P}n")).cast("int")).drop(f"{P}n")
    f = facts.select(F.col(entity).alias(f"{P}k"), day(known_time).alias("known"), day(valid_time).alias("valid"), F.col(order).cast("double").alias("o"), *[F.col(c).cast("double").alias(f"{P}c{i}") for i, c in enumerate(columns)])
    f = f.where(F.col(f"{P}k").isNotNull() & F.col("known").isNotNull() & F.col("valid").isNotNull()).distinct()
    f = f.join(size.withColumnRenamed(f"{P}k2", f"{P}k"), on=f"{P}k").withColumn(f"{P}s", F.explode(F.sequence(F.lit(0), F.col(f"{P}n") - 1))).drop(f"{P}n")
    n = len(columns)
    payload = [c for c in ev.columns if c.startswith(f"{P}e")]
    schema = ", ".join([*[f"`{c}` {ev.schema[c].dataType.simpleString()}" for c in payload], *[f"`{P}o{i}` double" for i in range(n)]])

    def one(e: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        out = e[payload].copy()
        t = e[f"{P}t"].to_numpy(dtype="float64", na_value=np.nan)
        has = ~np.isnan(t)
        facts = facts.sort_values(["known", "o", *[f"{P}c{i}" for i in range(n)]], kind="stable")
        known, valid = facts["known"].to_numpy(dtype=np.int64), facts["valid"].to_numpy(dtype=np.int64)
        for i in range(n):
            v = facts[f"{P}c{i}"].to_numpy(dtype="float64", na_value=np.nan)
            tree = Tree()
            for j in np.flatnonzero(~np.isnan(v)):
                tree.insert(int(known[j]), int(valid[j]), int(j))
            got = np.full(len(e), np.nan)
            if has.any() and len(tree.known):
                d = t[has].astype(np.int64)
                hit = tree.search(d, d)
                got[has] = np.where(hit >= 0, v[np.maximum(hit, 0)], np.nan)
            out[f"{P}o{i}"] = got
        return out

    by = [f"{P}k", f"{P}s"]
    x = ev.groupBy(*by).cogroup(f.groupBy(*by)).applyInPandas(one, schema)
    nan = lambda c: F.when(~F.isnan(c), c)
    return x.select(*[F.col(f"{P}e{i}").alias(c) for i, c in enumerate(keep)], *[nan(F.col(f"{P}o{i}")).alias(f"{c}_known") for i, c in enumerate(columns)])
