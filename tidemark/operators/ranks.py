"""Exact places, ranks and quantiles within groups of any size: groups are cut by approximate quantiles, so that no task sorts a whole group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P = "__rk_"


def _same(by: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"{P}k{i}")) for i, c in enumerate(by)], F.lit(True))


def _cut(df: DataFrame, by: Sequence[str], order: Column, cuts: int) -> tuple[DataFrame, DataFrame]:
    """``df`` with the part of its group that a row lies in, equal values in one; and of every part its rows (n), those before it and those of the group.

    The groups should be few (folds, sources, models): each has a row of cuts.
    """
    d = df.withColumn(f"{P}v", order)
    keys = [F.col(c).alias(f"{P}k{i}") for i, c in enumerate(by)] or [F.lit(0).alias(f"{P}k0")]
    ks = [f"{P}k{i}" for i in range(len(keys))]
    # what the cuts are decides only how even the parts are
    q = d.groupBy(*keys).agg(F.percentile_approx(f"{P}v", [(i + 1) / (cuts + 1) for i in range(cuts)], 1000).alias(f"{P}q"))
    d = d.join(q, on=_same(by) if by else F.lit(0).eqNullSafe(F.col(f"{P}k0")), how="left")
    d = d.withColumn(f"{P}b", F.size(F.filter(F.coalesce(f"{P}q", F.array().cast("array<double>")), lambda v: v < F.col(f"{P}v")))).drop(f"{P}q")
    w = Window.partitionBy(*ks)
    n = d.groupBy(*ks, f"{P}b").agg(F.count("*").alias("n"))
    n = n.select(*ks, f"{P}b", "n", (F.sum("n").over(w.orderBy(f"{P}b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(w).alias("total"))
    return d, n.select(*[F.col(k).alias(f"{k}n") for k in ks], F.col(f"{P}b").alias(f"{P}bn"), F.col("n").alias(f"{P}n"), F.col("before").alias(f"{P}before"), F.col("total").alias(f"{P}total"))


def _with_parts(d: DataFrame, n: DataFrame) -> DataFrame:
    ks = [c for c in d.columns if c.startswith(f"{P}k")]
    return d.join(n, on=reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}n")) for k in ks], F.col(f"{P}b") == F.col(f"{P}bn")))


def _clean(d: DataFrame) -> DataFrame:
    return d.drop(*[c for c in d.columns if c.startswith(P)])


def placed(df: DataFrame, by: Sequence[str], order: Column | str, name: str, ties: Sequence[str] = (), cuts: int = 64) -> DataFrame:
    """``df`` with the row's place (from 1) in its group by ``order``, a number, then ``ties``; rows that tie in both come in any order.

    Scale: a group is sorted in parts of about a ``cuts``-th of it; rows of one
    order value stay together. NULL orders come first, NULL groups are groups.
    """
    order = F.col(order) if isinstance(order, str) else order
    d, n = _cut(df.drop(name), by, order.cast("double"), cuts)
    x = _with_parts(d, n)
    ks = [c for c in d.columns if c.startswith(f"{P}k")]
    w = Window.partitionBy(*ks, f"{P}b").orderBy(f"{P}v", *ties)
    return _clean(x.withColumn(name, F.row_number().over(w) + F.col(f"{P}before")))


def ranked(df: DataFrame, by: Sequence[str], column: str, name: str, cuts: int = 64) -> DataFrame:
    """``df`` with the rank of ``column`` in its group, equal values sharing the mean of their ranks; NULLs rank first, alike. Scale: as ``placed``."""
    d, n = _cut(df.drop(name), by, F.col(column).cast("double"), cuts)
    x = _with_parts(d, n)
    part = [*[c for c in d.columns if c.startswith(f"{P}k")], f"{P}b"]
    same = F.count(F.lit(1)).over(Window.partitionBy(*part, f"{P}v"))
    return _clean(x.withColumn(name, F.rank().over(Window.partitionBy(*part).orderBy(f"{P}v")) + F.col(f"{P}before") + (same - 1) / 2))


def quantiles(df: DataFrame, by: Sequence[str], column: str, fractions: Mapping[str, float], cuts: int = 64) -> DataFrame:
    """One row per group with its exact quantiles of ``column`` by name, interpolated between neighbours; NULL and NaN values left out, groups without values absent.

    Scale: only the parts of a group that hold the values looked for are
    sorted, a ``cuts``-th of it for each.
    """
    v = F.col(column).cast("double")
    d, n = _cut(df.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("__value")), by, F.col("__value"), cuts)
    place = {k: (F.col(f"{P}total") - 1) * F.lit(float(p)) for k, p in fractions.items()}
    ends = [f(h) for h in place.values() for f in (F.floor, F.ceil)]
    n = n.where(reduce(or_, [(e >= F.col(f"{P}before")) & (e < F.col(f"{P}before") + F.col(f"{P}n")) for e in ends]))
    x = _with_parts(d, n)
    ks = [c for c in d.columns if c.startswith(f"{P}k")]
    x = x.withColumn(f"{P}at", F.row_number().over(Window.partitionBy(*ks, f"{P}b").orderBy(f"{P}v")) + F.col(f"{P}before") - 1)
    low = {k: F.max(F.when(F.col(f"{P}at") == F.floor(h), F.col("__value"))) for k, h in place.items()}
    high = {k: F.max(F.when(F.col(f"{P}at") == F.ceil(h), F.col("__value"))) for k, h in place.items()}
    share = {k: F.max(h - F.floor(h)) for k, h in place.items()}
    return x.groupBy(*by).agg(*[(low[k] + (high[k] - low[k]) * share[k]).alias(k) for k in fractions])
