"""Rolling totals over trailing calendar periods from prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

P = "__tr_"


def clean_key(c: Column) -> Column:
    """A key with case and outer blanks aside."""
    return F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def latest_per(df: DataFrame, key: str, order: str, *keep: str) -> DataFrame:
    """One row per ``key``: the one that is greatest by ``order``, then by ``keep`` (so ties are settled alike on every run)."""
    x = df.groupBy(key).agg(F.max(F.struct(order, *keep)).alias("m"))
    return x.select(key, *[F.col(f"m.{c}").alias(c) for c in (order, *keep)])


def trailing(
    events: DataFrame,
    points: DataFrame,
    *,
    entity: str,
    date: str,
    value: str,
    periods: Sequence[int] = (7, 30),
) -> DataFrame:
    """One row per distinct (entity, date) of ``points``; for each period k the count_k, sum_k and mean_k of the events dated in [date - k, date].

    Both ends are included; mean_k is 0.0 where there are none. Prefix sums of
    count and value run along each entity's days, carried over days without
    events to every window end that a point asks for; a total is the prefix at
    the point's date less the one before its window begins.

    Scale: events are reduced to one row per entity and day before anything is
    sorted, points to distinct days, so that no entity has more than a few rows
    for each day of the calendar, however many events it has.

    Nulls: events without entity, date or value count nowhere, NaN values
    neither; infinite ones count, apart from the finite, and make sum and mean
    infinite (NaN where both signs meet). Points without entity or date get
    count 0, sum 0.0, mean 0.0. Repeated points give one row, repeated events
    count each. Without events every total is 0.
    """
    inf = float("inf")
    e = events.select(F.col(entity).alias("k"), F.unix_date(F.col(date).cast("date")).alias("d"), F.col(value).cast("double").alias("v"))
    e = e.where(F.col("k").isNotNull() & F.col("d").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    fin = F.abs("v") != inf
    daily = e.groupBy("k", "d").agg(
        F.count("*").alias("n"),
        F.sum(F.when(fin, F.col("v")).otherwise(0.0)).alias("s"),
        F.sum((F.col("v") == inf).cast("long")).alias("up"),
        F.sum((F.col("v") == -inf).cast("long")).alias("dn"),
    )
    pts = points.select(F.col(entity).alias("k"), F.unix_date(F.col(date).cast("date")).alias("p")).distinct()
    ends = [0, *[k + 1 for k in periods]]
    zero = [F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("up"), F.lit(0).cast("long").alias("dn")]
    probes = pts.select("k", F.explode(F.array(*[F.struct((F.col("p") - b).alias("d"), F.lit(b).alias("back")) for b in ends])).alias("x"), "p")
    probes = probes.select("k", F.col("x.d").alias("d"), F.col("x.back").alias("back"), "p", *zero)
    line = daily.select("k", "d", F.lit(-1).alias("back"), F.lit(None).cast("int").alias("p"), "n", "s", "up", "dn").unionByName(probes)
    w = Window.partitionBy("k").orderBy("d", "back").rowsBetween(Window.unboundedPreceding, 0)  # a day's events (-1) before its probes
    pre = line.select("k", "p", "back", *[F.sum(c).over(w).alias(c) for c in ("n", "s", "up", "dn")]).where(F.col("back") >= 0)
    got = pre.groupBy("k", "p").agg(*[F.max(F.when(F.col("back") == b, F.col(c))).alias(f"{c}{b}") for b in ends for c in ("n", "s", "up", "dn")])
    out = [F.col("k").alias(entity), F.date_from_unix_date("p").alias(date)]
    for k in periods:
        diff = {c: F.coalesce(F.col(f"{c}0") - F.col(f"{c}{k + 1}"), F.lit(0)) for c in ("n", "up", "dn")}
        some = F.col("k").isNotNull() & F.col("p").isNotNull()
        n = F.when(some, diff["n"]).otherwise(0)
        s = F.when((diff["up"] > 0) & (diff["dn"] > 0), F.lit(float("nan"))).when(diff["up"] > 0, inf).when(diff["dn"] > 0, -inf)
        s = F.when(n == 0, 0.0).otherwise(s.otherwise(F.col("s0") - F.col(f"s{k + 1}")))
        out += [n.cast("long").alias(f"count_{k}"), s.alias(f"sum_{k}"), F.when(n == 0, 0.0).otherwise(s / F.greatest(n, F.lit(1))).alias(f"mean_{k}")]
    return got.select(*out)


def windows_of_rows(
    rows: DataFrame,
    totals: DataFrame,
    *,
    entity: str,
    date: str,
) -> DataFrame:
    """``rows`` with the totals of their (entity, date); NULL keys meet NULL keys."""
    t = totals.select(F.col(entity).alias(f"{P}k"), F.col(date).alias(f"{P}d"), *[c for c in totals.columns if c not in (entity, date)])
    clash = [c for c in t.columns if c in rows.columns]
    j = rows.drop(*clash).join(t, on=F.col(entity).eqNullSafe(F.col(f"{P}k")) & F.col(date).eqNullSafe(F.col(f"{P}d")), how="left")
    return j.drop(f"{P}k", f"{P}d")
