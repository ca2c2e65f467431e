"""Joins along time: exact date and fill, as of, inside intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

P = "__as_"


def exact_then_fill(spine: DataFrame, facts: DataFrame, *, entity: Sequence[str], date: str, columns: Sequence[str]) -> DataFrame:
    """``spine`` with ``columns`` of the facts of its own dates, each carried forward over the dates that have none.

    A fact dated where the spine has no row is lost. Facts must be one per
    entity and date (see latest_row); with no entity all rows are one series,
    which suits a spine of days, not of entities' days. NULL values are carried
    over; columns the spine has already are replaced.
    """
    f = facts.select(*entity, date, *columns)
    j = spine.drop(*[c for c in columns if c in spine.columns]).join(f, on=[*entity, date], how="left")
    w = Window.partitionBy(*entity).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*[c for c in j.columns if c not in columns], *[F.last(c, ignorenulls=True).over(w).alias(c) for c in columns])


def asof(spine: DataFrame, facts: DataFrame, *, entity: Sequence[str], date: str, fact_date: str, columns: Sequence[str], distance: str | None = None) -> DataFrame:
    """``spine`` with, column by column, the last value that isn't NULL of the facts dated on or before each row; ``distance``: days since the last fact.

    A fact on the row's own date is seen. Of facts on one date the one that is
    greatest by ``columns`` counts. Rows without entity see facts without one;
    rows without date see none. Columns the spine has already are replaced.

    Scale: values are carried on among the facts alone; then facts and rows are
    reduced to one per entity and day, so that the one sort of both holds no
    more than the calendar has days, however many rows the entity has, and
    moves one struct. Rows meet their day's values by entity and day.
    """
    out = [c for c in spine.columns if c not in columns and c != distance]
    n = [f"{P}{i}" for i in range(len(columns))]
    ks = [f"{P}k{i}" for i in range(len(entity))]
    keys = [F.col(c).alias(k) for c, k in zip(entity, ks)]
    day = lambda c: F.unix_date(F.col(c).cast("date")).alias(f"{P}d")
    # as text: a call to the driver's JVM for each column, not for each part of it
    f = facts.where(F.col(fact_date).isNotNull()).selectExpr(*[f"`{c}` AS `{k}`" for c, k in zip(entity, ks)], f"unix_date(CAST(`{fact_date}` AS DATE)) AS `{P}d`", *[f"`{c}` AS `{a}`" for c, a in zip(columns, n)])
    order = (f"PARTITION BY {', '.join(ks)} " if ks else "") + f"ORDER BY {', '.join([f'{P}d', *n])}"
    f = f.selectExpr(*ks, f"{P}d", *[f"last({c}, true) OVER ({order} ROWS UNBOUNDED PRECEDING) AS {c}" for c in n], f"lead({P}d) OVER ({order}) AS {P}next")
    f = f.where(~F.col(f"{P}d").eqNullSafe(F.col(f"{P}next"))).select(*ks, f"{P}d", F.lit(0).alias(f"{P}o"), F.struct(F.col(f"{P}d").alias("at"), *n).alias(f"{P}v"))
    s = spine.select(*keys, day(date)).where(F.col(f"{P}d").isNotNull()).distinct().withColumn(f"{P}o", F.lit(1))
    line = f.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*ks).orderBy(f"{P}d", f"{P}o").rowsBetween(Window.unboundedPreceding, 0)
    x = line.select(*ks, f"{P}d", f"{P}o", F.last(f"{P}v", ignorenulls=True).over(w).alias(f"{P}v")).where(F.col(f"{P}o") == 1)
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(entity, ks)] + [F.unix_date(F.col(date).cast("date")) == F.col(f"{P}d")]
    cols = [f"{P}v.{a} AS `{c}`" for a, c in zip(n, columns)]
    if distance:
        cols.append(f"{P}d - {P}v.at AS `{distance}`")
    return spine.select(*out).join(x, on=on, how="left").selectExpr(*[f"`{c}`" for c in out], *cols)


def with_intervals(starts: DataFrame, *, entity: Sequence[str], start: str, end: str = "end_date") -> DataFrame:
    """``starts`` with the day before the entity's next start, NULL for the last (open) interval."""
    return starts.withColumn(end, F.date_sub(F.lead(start).over(Window.partitionBy(*entity).orderBy(start)), 1))


def in_interval(rows: DataFrame, starts: DataFrame, *, entity: Sequence[str], date: str, start: str, columns: Sequence[str]) -> DataFrame:
    """Each row with ``start`` and ``columns`` of the interval that it falls into; rows before the first start are left out.

    Intervals run from one start to the day before the next, the last without
    end: so this is an as-of lookup of whole rows, one union and one sort.
    Starts must be one per entity and date.
    """
    packed = starts.select(*entity, F.col(start).alias(f"{P}s"), F.struct(start, *columns).alias(f"{P}v"))
    x = asof(rows, packed, entity=entity, date=date, fact_date=f"{P}s", columns=[f"{P}v"])
    return x.where(F.col(f"{P}v").isNotNull()).select("*", f"{P}v.*").drop(f"{P}v")


def in_ranges(rows: DataFrame, ranges: DataFrame, *, date: str, low: str, high: str, most: int = 200_000) -> DataFrame:
    """Every row with every range of days that holds its date, both ends in; ranges may overlap (folds).

    Ranges are laid out by day, so that rows meet them by equality of the date.
    The days are counted, and broadcast if there are no more than ``most``;
    else both sides are shuffled by date. NULL dates and bounds match nothing.
    Columns of the ranges that the rows have already are left out of the rows.
    """
    rows = rows.drop(*[c for c in ranges.columns if c in rows.columns])
    r = ranges.where(F.col(low) <= F.col(high))
    n = r.agg(F.sum(F.date_diff(high, low) + 1)).first()[0] or 0
    days = r.select("*", F.explode(F.sequence(F.col(low).cast("date"), F.col(high).cast("date"))).alias(f"{P}day"))
    return rows.join(F.broadcast(days) if n <= most else days, on=F.col(date).cast("date") == F.col(f"{P}day")).drop(f"{P}day")


def around(rows: DataFrame, events: DataFrame, *, entity: Sequence[str], date: str, event_date: str, columns: Sequence[str]) -> DataFrame:
    """For each event the columns of the nearest row before its date (prev_*) and of the nearest on or after it (next_*).

    Rows are one per entity and date. Two as-of lookups over one line.
    """
    e = events.select(*entity, F.col(event_date).alias(f"{P}e"))
    line = rows.select(*entity, F.unix_date(date).alias(f"{P}t"), F.lit(1).alias(f"{P}o"), F.struct(F.col(date).alias("date"), *columns).alias(f"{P}r"))
    line = line.unionByName(e.select(*entity, F.unix_date(f"{P}e").alias(f"{P}t"), F.lit(0).alias(f"{P}o"), f"{P}e"), allowMissingColumns=True)
    back = Window.partitionBy(*entity).orderBy(f"{P}t", f"{P}o").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*entity).orderBy(F.col(f"{P}t").desc(), F.col(f"{P}o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = line.select(
        *entity, f"{P}e",
        F.last(f"{P}r", ignorenulls=True).over(back).alias("prev"),
        F.last(f"{P}r", ignorenulls=True).over(ahead).alias("next"),
    ).where(F.col(f"{P}e").isNotNull())
    return x.select(*entity, F.col(f"{P}e").alias(event_date), *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("prev", "next") for c in ("date", *columns)])
