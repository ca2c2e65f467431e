"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regrid(
    readings: DataFrame,
    bounds: DataFrame,
    *,
    entity: str,
    time: str,
    value: str,
    order: str,
    first: str = "first_cell",
    last: str = "last_cell",
    kind: str = "counter",
    max_gap: float | None = None,
    own: str | None = None,
) -> DataFrame:
    """A regular series: one row per entity and grid cell from its first to its last.

    ``time`` is a DOUBLE counted in cells: cell c spans [c, c + 1). ``bounds``
    names each entity's first and last cell (BIGINT, one row an entity; more
    are merged). Columns out: entity, cell, value, n_readings, covered, marked.

    kind "counter": ``value`` is a running count. Consecutive readings are
    differenced; a fall is a reset, after which the count began at zero. Each
    increment is shared out over the cells that its interval overlaps, in
    proportion to the overlap. ``value`` is the cell's increment; ``covered``
    the part of the cell between first and last reading.

    kind "level": the reading holds until the next one, the last one to the end
    of the grid. Levels are first made a counter, the running integral of the
    level over time as it stands at each reading and at the end; its readings
    are differenced and shared out in the same way (a fall is no reset here: a
    level may be negative). ``value`` is then the increment over the covered
    part of the cell, its mean level, exact but for the rounding of sums (about
    1e-12 of the integral).

    ``own``: a BOOLEAN column, false for readings that hold from ``time`` on but
    aren't readings of the cell that begins there; of several at one time the
    one with the greatest ``order`` holds.

    ``marked`` is true where no reading of its own falls into the cell, or, with
    max_gap, where all of the cell lies between readings further apart than
    that: the value is then an estimate, or NULL where nothing covers the cell.

    Scale: a reading makes one interval, an interval as many rows as it has
    cells, which the grid has anyway. The sort is within an entity and holds
    its readings only; reduce repeated readings of a cell beforehand.

    Nulls: readings without entity, time or value are left out; a NULL ``own``
    is false. Of readings at one time the one with the greatest ``order`` comes
    last: it counts for "level", all of them in order for "counter". Entities without a reading get
    their cells with value NULL; entities without bounds get none. Readings
    outside the bounds still cover the cells inside.
    """
    if kind not in ("counter", "level"):
        raise ValueError(f"kind is {kind}")
    b = bounds.groupBy(F.col(entity).alias("k")).agg(F.min(first).cast("long").alias("a"), F.max(last).cast("long").alias("z"))
    b = b.where(F.col("k").isNotNull() & F.col("a").isNotNull() & F.col("z").isNotNull())
    mine = F.lit(True) if own is None else F.coalesce(F.col(own), F.lit(False))
    r = readings.select(F.col(entity).alias("k"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v"), F.col(order).alias("o"), mine.alias("own"))
    r = r.where(F.col("k").isNotNull() & F.col("t").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    # a mark at the start of each entity makes the intervals tile the whole of it
    none = r.schema["o"].dataType
    marks = b.select("k", F.lit(float("-inf")).alias("t"), F.lit(None).cast("double").alias("v"), F.lit(None).cast(none).alias("o"), F.lit(False).alias("own"), "a", "z")
    line = r.select("*", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("z")).unionByName(marks)
    w = Window.partitionBy("k").orderBy("t", "o")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = line.select("k", "t", "v", "own", F.lead("t").over(w).alias("u"), F.max("a").over(whole).alias("a"), F.max("z").over(whole).alias("z"), "o").where(F.col("a").isNotNull())
    if kind == "level":
        # the counter: what the level has made since the first reading; the last level runs to the end of the grid
        x = x.withColumn("u", F.coalesce("u", F.greatest(F.col("z") + F.lit(1.0), F.col("t"))))
        made = F.when(F.col("v").isNotNull(), F.col("v") * (F.col("u") - F.col("t")))
        x = x.withColumn("nv", F.sum(made).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        x = x.withColumn("v", F.when(F.col("v").isNotNull(), F.coalesce(F.lag("nv").over(w), F.lit(0.0))))
        inc = F.col("nv") - F.col("v")
    else:
        x = x.withColumn("nv", F.lead("v").over(w))
        inc = F.when(F.col("nv") < F.col("v"), F.col("nv")).otherwise(F.col("nv") - F.col("v"))
    length = F.col("u") - F.col("t")
    rate = F.when(F.col("v").isNotNull() & (length > 0), inc / length)
    x = x.select("k", "t", "own", "a", "z", F.coalesce("u", F.lit(float("inf"))).alias("u"), rate.alias("rate"), length.alias("gap"))
    lo = F.greatest(F.col("a").cast("double"), F.floor("t").cast("double"))
    hi = F.least(F.col("z").cast("double"), F.ceil("u").cast("double") - 1)
    at_point = F.col("t") == F.col("u")  # no length; kept so that the reading is counted
    x = x.select("*", lo.alias("lo"), F.when(at_point, F.floor("t").cast("double")).otherwise(hi).alias("hi"))
    x = x.where((F.col("lo") <= F.col("hi")) & (F.col("hi") <= F.col("z")))
    cells = x.select("*", F.explode(F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long"))).alias("cell"))
    start, end = F.col("cell").cast("double"), F.col("cell") + 1.0
    over = F.greatest(F.lit(0.0), F.least(F.col("u"), end) - F.greatest(F.col("t"), start))
    wide = F.lit(False) if max_gap is None else F.coalesce(F.col("gap") > max_gap, F.lit(False))
    cells = cells.select(
        F.col("k"), "cell",
        (F.col("own") & (F.col("t") >= start) & (F.col("t") < end)).cast("long").alias("here"),
        F.when(F.col("rate").isNotNull() & (over > 0), over).alias("over"),
        F.when(F.col("rate").isNotNull() & (over > 0), over * F.col("rate")).alias("inc"),
        F.when(wide, 0.0).otherwise(over).alias("close"),
    )
    g = cells.groupBy("k", "cell").agg(F.sum("here").alias("n"), F.sum("over").alias("over"), F.sum("inc").alias("inc"), F.sum("close").alias("close"))
    value_out = F.col("inc") if kind == "counter" else F.col("inc") / F.col("over")
    return g.select(
        F.col("k").alias(entity),
        "cell",
        F.when(F.col("over") > 0, value_out).alias("value"),
        F.col("n").alias("n_readings"),
        F.coalesce(F.col("over"), F.lit(0.0)).alias("covered"),
        ((F.col("n") == 0) | (F.coalesce(F.col("over"), F.lit(0.0)) > 0) & (F.col("close") <= 0)).alias("marked"),
    )


def calendar_cells(calendar: DataFrame, day: str, is_open: str) -> DataFrame:
    """day, cell, is_open of every calendar day: open days are numbered from 0 in order; a closed day has the number of the next open one.

    A calendar has a row a day, so that one sort of it is small. Days listed
    twice count once (open if either is); a NULL flag is closed.
    """
    c = calendar.where(F.col(day).isNotNull()).groupBy(F.col(day).cast("date").alias("day")).agg(F.max(F.coalesce(F.col(is_open), F.lit(False))).alias("open"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return c.select("day", F.coalesce(F.sum(F.col("open").cast("long")).over(w), F.lit(0)).cast("long").alias("cell"), "open")
