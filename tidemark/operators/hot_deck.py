"""Missing values filled from similar records: sequential hot deck."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.missing import Reading, usable

P = "__hd_"


def hot_deck(
    df: DataFrame,
    fields: Mapping[str, Reading] | Sequence[str],
    *,
    row_id: str,
    date: str,
    within: str,
    levels: Sequence[str] = (),
    block_days: int = 92,
    rows_per_block: int = 500_000,
) -> DataFrame:
    """``df`` with, for every field f, f_filled, f_was_missing, f_donor_level, f_donor_date and f_distance.

    Records of one ``within`` group are sorted by date and row_id; a missing
    cell takes the value of the nearest record before or after it that holds
    one (fewer days win, the earlier record on a tie). What has no donor there
    takes one from the groups of ``levels`` in turn, of which the last resort
    is "" for all rows: the nearest day's donor, where the record with the
    lowest row_id that day stands for it. f_distance is in days. A column that
    already bears an output's name is replaced.

    Scale: no sort spans a whole group. Records are sorted within (group, block
    of ``block_days``) only; the last and first donor of every block, one row
    each, are carried over the blocks and joined back by the same keys. Groups
    with more than ``rows_per_block`` rows in a block get blocks of fewer days,
    one at least; the list of these groups has at most a row for every
    rows_per_block of the table, and is broadcast where the table's count makes
    that a million rows at most. Donors of the further levels are first reduced
    to one record a day.

    Nulls: a NULL group is a group of its own; a record without a date can be
    no donor and is filled only from records of its own group without a date.
    An empty table gives an empty table; a field no record holds stays NULL
    and has f_was_missing true, f_donor_level NULL.
    """
    rules = dict(fields) if isinstance(fields, Mapping) else {f: Reading() for f in fields}
    kinds = {x.name: x.dataType for x in df.schema}
    out = [f"{f}{s}" for f in rules for s in ("_filled", "_was_missing", "_donor_level", "_donor_date", "_distance")]
    df = df.drop(*[c for c in out if c in df.columns])
    day = F.unix_date(F.col(date).cast("date"))
    groups = df.groupBy(F.col(within).alias(f"{P}big")).agg(F.count("*").alias("n"), (F.max(day) - F.min(day) + 1).alias("span"))
    fair = F.floor(F.greatest(F.coalesce("span", F.lit(1)), F.lit(block_days)) * rows_per_block / F.col("n"))
    big = groups.where(fair < block_days).select(f"{P}big", F.greatest(fair, F.lit(1)).alias(f"{P}len"))
    columns = df.columns
    if df.count() / rows_per_block <= 1_000_000:  # each of the list's groups has more than rows_per_block rows
        big = F.broadcast(big)
    df = df.join(big, on=F.col(within).eqNullSafe(F.col(f"{P}big")), how="left")
    block = F.floor(day / F.coalesce(F.col(f"{P}len"), F.lit(block_days)))
    names = {f: f"{P}{i}_" for i, f in enumerate(rules)}
    base = df.select(*columns, day.alias(f"{P}day"), block.alias(f"{P}block"))
    for f, rule in rules.items():
        donor = F.struct(usable(F.col(f), kinds[f], rule).alias("v"), F.col(f"{P}day").alias("d"))
        base = base.withColumn(names[f], F.when(usable(F.col(f), kinds[f], rule).isNotNull(), donor))
    keys = [within, f"{P}block"]
    # what comes after is what came before in reverse: a frame up to the end would be gone through again for every row
    before = Window.partitionBy(*keys).orderBy(f"{P}day", row_id).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.col(f"{P}day").desc(), F.col(row_id).desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = base.select(
        "*",
        *[F.last(n, ignorenulls=True).over(before).alias(f"{n}p") for n in names.values()],
        *[F.last(n, ignorenulls=True).over(after).alias(f"{n}q") for n in names.values()],
    )
    # the outermost donors of each block, carried to its neighbours
    order = F.struct(F.col(f"{P}day"), F.col(row_id))
    edges = base.groupBy(*keys).agg(
        *[F.max_by(n, F.when(F.col(n).isNotNull(), order)).alias(f"{n}l") for n in names.values()],
        *[F.min_by(n, F.when(F.col(n).isNotNull(), order)).alias(f"{n}f") for n in names.values()],
    )
    wb = Window.partitionBy(within).orderBy(f"{P}block").rowsBetween(Window.unboundedPreceding, -1)
    we = Window.partitionBy(within).orderBy(F.col(f"{P}block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = F.col(f"{P}block").isNotNull()
    # a block of records without a date neither gives to nor takes from the others
    carried = edges.select(
        *keys,
        *[
            F.when(known, F.last(F.when(known, F.col(f"{n}l")), ignorenulls=True).over(wb)).alias(f"{n}cp")
            for n in names.values()
        ],
        *[
            F.when(known, F.last(F.when(known, F.col(f"{n}f")), ignorenulls=True).over(we)).alias(f"{n}cq")
            for n in names.values()
        ],
    )
    c = carried.select(*[F.col(k).alias(f"{P}k{i}") for i, k in enumerate(keys)], *[x for x in carried.columns if x not in keys])
    full = near.join(c, on=[F.col(k).eqNullSafe(F.col(f"{P}k{i}")) for i, k in enumerate(keys)], how="left")

    def nearest(p: Column, q: Column) -> Column:
        dp, dq = F.col(f"{P}day") - p["d"], q["d"] - F.col(f"{P}day")
        return F.when(p.isNull(), q).when(q.isNull(), p).when(dq < dp, q).otherwise(p)

    picked = full
    for n in names.values():
        picked = picked.withColumn(f"{n}x", nearest(F.coalesce(F.col(f"{n}p"), F.col(f"{n}cp")), F.coalesce(F.col(f"{n}q"), F.col(f"{n}cq"))))
        picked = picked.withColumn(f"{n}lv", F.when(F.col(f"{n}x").isNotNull(), F.lit(within)))
    for level in levels:
        picked = _from_level(picked, base, level, list(names.values()), row_id)
    cols = [F.col(x) for x in columns]
    for f, n in names.items():
        x, miss = F.col(f"{n}x"), F.col(n).isNull()
        cols += [
            F.when(miss, x["v"]).otherwise(F.col(n)["v"]).alias(f"{f}_filled"),
            miss.alias(f"{f}_was_missing"),
            F.when(miss, F.col(f"{n}lv")).alias(f"{f}_donor_level"),
            F.when(miss, F.date_from_unix_date(x["d"])).alias(f"{f}_donor_date"),
            F.when(miss, F.abs(F.col(f"{P}day") - x["d"])).alias(f"{f}_distance"),
        ]
    return picked.select(*cols)


def _from_level(rows: DataFrame, base: DataFrame, level: str, names: list[str], row_id: str) -> DataFrame:
    """Cells still without a donor take the nearest day's donor of their ``level`` group."""
    key = F.col(level) if level else F.lit(0)
    label = level or "all"
    days = base.where(F.col(f"{P}day").isNotNull()).groupBy(key.alias(f"{P}g"), f"{P}day").agg(
        *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col(row_id))).alias(n) for n in names]
    )
    before = Window.partitionBy(f"{P}g").orderBy(f"{P}day").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(f"{P}g").orderBy(F.col(f"{P}day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = days.select(
        f"{P}g",
        F.col(f"{P}day").cast("long").alias(f"{P}gd"),
        *[F.last(n, ignorenulls=True).over(before).alias(f"{n}gp") for n in names],
        *[F.last(n, ignorenulls=True).over(after).alias(f"{n}gq") for n in names],
    )
    # rows that lack nothing match no day; their keys are spread so that they gather nowhere
    lacking = reduce(or_, [F.col(f"{n}x").isNull() for n in names])
    spread = F.lit(-(10**7)) - F.pmod(F.xxhash64(row_id), F.lit(10**6))
    left = rows.withColumn(f"{P}need", F.when(lacking, F.col(f"{P}day").cast("long")).otherwise(spread))
    j = left.join(near, on=key.eqNullSafe(F.col(f"{P}g")) & (F.col(f"{P}need") == F.col(f"{P}gd")), how="left")
    for n in names:
        p, q = F.col(f"{n}gp"), F.col(f"{n}gq")
        best = F.when(p.isNull(), q).when(q.isNull(), p).when(q["d"] - F.col(f"{P}day") < F.col(f"{P}day") - p["d"], q).otherwise(p)
        got = F.col(f"{n}x").isNull() & best.isNotNull()
        j = j.withColumn(f"{n}lv", F.when(got, F.lit(label)).otherwise(F.col(f"{n}lv"))).withColumn(f"{n}x", F.coalesce(F.col(f"{n}x"), best))
    return j.select(rows.columns)


def marked_cells(filled: DataFrame, fields: Sequence[str], row_id: str, *extra: str) -> DataFrame:
    """One row for each cell that ``hot_deck`` marked: row_id, field and, for each of extra (a suffix), that output."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_was_missing").alias("m"), *[F.col(f"{f}{s}").alias(s.strip("_")) for s in extra]) for f in fields])
    x = filled.select(row_id, F.explode(F.filter(cells, lambda c: c["m"])).alias("c"))
    return x.select(row_id, F.col("c.field").alias("field"), *[F.col(f"c.{s.strip('_')}") for s in extra])
