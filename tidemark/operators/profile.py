"""Column profiles of table loads: checks compiled into one aggregate scan, mergeable states, control limits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shares of the value distribution at which metrics look at it.
GRID = tuple(i / 50 for i in range(51))

#: Buckets of the hashes of values, by whose shares texts are compared.
BUCKETS = 64


@dataclass(frozen=True)
class Check:
    """What holds for a column's values: regular expression, allowed values, bounds (both inclusive), values that stand for a missing one.

    shares_of: what the column's shares are taken of instead of its values, for
    values that move on from load to load by themselves (a quarter's lag behind
    the row's date, say). Rows where it is NULL have no part in them.
    """

    pattern: str | None = None
    domain: Sequence[object] | None = None
    low: float | None = None
    high: float | None = None
    stand_ins: Sequence[float] = (-9999.0,)
    shares_of: Column | None = None


def _measure(c: Column, kind: T.DataType) -> Column:
    """A number to describe the distribution by: the value, the day of a date, the length of a text, the size of an array."""
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_seconds(c.cast("timestamp")).cast("double")
    if isinstance(kind, T.ArrayType):
        return F.size(c).cast("double")
    if isinstance(kind, T.StringType):
        return F.length(c).cast("double")
    return F.when(c.isNotNull(), F.lit(1.0))


def column_states(df: DataFrame, part: str, columns: Sequence[str] | None = None, checks: Mapping[str, Check] | None = None) -> DataFrame:
    """One row per value of ``part`` and column, with counts and sketches that can be kept and merged.

    Columns out: part, field, n, nulls, nans, stand_ins, off_pattern,
    off_domain, off_range, used, measured, low, high, mean, m2 (sum of squares
    about the mean), distinct (HLL sketch), spread (KLL sketch), shares (texts
    and columns with shares_of: rows by hash of the value, BUCKETS counts, exact;
    NULL for others). used counts the
    values left after nulls, NaN and stand-ins, measured those of them that are
    finite; these alone enter what follows it. Values off a pattern or
    domain are texts spelled nan, none, null and n/a too.

    Scale: all checks of all columns are one aggregation, combined before the
    shuffle, which then carries one row per part and map task.

    Nulls: a NULL part is a part. Nested columns are judged by their presence
    and, for arrays, size. An empty table has no states.
    """
    checks = checks or {}
    kinds = {f.name: f.dataType for f in df.schema}
    columns = list(columns or [c for c in df.columns if c != part])
    aggs, cells = [], []
    for i, name in enumerate(columns):
        c, kind, rule = F.col(f"`{name}`"), kinds[name], checks.get(name, Check())
        nan = F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False)
        standing = c.isin(*rule.stand_ins) if rule.stand_ins and isinstance(kind, T.NumericType) else F.lit(False)
        used = c.isNotNull() & ~F.coalesce(nan, F.lit(False)) & ~F.coalesce(standing, F.lit(False))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            finite = used & (F.abs(c) != float("inf"))
        else:
            finite = used
        x = F.when(finite, _measure(c, kind))
        share = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
        off_pattern = used & ~c.rlike(rule.pattern) if rule.pattern else F.lit(False)
        off_domain = used & ~c.isin(*rule.domain) if rule.domain else F.lit(False)
        off_range = F.lit(False)
        if rule.low is not None:
            off_range = off_range | (used & (c < rule.low))
        if rule.high is not None:
            off_range = off_range | (used & (c > rule.high))
        key = F.when(used, F.xxhash64(F.to_json(F.struct(c)) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c))
        shares = F.lit(None).cast("array<double>")
        if isinstance(kind, T.StringType) or rule.shares_of is not None:
            of = c if rule.shares_of is None else rule.shares_of
            # as many bins as buckets: only bins of one bucket are ever made one (at a mean that may be off by a rounding); tasks' bins of a bucket may stay apart
            bins = F.histogram_numeric(F.when(used & of.isNotNull(), F.pmod(F.xxhash64(of), F.lit(BUCKETS)).cast("double")), F.lit(BUCKETS))
            shares = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.reduce(F.filter(F.coalesce(bins, F.array().cast("array<struct<x:double,y:double>>")), lambda e: F.round(e["x"]) == b), F.lit(0.0), lambda t, e: t + e["y"]))
        parts = {
            "n": F.count(F.lit(1)), "nulls": share(c.isNull()), "nans": share(nan), "stand_ins": share(standing), "off_pattern": share(off_pattern),
            "off_domain": share(off_domain), "off_range": share(off_range), "used": share(used), "measured": F.count(x), "low": F.min(x), "high": F.max(x),
            "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "distinct": F.hll_sketch_agg(key), "spread": F.kll_sketch_agg_double(x),
            "shares": shares,
        }
        aggs += [v.alias(f"__{i}_{k}") for k, v in parts.items()]
        cells.append(F.struct(F.lit(name).alias("field"), *[F.col(f"__{i}_{k}").alias(k) for k in parts]))
    wide = df.groupBy(F.col(part).alias("part")).agg(*aggs)
    return wide.select("part", F.explode(F.array(*cells)).alias("s")).select("part", "s.*")


def add_loads(df: DataFrame, part: str, path: str, columns: Sequence[str] | None = None, checks: Mapping[str, Check] | None = None) -> DataFrame:
    """The states kept at ``path``, after those of the loads of ``df`` that it doesn't hold yet were added.

    Only new loads are profiled: their rows alone go through ``column_states``,
    and their states are appended, one directory a load. ``path`` must lie where all
    executors can write. A load that is kept stays as it was kept; loads by
    whose value nothing is known (NULL) are kept under Spark's name for it.
    """
    spark = df.sparkSession
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    some = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
    held = spark.read.parquet(path).select(F.col("part").alias("__held")).distinct() if some else None
    new = df if held is None else df.join(F.broadcast(held), on=F.col(part).eqNullSafe(F.col("__held").cast(df.schema[part].dataType)), how="left_anti")  # a row a load
    column_states(new, part, columns, checks).write.mode("append").partitionBy("part").parquet(path)
    kept = spark.read.parquet(path)
    return kept.select(F.col("part").cast(df.schema[part].dataType).alias("part"), *[c for c in kept.columns if c != "part"])


def merge_states(states: DataFrame, *by: str) -> DataFrame:
    """States of the same ``by`` (field among them) made one, as if their rows had been profiled together."""
    sums = ("n", "nulls", "nans", "stand_ins", "off_pattern", "off_domain", "off_range", "used", "measured")
    w = Window.partitionBy(*by)
    about = F.try_divide(F.sum(F.col("mean") * F.col("measured")).over(w), F.sum("measured").over(w))
    x = states.withColumn("__about", about)
    x = x.withColumn("m2", F.col("m2") + F.col("measured") * (F.col("mean") - F.col("__about")) ** 2)
    return x.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in sums], F.min("low").alias("low"), F.max("high").alias("high"), F.max("__about").alias("mean"), F.sum("m2").alias("m2"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("spread").alias("spread"),
        F.reduce(F.collect_list("shares"), F.lit(None).cast("array<double>"), lambda a, b: F.when(a.isNull(), b).otherwise(F.zip_with(a, b, lambda u, v: u + v))).alias("shares"),
    )


def _apart(a: Column, b: Column) -> Column:
    """Half the sum of the differences of two arrays of counts as shares, less what chance alone makes of it; NULL if either holds nothing."""
    total = lambda s: F.reduce(s, F.lit(0.0), lambda t, v: t + v)
    m, n = total(a), total(b)

    def one(u: Column, v: Column) -> Column:
        p = (u + v) / (m + n)
        return F.abs(u / m - v / n) - F.sqrt(2 / math.pi * p * (1 - p) * (1 / m + 1 / n))

    return F.when((m > 0) & (n > 0), F.greatest(F.lit(0.0), 0.5 * total(F.zip_with(a, b, one))))


def state_metrics(states: DataFrame, pooled: DataFrame | None = None) -> DataFrame:
    """Metrics of each state: rates, distinct count, range, mean, sd, quartiles, mode_share, top_share and, against ``pooled`` states by field, distances.

    mode_share looks at numbers (the length of a text), top_share at the values
    themselves: the share of the fullest bucket. distance is the greatest of the
    distributions of numbers; mix_distance that of the shares from the pooled
    ones; step_distance that of the shares from those of the two parts before
    and the two after, of these the second least (at the ends, where two are all,
    the least): parts next to a broken one aren't far from the rest, and two
    that are broken alike still are.
    """
    rate = lambda c: F.col(c) / F.col("n")
    some = F.kll_sketch_get_n_double("spread") > 0
    q = F.when(some, F.kll_sketch_get_quantile_double("spread", F.array(*map(F.lit, GRID))))
    x = states.withColumn("q", q)
    k = len(GRID) - 1
    # the longest run of equal quantiles, as a share
    run = F.aggregate(
        F.sequence(F.lit(1), F.lit(k)),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, i: F.struct(
            F.when(F.get("q", i) == F.get("q", i - 1), a["now"] + 1).otherwise(0).alias("now"),
            F.greatest(a["most"], F.when(F.get("q", i) == F.get("q", i - 1), a["now"] + 1).otherwise(0)).alias("most"),
        ),
        lambda a: a["most"] / F.lit(float(k)),
    )
    x = x.select(
        *[c for c in states.columns if c not in ("distinct", "spread", "m2")],
        *[rate(c).alias(f"{c}_rate") for c in ("nulls", "nans", "stand_ins", "off_pattern", "off_domain", "off_range")],
        F.hll_sketch_estimate("distinct").alias("n_distinct"), F.sqrt(F.try_divide("m2", "measured")).alias("sd"),
        F.get("q", F.lit(k // 4)).alias("q25"), F.get("q", F.lit(k // 2)).alias("q50"), F.get("q", F.lit(3 * k // 4)).alias("q75"),
        F.when(F.col("q").isNotNull(), run).alias("mode_share"), "q",
        F.try_divide(F.array_max("shares"), F.reduce("shares", F.lit(0.0), lambda t, v: t + v)).alias("top_share"),
    )
    if pooled is None:
        return x.drop("q", "shares")
    p = pooled.select(F.col("field").alias("__f"), F.when(F.kll_sketch_get_n_double("spread") > 0, F.kll_sketch_get_quantile_double("spread", F.array(*map(F.lit, GRID)))).alias("__q"), F.col("shares").alias("__s"))
    x = x.join(p, on=F.col("field") == F.col("__f"), how="left")
    below = lambda a, v: F.size(F.filter(a, lambda y: y <= v)) / F.lit(float(k + 1))
    gap = F.array_max(F.transform("__q", lambda v: F.abs(below(F.col("q"), v) - below(F.col("__q"), v))))
    x = x.withColumn("distance", gap).withColumn("mix_distance", _apart(F.col("shares"), F.col("__s")))
    w = Window.partitionBy("field").orderBy("part")
    near = F.array(*[f("shares", i).over(w) for f in (F.lag, F.lead) for i in (1, 2)])
    x = x.withColumn("__near", near)
    steps = F.array_sort(F.filter(F.transform("__near", lambda o: _apart(F.col("shares"), o)), lambda v: v.isNotNull()))
    x = x.withColumn("step_distance", F.get(steps, (F.size(steps) > 2).cast("int")))
    return x.drop("__f", "__q", "q", "__s", "__near", "shares")


#: Rates of what a sound load has none of: where the others have (nearly) none, a load's
#: limit is what chance makes of so few, between these shares.
VIOLATIONS, LEAST_RATE = ("nans_rate", "stand_ins_rate", "off_pattern_rate", "off_domain_rate", "off_range_rate"), 0.02

#: Metric, how it is compared, and the change that matters in practice whatever
#: the history's spread: "rate" by difference, "log" by difference of logs,
#: "shift" in units of the usual standard deviation
#: (or of a twentieth of the usual mean, if that is more).
LIMITS = (
    ("nulls_rate", "rate", 0.05), ("nans_rate", "rate", 0.05), ("stand_ins_rate", "rate", 0.05), ("off_pattern_rate", "rate", 0.05),
    ("off_domain_rate", "rate", 0.05), ("off_range_rate", "rate", 0.05), ("mode_share", "rate", 0.25), ("n_distinct", "log", math.log(3)),
    ("sd", "log", math.log(3)), ("mean", "shift", 1.0), ("q50", "shift", 1.25), ("distance", "rate", 0.4),
    ("top_share", "rate", 0.25), ("mix_distance", "rate", 0.4), ("step_distance", "rate", 0.25),
)


def out_of_control(
    metrics: DataFrame, *, by: Sequence[str] = ("field",), width: float = 5.0, least_history: int = 5, least_rows: int = 1, memory: int | None = None
) -> DataFrame:
    """One row for each metric of a state that is out of line with the same column's other states: part, by, metric, value, centre, limit.

    Centre and spread are median and 1.4826 median absolute deviations over all
    states of the column, which a minority of broken loads can't move; with
    ``memory`` over the so many states before each, by ``part``, as when loads
    are judged on arrival (the distances, which look both ways, are left out). Out of
    line is what lies further from the centre than ``width`` spreads and than
    the metric's own least change in LIMITS. Columns with fewer than
    ``least_history`` states are not judged. Metrics that are NULL aren't.
    States with fewer than ``least_rows`` rows (for rates) or usable values (for
    all else) are neither judged nor history. n_distinct is out of line if it is
    both as it stands and per usable value, so that a small load isn't for being small.

    Scale: works on states, a row per load and column, not on the data.
    """
    keys = list(by)
    names = [m for m, _, _ in LIMITS if m in metrics.columns]
    long = metrics.select("part", *keys, "n", "used", "sd", F.col("mean").alias("__mean"), (F.col("q75") - F.col("q25")).alias("__iqr"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("m"))
    long = long.select("part", *keys, "n", "used", "sd", "__mean", "__iqr", "m.metric", "m.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    long = long.where(F.when(F.col("metric").endswith("_rate"), F.col("n")).otherwise(F.col("used")) >= least_rows)
    how = {m: (h, least) for m, h, least in LIMITS}
    is_log = F.col("metric").isin([m for m in names if how[m][0] == "log"])
    is_shift = F.col("metric").isin([m for m in names if how[m][0] == "shift"])
    w = Window.partitionBy(*keys, "metric")
    if memory is not None:
        long = long.where(~F.col("metric").endswith("distance"))
        w = w.orderBy("part").rowsBetween(-memory, -1)

    def mid(c: Column, about: Column | None = None) -> Column:
        """Median over the history of c, or of its distances from ``about``."""
        if memory is None:
            return F.median(c if about is None else F.abs(c - about)).over(w)
        values = F.collect_list(c).over(w)
        values = F.array_sort(values if about is None else F.transform(values, lambda v: F.abs(v - about)))
        n = F.size(values)
        return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2

    # a column that hardly varies is measured against its size
    unit = F.greatest(F.coalesce(mid(F.col("sd")), F.lit(0.0)), 0.05 * F.abs(F.coalesce(mid(F.col("__mean")), F.lit(0.0))), F.lit(1e-12))
    # the median of a column of few values may lie on either of two of them
    unit = F.when(F.col("metric") == "q50", F.greatest(unit, 0.85 * F.coalesce(mid(F.col("__iqr")), F.lit(0.0)))).otherwise(unit)
    long = long.withColumn("unit", unit).withColumn("history", F.count("*").over(w))
    floor = F.when(F.col("metric") == "sd", 0.1 * F.col("unit")).otherwise(F.lit(1e-12))
    long = long.withColumn("x", F.when(is_log, F.log(F.greatest(F.col("value"), floor))).otherwise(F.col("value")))
    long = long.withColumn("centre", mid(F.col("x")))
    long = long.withColumn("spread", 1.4826 * mid(F.col("x"), F.col("centre")))
    least = F.coalesce(*[F.when(F.col("metric") == m, F.lit(how[m][1])) for m in names])
    # violations: what chance alone makes of the usual rate in a load of this size, one more and one less taken as seen
    usual = (F.col("centre") * F.col("n") + 1) / (F.col("n") + 2)
    chance = F.greatest(F.lit(LEAST_RATE), width * F.sqrt(usual * (1 - usual) / F.greatest(F.col("n"), F.lit(1))))
    least = F.when(F.col("metric").isin(*VIOLATIONS), F.least(least, chance)).otherwise(least)
    limit = F.greatest(width * F.col("spread"), F.when(is_shift, least * F.col("unit")).otherwise(least))
    off = F.col("x") - F.col("centre")
    per_value = F.col("x") - F.log(F.greatest(F.col("used"), F.lit(1)).cast("double"))
    long = long.withColumn("__per", per_value).withColumn("__per", F.col("__per") - mid(F.col("__per")))
    # the lesser of the two changes, none if they go different ways
    lesser = F.when(off * F.col("__per") > 0, F.least(F.abs(off), F.abs(F.col("__per")))).otherwise(0.0)
    # a load that is nearer to the others than usual isn't out of line
    change = F.when(F.col("metric") == "n_distinct", lesser).when(F.col("metric").isin("mix_distance", "step_distance"), off).otherwise(F.abs(off))
    out = long.withColumn("limit", limit).where((change > F.col("limit")) & (F.col("history") >= least_history))
    back = F.when(is_log, F.exp("centre")).otherwise(F.col("centre"))
    return out.select("part", *keys, "metric", "value", back.alias("centre"), "limit")
