"""Ordered functions over the rows of an entity, as Columns. A frame that lacks a value gives NULL unless it says otherwise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TINY = 1e-12


@dataclass(frozen=True)
class Series:
    """The rows of one entity in order: every function of one Series shares one partitioning and one sort.

    ``order`` should be unique within an entity; rows that tie are taken in
    any order. NULL entities form one series, NULL dates come first.
    """

    entity: Sequence[str]
    order: Sequence[str]

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.entity).orderBy(*self.order)

    def rows(self, w: int, end: int = 0) -> WindowSpec:
        """The w rows that end ``end`` rows after the current one."""
        return self.window.rowsBetween(end - w + 1, end)

    def lag(self, c: str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.window)

    def lead(self, c: str, n: int = 1) -> Column:
        return F.lead(c, n).over(self.window)

    def diff(self, c: str, n: int = 1) -> Column:
        return F.col(c) - self.lag(c, n)

    def change(self, c: str, n: int = 1) -> Column:
        """Relative change over n rows; NULL where either end is, or the first is 0."""
        return F.try_divide(F.col(c), self.lag(c, n)) - 1

    def forward_change(self, c: str, n: int = 1) -> Column:
        return F.try_divide(self.lead(c, n), F.col(c)) - 1

    def fill(self, c: str) -> Column:
        """The last value that isn't NULL."""
        return F.last(c, ignorenulls=True).over(self.window.rowsBetween(Window.unboundedPreceding, 0))

    def full(self, value: Column, c: str, w: int) -> Column:
        """``value`` where all w values of c are there."""
        return F.when(F.count(c).over(self.rows(w)) == w, value)

    def mean(self, c: str, w: int) -> Column:
        return self.full(F.avg(c).over(self.rows(w)), c, w)

    def std(self, c: str, w: int) -> Column:
        """Sample standard deviation."""
        return self.full(F.stddev_samp(c).over(self.rows(w)), c, w)

    def min(self, c: str, w: int) -> Column:
        return self.full(F.min(c).over(self.rows(w)), c, w)

    def max(self, c: str, w: int) -> Column:
        return self.full(F.max(c).over(self.rows(w)), c, w)

    def sum(self, c: str, w: int) -> Column:
        return self.full(F.sum(c).over(self.rows(w)), c, w)

    def zscore(self, c: str, w: int) -> Column:
        return F.try_divide(F.col(c) - self.mean(c, w), self.std(c, w))

    def corr(self, x: str, y: str, w: int) -> Column:
        """Pearson correlation of w pairs; NULL where one of them doesn't vary."""
        f = self.rows(w)
        both = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(f) == w
        return F.when(both, F.try_divide(F.covar_pop(x, y).over(f), F.stddev_pop(x).over(f) * F.stddev_pop(y).over(f)))

    def mean_before(self, c: str, w: int) -> Column:
        """Mean of the up to w rows before the current one, of those that have a value."""
        return F.avg(c).over(self.window.rowsBetween(-w, -1))

    def cumulative_mean(self, c: str) -> Column:
        return F.avg(c).over(self.window.rowsBetween(Window.unboundedPreceding, 0))

    def number(self) -> Column:
        return F.row_number().over(self.window)

    def stride(self, n: int) -> Column:
        """Which of n interleaved samples a row is in, by its place."""
        return F.pmod(self.number() - 1, F.lit(n))


def by_entity(df: DataFrame, s: Series) -> DataFrame:
    """``df`` dealt out by entity to as many tasks as the session shuffles to.

    Many windows over few bytes keep a task busy for long; adaptive execution
    goes by bytes, and would put small tables into one task. The windows of
    ``s`` that follow need no other exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *s.entity)


def average_rank(c: str, by: Sequence[str] = (), descending: bool = False) -> Column:
    """Rank where equal values share the mean of their ranks. NULLs rank last, alike."""
    key = F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return F.rank().over(Window.partitionBy(*by).orderBy(key)) + (ties - 1) / 2


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per keys: the last by ``order`` (NULL before any value), and among equals by the other columns.

    One aggregation, combined before the shuffle. Columns that can't be ordered
    (maps) are not supported. NULL keys are keys.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    x = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__m"))
    return x.select(*[F.col(c) if c in keys else F.col(f"__m.{c}").alias(c) for c in df.columns])


def adjusted(bars: DataFrame) -> DataFrame:
    """high and low scaled by adj_close / close, taken as 1 where that is undefined; close is adj_close."""
    factor = F.coalesce(F.try_divide("adj_close", "close"), F.lit(1.0))
    return bars.withColumns({"high": F.col("high") * factor, "low": F.col("low") * factor, "close": F.col("adj_close")})


def technical(bars: DataFrame, s: Series, windows: Sequence[int] = (5, 20)) -> DataFrame:
    """Momentum, direction, range and volume measures of bars with close, high, low and volume.

    Added: return_{1,5,20}d, volatility_20d, volume_zscore_20d, volume_change_{1,5,20}d, corr_pv_w, wvma_w, cntd_w,
    sumd_w for each w of ``windows``, rsv_{5,14,20}d, rsi_14, bb_position, dist_52w_high.

    Three layers of windows over one sort. A comparison with a missing return
    is false, not missing, so that cntd is there a row earlier than sumd.
    Undefined wvma is 0, rsv 0.5, rsi 50, bb_position and dist_52w_high 0,
    volume_change_20d 0.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    x = bars.withColumn("volume", F.col("volume").cast("double")).select(
        "*", *[s.change("close", n).alias(f"return_{n}d") for n in (1, 5, 20)], s.change("volume").alias("volume_change_1d"), s.zscore("volume", 20).alias("volume_zscore_20d"),
        s.mean("volume", 5).alias("__v5"), s.mean("volume", 20).alias("__v20"), s.diff("close").alias("__d"),
        *[s.min("low", w).alias(f"__lo{w}") for w in (5, 14, 20)], *[s.max("high", w).alias(f"__hi{w}") for w in (5, 14, 20)],
        s.mean("close", 20).alias("__m20"), s.std("close", 20).alias("__s20"), s.max("close", 252).alias("__top"),
    )
    r = F.col("return_1d")
    x = x.withColumns({
        "__active": F.abs(r) * F.coalesce(F.try_divide("volume", "__v20"), F.lit(1.0)),
        "__up": F.when(r > 0, 1.0).otherwise(0.0), "__dn": F.when(r < 0, 1.0).otherwise(0.0),
        "__pos": F.greatest(r, r * 0), "__neg": F.greatest(-r, r * 0), "__abs": F.abs(r),
        "__gain": F.greatest(F.col("__d"), F.col("__d") * 0), "__loss": F.greatest(-F.col("__d"), F.col("__d") * 0),
    })
    cols = [
        s.std("return_1d", 20).alias("volatility_20d"), s.change("__v5", 5).alias("volume_change_5d"), zero(s.change("__v20", 20)).alias("volume_change_20d"),
        F.coalesce(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(s.mean("__gain", 14), s.mean("__loss", 14))), F.lit(50.0)).alias("rsi_14"),
        zero(F.try_divide(F.col("close") - F.col("__m20"), 2 * F.col("__s20"))).alias("bb_position"),
        zero(F.try_divide(F.col("close") - F.col("__top"), F.col("__top"))).alias("dist_52w_high"),
    ]
    for w in windows:
        cols += [
            s.corr("return_1d", "volume_change_1d", w).alias(f"corr_pv_{w}d"),
            zero(s.std("__active", w) / (s.mean("__active", w) + TINY)).alias(f"wvma_{w}d"),
            (s.mean("__up", w) - s.mean("__dn", w)).alias(f"cntd_{w}d"),
            ((s.sum("__pos", w) - s.sum("__neg", w)) / (s.sum("__abs", w) + TINY)).alias(f"sumd_{w}d"),
        ]
    for w in (5, 14, 20):
        rng = F.col(f"__hi{w}") - F.col(f"__lo{w}")
        cols.append(F.coalesce((F.col("close") - F.col(f"__lo{w}")) / (F.when(rng != 0, rng) + TINY), F.lit(0.5)).alias(f"rsv_{w}d"))
    x = x.select("*", *cols)
    return x.drop(*[c for c in x.columns if c.startswith("__")])


def trend(df: DataFrame, s: Series, c: str, windows: Sequence[int] = (5, 20, 60)) -> DataFrame:
    """Least-squares line through the last w values against time, the first of them scaled to 1: beta_w, rsqr_w, resi_w (the last one's residual).

    NULL where a value is missing or the first is 0; rsqr is 0 where the values don't vary.
    """
    x = df.withColumn("__t", s.number().cast("double"))
    for w in windows:
        f = s.rows(w)
        first = F.first(c).over(f)
        ok = (F.count(c).over(f) == w) & (first != 0)
        # over w rows in a row the times' own sum of squares is known
        sxx = w * (w * w - 1) / 12
        sxy, syy = F.regr_sxy(F.col(c), F.col("__t")).over(f), F.regr_syy(F.col(c), F.col("__t")).over(f)
        slope = F.when(ok, F.try_divide(sxy, first * sxx))
        varies = F.try_divide(syy, first * first) > TINY
        x = x.withColumns({
            f"beta_{w}d": slope,
            f"rsqr_{w}d": F.when(ok, F.when(varies, F.try_divide(sxy * sxy, sxx * syy)).otherwise(0.0)),
            f"resi_{w}d": F.when(ok, F.try_divide(F.col(c), first) - (F.try_divide(F.avg(c).over(f), first) + slope * ((w - 1) / 2))),
        })
    return x.drop("__t")


def rank_correlations(df: DataFrame, by: Sequence[str], order: str, x: str, y: str, w: int = 5) -> DataFrame:
    """Spearman correlations of every w consecutive pairs of a group, summed up: by, n_windows, mean_ic, icir (mean over sample deviation).

    Windows in which either side is constant are left out, as are rows with a
    NULL in x or y; icir is NULL where the windows don't vary. Frames of w rows
    are ranked inside the row, without Python.
    """
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    f = Window.partitionBy(*by).orderBy(order).rowsBetween(-w + 1, 0)
    d = d.select(*by, F.collect_list(x).over(f).alias("a"), F.collect_list(y).over(f).alias("b")).where(F.size("a") == w)

    def ranks(a: str) -> Column:
        return F.transform(a, lambda v: F.size(F.filter(a, lambda u: u < v)) + (F.size(F.filter(a, lambda u: u == v)) + 1) / 2)

    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    mid = (w + 1) / 2
    d = d.select(*by, ranks("a").alias("p"), ranks("b").alias("q"))
    cov = total(F.zip_with("p", "q", lambda u, v: (u - mid) * (v - mid)))
    var = lambda c: total(F.transform(c, lambda u: (u - mid) * (u - mid)))
    d = d.select(*by, F.try_divide(cov, F.sqrt(var("p") * var("q"))).alias("ic")).where("ic is not null")
    return d.groupBy(*by).agg(F.count("*").alias("n_windows"), F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"))
