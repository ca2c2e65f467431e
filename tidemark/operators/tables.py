"""Whole-table operators: missing and constant columns, parameter grids, feature schemas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINEL = -9999.0


def null_profile(df: DataFrame) -> DataFrame:
    """column, n_null, pct_null of every column, in one aggregation; NaN isn't NULL here."""
    cells = [F.struct(F.lit(c).alias("column"), F.sum(F.col(f"`{c}`").isNull().cast("long")).alias("n_null")) for c in df.columns]
    x = df.agg(F.count("*").alias("n"), F.array(*cells).alias("c")).select("n", F.inline("c"))
    return x.select("column", F.coalesce("n_null", F.lit(0)).alias("n_null"), F.try_divide(100.0 * F.col("n_null"), F.col("n")).alias("pct_null"))


def constant_columns(df: DataFrame, near: float = 1e-6) -> DataFrame:
    """column, sd of the numeric columns whose sample deviation is below ``near``; NaN is left out, columns with fewer than two values aren't judged."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    v = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    x = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.stddev_samp(v(c)).alias("sd")) for c in names]).alias("c")).select(F.inline("c"))
    return x.where(F.col("sd") < near)


def without_sentinel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """-9999 made NULL."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(SENTINEL).cast(df.schema[c].dataType)) for c in columns})


def with_sentinel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL made -9999."""
    these = set(columns)
    return df.selectExpr(*[f"coalesce(`{c}`, CAST({SENTINEL} AS {t})) AS `{c}`" if c in these else f"`{c}`" for c, t in df.dtypes])


def grid(spark, parameters: Mapping[str, Sequence[object]]) -> DataFrame:  # noqa: ANN001
    """Every combination of the parameters' values, numbered from 1 in the order of the first parameter, then the next."""
    x = spark.range(1).drop("id")
    for i, (k, values) in enumerate(parameters.items()):
        x = x.select("*", F.posexplode(F.array(*map(F.lit, values))).alias(f"__{i}", k))
    size = 1
    place = F.lit(1)
    for i, values in reversed(list(enumerate(parameters.values()))):
        place = place + F.col(f"__{i}") * size
        size *= len(values)
    return x.select(place.alias("config_id"), *parameters)


def starting(columns: Sequence[str], *prefixes: str) -> list[str]:
    return [c for c in columns if c.startswith(prefixes)]


def ending(columns: Sequence[str], *suffixes: str) -> list[str]:
    return [c for c in columns if c.endswith(suffixes)]


def looks_ahead(columns: Sequence[str], allowed: Sequence[str] = ()) -> list[str]:
    """Columns whose name says that they hold the future."""
    return [c for c in columns if any(w in c for w in ("fwd", "future", "next")) and c not in allowed]


def feature_group(name: Column) -> Column:
    """Which family a feature belongs to, by its name."""
    return (
        F.when(name.startswith("evt_"), "event")
        .when(name.rlike("^(transcript_|report_|topic_|framing_gap)"), "quarterly text")
        .when(name.startswith("news_") | name.isin("days_since_last_news", "is_news_burst"), "news")
        .when(name.isin("days_since_call", "is_earnings_week"), "timing")
        .when(name.rlike("^(vix_|gold_|dxy_)"), "fear")
        .when(name.contains("fx_"), "currency")
        .when(name.rlike("rate_|yield_|cpi"), "rates and prices")
        .when(name.rlike("volume|corr_pv|wvma|cntd|sumd|rsv_|beta_|rsqr|resi_|^td_rsi|^td_bb_|^td_dist_"), "volume and technical")
        .when(name.rlike("^(td_return_|td_vs_|td_volatility_)"), "price")
        .otherwise("other")
    )


def feature_schema(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """feature, family, how often it changes and whether a sentinel stands for its missing values; one row per column that is no key."""
    names = [c for c in df.columns if c not in keys]
    x = df.sparkSession.createDataFrame([(c,) for c in names], "feature string").withColumn("family", feature_group(F.col("feature")))
    often = F.when(F.col("family") == "quarterly text", "quarterly").when(F.col("family").isin("event", "news"), "daily, fading or rolling").when(F.col("feature").startswith("cpi"), "monthly").otherwise("daily")
    return x.withColumn("changes", often).withColumn("has_sentinel", F.col("feature").rlike("(_delta|_surprise)$"))


#: What each family of features comes from, how often it changes, from when it is known.
LINEAGE = {
    "event": ("quarterly text and news, faded", "daily, fading", "end of day"),
    "quarterly text": ("annotations of calls and reports", "quarterly, carried to days", "from the call on"),
    "news": ("annotations of news", "daily, rolling", "end of day"),
    "timing": ("call dates", "daily", "end of day"),
    "fear": ("macro series", "daily", "end of day"),
    "currency": ("macro series", "daily", "end of day"),
    "rates and prices": ("macro series", "daily", "end of day"),
    "volume and technical": ("prices", "daily", "end of day"),
    "price": ("prices", "daily", "end of day"),
    "other": ("daily matrix", "daily", "end of day"),
}


def feature_lineage(spark, features: Sequence[str], fixed: Sequence[str] = (), reduced: Sequence[str] = (), ranking: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """One row per feature: family, source, construction, changes, known, missing, role, in_reduced_set, is_event and, of ``ranking`` (a row per feature), its statistics, NULL where it has none.

    Features are few; the ranking's columns other than feature come out as they are, but for those named like an output, which are dropped.
    """
    x = spark.createDataFrame([(c,) for c in features], "feature string")
    f = F.col("feature")
    x = x.withColumn("family", feature_group(f))
    of = lambda i: F.coalesce(*[F.when(F.col("family") == k, v[i]) for k, v in LINEAGE.items()])
    built = (
        F.when(f.startswith("evt_"), "a quarterly or rolling signal times its decay").when(f.endswith("_ffill"), "the last quarter's value").when(f.endswith("_delta"), "change from the quarter before")
        .when(f.endswith("_surprise"), "difference from the mean of the four quarters before").when(f.rlike("_mean_\\d+d$"), "mean over the trailing days").when(f.rlike("_count_\\d+d$"), "count over the trailing days")
        .when(f.startswith("days_since_"), "calendar days since the last one").when(f.startswith("is_"), "flag").when(f.contains("_vs_"), "difference of returns").when(f.rlike("_return_\\d+d$"), "relative change over rows")
        .when(f.endswith("_level"), "last reading carried forward").when(f.contains("volatility"), "deviation of daily changes").otherwise("ordered function of the series")
    )
    missing = F.when(f.rlike("(_delta|_surprise)$"), "sentinel").when(f.rlike("_(beta|rsqr|resi)_"), "0").otherwise("NULL")
    x = x.select(
        "feature", "family", of(0).alias("source"), built.alias("construction"), F.when(f.startswith("cpi"), "monthly, carried to days").otherwise(of(1)).alias("changes"), of(2).alias("known"), missing.alias("missing"),
        F.when(f.isin(*fixed), "fixed").otherwise("candidate").alias("role"), f.isin(*reduced).alias("in_reduced_set"), f.startswith("evt_").alias("is_event"),
    )
    if ranking is None:
        return x
    return x.join(ranking.drop(*[c for c in ranking.columns if c in x.columns and c != "feature"]), on="feature", how="left")
