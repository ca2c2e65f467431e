"""Queries over whole tables, sources and sets, and the assembled daily matrix, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.tables import constant_columns, feature_schema, grid, null_profile
from tidemark.plans.base import BARS, bars, with_
from tidemark.session import table
from tidemark.sources.files import new_only, observations, parse_json, union_tagged

MATRIX = "model_features_daily"


def null_counts(spark: SparkSession, d: str) -> DataFrame:
    x = null_profile(table(spark, d, MATRIX))
    return x.select("column", "n_null", F.round("pct_null", 6).alias("pct_null"))


def constant_cols(spark: SparkSession, d: str) -> DataFrame:
    """Numeric columns without variation, a constant one among them."""
    m = table(spark, d, MATRIX).select("td_close", "vix_level", "days_since_call", F.lit(7).alias("always_seven"), (F.col("td_close") * 0 + 1e-9).alias("nearly_nothing"))
    return constant_columns(m).select("column", F.round("sd", 6).alias("sd"))


CONSTANT_SQL = "SELECT * FROM (VALUES ('always_seven', CAST(0 AS DOUBLE)), ('nearly_nothing', CAST(0 AS DOUBLE))) v(\"column\", sd)"


def feature_families(spark: SparkSession, d: str) -> DataFrame:
    return feature_schema(table(spark, d, MATRIX), ["row_id", "date", "ticker", "issuer", "fiscal_quarter", "load_id", "loaded_at"])


FAMILIES_SQL = f"""WITH c AS (SELECT column_name AS feature FROM (DESCRIBE SELECT * EXCLUDE (row_id, date, ticker, issuer, fiscal_quarter, load_id, loaded_at) FROM model_features_daily)),
f AS (SELECT feature, CASE WHEN feature LIKE 'evt\\_%' ESCAPE '\\' THEN 'event' WHEN regexp_matches(feature, '^(transcript_|report_|topic_|framing_gap)') THEN 'quarterly text' WHEN regexp_matches(feature, '^news_|^days_since_last_news$|^is_news_burst$') THEN 'news'
  WHEN feature IN ('days_since_call', 'is_earnings_week') THEN 'timing' WHEN regexp_matches(feature, '^(vix_|gold_|dxy_)') THEN 'fear' WHEN contains(feature, 'fx_') THEN 'currency' WHEN regexp_matches(feature, 'rate_|yield_|cpi') THEN 'rates and prices'
  WHEN regexp_matches(feature, 'volume|corr_pv|wvma|cntd|sumd|rsv_|beta_|rsqr|resi_|^td_rsi|^td_bb_|^td_dist_') THEN 'volume and technical' WHEN regexp_matches(feature, '^(td_return_|td_vs_|td_volatility_)') THEN 'price' ELSE 'other' END AS family FROM c)
SELECT feature, family, CASE WHEN family = 'quarterly text' THEN 'quarterly' WHEN family IN ('event', 'news') THEN 'daily, fading or rolling' WHEN feature LIKE 'cpi%' THEN 'monthly' ELSE 'daily' END AS changes, regexp_matches(feature, '(_delta|_surprise)$') AS has_sentinel FROM f"""


def parameter_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, {"depth": [2, 3, 4], "rate": [0.05, 0.1], "trees": [50, 100, 200]})


GRID_SQL = """SELECT CAST(row_number() OVER (ORDER BY depth, rate, trees) AS INTEGER) AS config_id, depth, CAST(rate AS DOUBLE) AS rate, trees
FROM (SELECT unnest([2, 3, 4]) AS depth) CROSS JOIN (SELECT unnest([0.05, 0.1]) AS rate) CROSS JOIN (SELECT unnest([50, 100, 200]) AS trees)"""


def ticker_sets(spark: SparkSession, d: str) -> DataFrame:
    """Tickers by where they occur: in prices and the matrix, in one of them, in the annotations."""
    p, m = table(spark, d, "prices").select("ticker"), table(spark, d, MATRIX).select("ticker")
    a = table(spark, d, "annotations").select(F.upper(F.trim("ticker")).alias("ticker"))
    parts = {"both": p.intersect(m), "only_prices": p.exceptAll(p.intersect(m)).distinct().join(m, on="ticker", how="left_anti"), "annotated": a.intersect(p), "any": p.union(m).union(a).distinct()}
    return union_tagged(parts, "which").select("which", "ticker")


SETS_SQL = """WITH p AS (SELECT DISTINCT ticker FROM prices), m AS (SELECT DISTINCT ticker FROM model_features_daily), a AS (SELECT DISTINCT upper(trim(ticker)) AS ticker FROM annotations)
SELECT 'both' AS which, ticker FROM (FROM p INTERSECT FROM m) UNION ALL SELECT 'only_prices', ticker FROM (FROM p EXCEPT FROM m)
UNION ALL SELECT 'annotated', ticker FROM (FROM a INTERSECT FROM p) UNION ALL SELECT 'any', ticker FROM (FROM p UNION FROM m UNION FROM a)"""


def union_sources(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of four sources put together from tables of their own, with a tag."""
    a = table(spark, d, "annotations")
    parts = {s: a.where(F.col("source_type") == s).select("chunk_id", *(["section"] if s == "transcripts" else []), "token_count") for s in ("transcripts", "news", "reports_40f", "reports_quarterly")}
    return union_tagged(parts).groupBy("_src").agg(F.count("*").alias("n"), F.count("section").alias("n_sections"), F.sum("token_count").alias("tokens"))


UNION_SQL = "SELECT source_type AS _src, count(*) AS n, count(CASE WHEN source_type = 'transcripts' THEN section END) AS n_sections, CAST(sum(token_count) AS BIGINT) AS tokens FROM annotations GROUP BY source_type"


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """A number out of the events' JSON; the lines of errors are broken first, and dropped."""
    e = table(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("props"))
    x = parse_json(e, "props", "k bigint")
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("parsed.k").alias("total"))


PROPS_SQL = "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE event_type <> 'error' GROUP BY event_type"


def rest_observations(spark: SparkSession, d: str) -> DataFrame:
    """A macro series packed as a service's answer, a page a year, and read again; what isn't a number is skipped."""
    m = table(spark, d, "macro").where("series = 'goc_2y' and value is not null and not isnan(value)")
    o = F.to_json(F.struct(F.col("date").cast("string").alias("d"), F.struct(F.when(F.dayofmonth("date") == 13, "n/a").otherwise(F.col("value").cast("string")).alias("v")).alias("goc_2y")))
    pages = m.select(F.year("date").alias("y"), o.alias("o")).groupBy("y").agg(F.concat(F.lit('{"observations": ['), F.array_join(F.collect_list("o"), ","), F.lit("]}")).alias("page"))
    return observations(pages, "page", "goc_2y")


OBS_SQL = "SELECT date, series, value FROM macro WHERE series = 'goc_2y' AND value IS NOT NULL AND NOT isnan(value) AND day(date) <> 13"


def new_rows(spark: SparkSession, d: str) -> DataFrame:
    """Prices whose (ticker, date) the matrix hasn't."""
    p = bars(spark, d).select(F.concat_ws("|", "ticker", "date").alias("key"))
    m = table(spark, d, MATRIX).select(F.concat_ws("|", "ticker", "date").alias("key"))
    return new_only(p, m, "key")


NEW_SQL = with_(BARS) + "SELECT ticker || '|' || date AS key FROM bars b WHERE NOT EXISTS (SELECT 1 FROM model_features_daily m WHERE m.ticker = b.ticker AND m.date = b.date)"


QUERIES = {
    "null_counts": null_counts,
    "constant_cols": constant_cols,
    "feature_families": feature_families,
    "parameter_grid": parameter_grid,
    "ticker_sets": ticker_sets,
    "union_sources": union_sources,
    "event_props": event_props,
    "rest_observations": rest_observations,
    "new_rows": new_rows,
}

ORACLE = {
    "null_counts": "SELECT name AS \"column\", n - c AS n_null, round(100.0 * (n - c) / nullif(n, 0), 6) AS pct_null FROM (SELECT count(*) AS n FROM model_features_daily), (UNPIVOT (SELECT count(COLUMNS(*)) FROM model_features_daily) ON COLUMNS(*) INTO NAME name VALUE c)",
    "constant_cols": CONSTANT_SQL,
    "feature_families": FAMILIES_SQL,
    "parameter_grid": GRID_SQL,
    "ticker_sets": SETS_SQL,
    "union_sources": UNION_SQL,
    "event_props": PROPS_SQL,
    "rest_observations": OBS_SQL,
    "new_rows": NEW_SQL,
}
