"""Inputs that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.rolling import Series, latest_row
from tidemark.session import table

TICKER = Series(["ticker"], ["date"])


def bars(spark: SparkSession, d: str) -> DataFrame:
    """One row per ticker and date: the one that was sent last."""
    p = table(spark, d, "prices").select("ticker", "issuer", "date", "open", "high", "low", "close", "adj_close", "volume", "ingested_at", "price_id")
    return latest_row(p, ["ticker", "date"], ["ingested_at", "price_id"]).drop("ingested_at", "price_id")


BARS = """bars AS (SELECT ticker, issuer, date, open, high, low, close, adj_close, volume FROM prices
  QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY ingested_at DESC, price_id DESC) = 1)"""


def market(b: DataFrame) -> DataFrame:
    """A market series: the middle adj_close and the total volume of each date; a row a calendar day."""
    return b.groupBy("date").agg(F.median("adj_close").alias("market_close"), F.sum("volume").alias("market_volume"))


MARKET = "market AS (SELECT date, median(adj_close) AS market_close, CAST(sum(volume) AS BIGINT) AS market_volume FROM bars GROUP BY date)"


def macro(spark: SparkSession, d: str, series: str) -> DataFrame:
    """date, value of one series: per date the value that was recorded last and isn't missing."""
    m = table(spark, d, "macro").where((F.col("series") == series) & F.col("value").isNotNull() & ~F.isnan("value")).select("date", "recorded_at", "value")
    return latest_row(m, ["date"], ["recorded_at", "value"]).select("date", "value")


def macro_sql(series: str) -> str:
    return f"{series} AS (SELECT date, value FROM macro WHERE series = '{series}' AND value IS NOT NULL AND NOT isnan(value) QUALIFY row_number() OVER (PARTITION BY date ORDER BY recorded_at DESC, value DESC) = 1)"


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk's last annotation with a usable score: chunk_id, ticker, issuer, source_type, quarter, section, role, date, sentiment, score, topics, quote, token_count."""
    a = table(spark, d, "annotations").select(
        "chunk_id", F.try_to_timestamp("created_at").alias("created"), F.upper(F.trim("ticker")).alias("ticker"), "issuer", "source_type",
        F.col("fiscal_quarter").alias("quarter"), F.col("td_fiscal_quarter_hint").alias("hint"), "section", F.col("speaker.role").alias("role"), F.to_date(F.substring("date", 1, 10)).alias("date"),
        F.col("output.sentiment").alias("sentiment"), F.col("output.sentiment_score").alias("score"), F.col("output.topics").alias("topics"), F.col("output.key_quote").alias("quote"), "token_count",
    )
    a = a.where(F.col("score").isNotNull() & ~F.isnan("score"))
    a = a.withColumn("tie", F.concat_ws("|", "topics"))
    return latest_row(a, ["chunk_id"], ["created", "date", "score", "tie"]).drop("created", "tie")


NOTES = """notes AS (SELECT chunk_id, upper(trim(ticker)) AS ticker, issuer, source_type, fiscal_quarter AS quarter, td_fiscal_quarter_hint AS hint, section, speaker.role AS role,
  CAST(substr(date, 1, 10) AS DATE) AS date, output.sentiment AS sentiment, output.sentiment_score AS score, output.topics AS topics, output.key_quote AS quote, token_count
  FROM annotations WHERE output.sentiment_score IS NOT NULL AND NOT isnan(output.sentiment_score)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, substr(date, 1, 10) DESC, output.sentiment_score DESC, coalesce(array_to_string(output.topics, '|'), '') DESC) = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
