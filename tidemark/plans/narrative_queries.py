"""Queries over nested annotations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import content_key, quarter_of
from tidemark.operators.narrative import agreement, conditional_means, counts_over, extreme_quotes, label_table, quarterly, shares_by_row, stratified
from tidemark.operators.features import project_daily, with_changes
from tidemark.operators.ranks import quantiles
from tidemark.operators.rolling import Series
from tidemark.plans.base import BARS, NOTES, annotations, bars, with_
from tidemark.plans.market_queries import NEWS_SQL, news_windows
from tidemark.session import table

CUTOFF = "FY2026Q1"

#: The labels that occur in the annotations at hand.
TOPICS = ("margins", "credit_quality", "capital", "wealth", "insurance", "regulatory_AML", "macro", "expenses", "guidance", "mergers", "technology", "other")


def notes_with_quarter(spark: SparkSession, d: str) -> DataFrame:
    return annotations(spark, d).withColumn("quarter", quarter_of(F.col("quarter"), F.col("hint")))


_Q = "CASE WHEN regexp_full_match({0}, 'FY[0-9]{{4}}-?Q[1-4]') THEN replace({0}, '-', '') END"
QNOTES = NOTES + f", qnotes AS (SELECT * REPLACE (coalesce({_Q.format('quarter')}, {_Q.format('hint')}) AS quarter) FROM notes)"


def _six(df: DataFrame, *keys: str) -> DataFrame:
    return df.selectExpr(*[f"round(`{c}` + 1e-10D, 6) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes])


def quarterly_nlp(spark: SparkSession, d: str) -> DataFrame:
    return _six(quarterly(notes_with_quarter(spark, d), ["issuer", "quarter"], CUTOFF, TOPICS))


def _mean(cond: str) -> str:
    return f"round(avg(score) FILTER ({cond}) + 1e-10, 6)"


_NAMED = {
    "transcript_ceo_prep_sentiment_mean": "source_type = 'transcripts' AND section = 'prepared_remarks' AND role = 'ceo'",
    "transcript_cfo_prep_sentiment_mean": "source_type = 'transcripts' AND section = 'prepared_remarks' AND role = 'cfo'",
    "transcript_exec_qa_sentiment_mean": "source_type = 'transcripts' AND section = 'qa' AND role IN ('ceo', 'cfo', 'other_exec')",
    "transcript_analyst_qa_sentiment_mean": "source_type = 'transcripts' AND section = 'qa' AND role = 'analyst'",
    "news_sentiment_mean": "source_type = 'news'",
    "report_40f_sentiment_mean": "source_type = 'reports_40f'",
    "report_quarterly_sentiment_mean": "source_type = 'reports_quarterly'",
}


def _mentions(t: str) -> str:
    return f"coalesce(len(list_filter(topics, lambda x: x = '{t}')), 0)"


def _topic_sql(t: str) -> str:
    m = _mentions(t)
    return f"round(round_even(CAST(sum({m}) AS DOUBLE) / count(*), 4) + 1e-10, 6) AS \"topic_{t}_share\", round(CAST(sum({m} * score) AS DOUBLE) / nullif(sum({m}), 0) + 1e-10, 6) AS \"topic_{t}_sentiment\""


_TOTAL = " + ".join(f"sum({_mentions(t)})" for t in TOPICS if t != "other")
_ENTROPY = " + ".join(f"CASE WHEN sum({_mentions(t)}) > 0 THEN -(sum({_mentions(t)}) / CAST({_TOTAL} AS DOUBLE)) * log2(sum({_mentions(t)}) / CAST({_TOTAL} AS DOUBLE)) ELSE 0 END" for t in TOPICS if t != "other")
_ENTROPY = f"round(CASE WHEN {_TOTAL} > 0 THEN round_even({_ENTROPY}, 4) ELSE 0.0 END + 1e-10, 6) AS topic_entropy"

QUARTERLY_SQL = with_(QNOTES) + "SELECT issuer, quarter, count(*) AS n_chunks_annotated, " + ", ".join(f"{_mean(c)} AS {k}" for k, c in _NAMED.items()) + f""",
  round(CASE WHEN count(*) FILTER (source_type = 'transcripts') > 1 THEN stddev_pop(score) FILTER (source_type = 'transcripts') END + 1e-10, 6) AS transcript_sentiment_std,
  round(coalesce(avg(score) FILTER (source_type = 'reports_quarterly'), avg(score) FILTER (source_type = 'reports_40f')) + 1e-10, 6) AS report_sentiment_mean,
  round(avg(score) FILTER ({_NAMED['transcript_ceo_prep_sentiment_mean']}) - coalesce(avg(score) FILTER (source_type = 'reports_quarterly'), avg(score) FILTER (source_type = 'reports_40f')) + 1e-10, 6) AS framing_gap,
  {", ".join(map(_topic_sql, TOPICS))}, {_ENTROPY} FROM qnotes WHERE quarter <= '{CUTOFF}' GROUP BY issuer, quarter"""


def topic_share(spark: SparkSession, d: str) -> DataFrame:
    """Shares, sentiments and entropy of topics by source."""
    return _six(conditional_means(notes_with_quarter(spark, d), ["source_type"], "score", {"mean": F.lit(True)}, "topics", TOPICS))


TOPIC_SQL = with_(QNOTES) + f"SELECT source_type, count(*) AS n, round(avg(score) + 1e-10, 6) AS mean, {', '.join(map(_topic_sql, TOPICS))}, {_ENTROPY} FROM qnotes GROUP BY source_type"


def topic_pivot(spark: SparkSession, d: str) -> DataFrame:
    return label_table(notes_with_quarter(spark, d).where("quarter is not null"), "quarter", "topics", TOPICS)


_PIVOT = ", ".join(f"CAST(sum({_mentions(t)}) AS BIGINT) AS \"{t}\"" for t in TOPICS)
PIVOT_SQL = with_(QNOTES) + f"SELECT quarter, {_PIVOT} FROM qnotes WHERE quarter IS NOT NULL AND len(topics) > 0 GROUP BY quarter"


def topic_row_share(spark: SparkSession, d: str) -> DataFrame:
    return _six(shares_by_row(topic_pivot(spark, d), TOPICS))


_SUMALL = " + ".join(f"\"{t}\"" for t in TOPICS)
ROW_SHARE_SQL = with_(QNOTES, f"p AS (SELECT quarter, {_PIVOT} FROM qnotes WHERE quarter IS NOT NULL AND len(topics) > 0 GROUP BY quarter)") + "SELECT quarter, " + ", ".join(f"round(\"{t}\" / CAST(nullif({_SUMALL}, 0) AS DOUBLE) + 1e-10, 6) AS \"{t}\"" for t in TOPICS) + " FROM p"

SOURCES = ("transcripts", "news", "reports_40f", "reports_quarterly")
LABELS = ("positive", "neutral", "negative")


def source_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    """Mean score by quarter, a column per source."""
    x = notes_with_quarter(spark, d).where("quarter is not null").groupBy("quarter").pivot("source_type", list(SOURCES)).agg(F.avg("score"))
    return _six(x)


SOURCE_SQL = with_(QNOTES) + "SELECT quarter, " + ", ".join(f"round(avg(score) FILTER (source_type = '{s}') + 1e-10, 6) AS {s}" for s in SOURCES) + " FROM qnotes WHERE quarter IS NOT NULL GROUP BY quarter"


def label_mix(spark: SparkSession, d: str) -> DataFrame:
    """Share of each label within a source."""
    x = notes_with_quarter(spark, d).groupBy("source_type").pivot("sentiment", list(LABELS)).count().na.fill(0)
    return _six(shares_by_row(x, LABELS))


LABEL_SQL = with_(QNOTES) + "SELECT source_type, " + ", ".join(f"round(count(*) FILTER (sentiment = '{s}') / CAST(nullif(count(*) FILTER (sentiment IN {LABELS}), 0) AS DOUBLE) + 1e-10, 6) AS {s}" for s in LABELS) + " FROM qnotes GROUP BY source_type"


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows per label, those that never occur included."""
    return counts_over(notes_with_quarter(spark, d), "sentiment", [*LABELS, "mixed"])


COUNTS_SQL = with_(QNOTES) + "SELECT l AS sentiment, count(n.chunk_id) AS n FROM (VALUES ('positive'), ('neutral'), ('negative'), ('mixed')) v(l) LEFT JOIN qnotes n ON n.sentiment = l GROUP BY l"


def topic_quotes(spark: SparkSession, d: str) -> DataFrame:
    return extreme_quotes(notes_with_quarter(spark, d), "topics", "score", "quote", "chunk_id")


QUOTES_SQL = with_(QNOTES, "t AS (SELECT DISTINCT chunk_id, score, quote, unnest(topics) AS label FROM qnotes)", "r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, chunk_id) AS lo, row_number() OVER (PARTITION BY label ORDER BY score DESC, chunk_id) AS hi FROM t)") + """
SELECT label, max(score) FILTER (lo = 1) AS low_score, max(quote) FILTER (lo = 1) AS low_quote, max(score) FILTER (hi = 1) AS high_score, max(quote) FILTER (hi = 1) AS high_quote FROM r WHERE label IS NOT NULL GROUP BY label"""


def annotator_agreement(spark: SparkSession, d: str) -> DataFrame:
    """First and last annotation of the same chunk as two annotators, by source."""
    a = table(spark, d, "annotations").select("chunk_id", "source_type", "created_at", F.col("output.sentiment_score").alias("score")).where("score is not null and not isnan(score)")
    first = a.groupBy("chunk_id", "source_type").agg(F.min(F.struct("created_at", "score")).alias("m"), F.max(F.struct("created_at", "score")).alias("n"))
    again = first.where("m.created_at < n.created_at")
    x = agreement(again.select("chunk_id", "source_type", F.col("m.score").alias("score")), again.select("chunk_id", F.col("n.score").alias("score")), "chunk_id", ["source_type"])
    return _six(x)


AGREE_SQL = """WITH a AS (SELECT chunk_id, source_type, created_at, output.sentiment_score AS score FROM annotations WHERE output.sentiment_score IS NOT NULL AND NOT isnan(output.sentiment_score)),
f AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, source_type ORDER BY created_at, score) AS i, row_number() OVER (PARTITION BY chunk_id, source_type ORDER BY created_at DESC, score DESC) AS j FROM a),
p AS (SELECT chunk_id, source_type, max(score) FILTER (i = 1) AS x, max(score) FILTER (j = 1) AS y FROM f GROUP BY ALL HAVING max(created_at) > min(created_at)),
s AS (SELECT *, CASE WHEN x > 0.05 THEN 1 WHEN x < -0.05 THEN -1 ELSE 0 END AS sx, CASE WHEN y > 0.05 THEN 1 WHEN y < -0.05 THEN -1 ELSE 0 END AS sy FROM p)
SELECT source_type, count(*) AS n, count(*) FILTER (sx <> 0 AND sy <> 0) AS n_signed, round(avg(CASE WHEN sx <> 0 AND sy <> 0 THEN CAST(sx = sy AS INTEGER) END) + 1e-10, 6) AS agreement,
  round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) + 1e-10, 6) AS r FROM s GROUP BY source_type"""


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median, deviation, range and share of positive scores by source, and the number of tickers."""
    n = notes_with_quarter(spark, d)
    x = n.groupBy("source_type").agg(
        F.count("*").alias("n"), F.countDistinct("ticker").alias("n_tickers"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"),
        F.min("score").alias("low"), F.max("score").alias("high"), F.avg((F.col("score") > 0).cast("int")).alias("positive"),
    )
    return _six(x.join(quantiles(n, ["source_type"], "score", {"median": 0.5, "p80": 0.8}), on="source_type"))


SUMMARY_SQL = with_(QNOTES) + """SELECT source_type, count(*) AS n, count(DISTINCT ticker) AS n_tickers, round(avg(score) + 1e-10, 6) AS mean, round(median(score) + 1e-10, 6) AS median, round(stddev_samp(score) + 1e-10, 6) AS sd,
  round(min(score) + 1e-10, 6) AS low, round(max(score) + 1e-10, 6) AS high, round(quantile_cont(score, 0.8) + 1e-10, 6) AS p80, round(avg(CAST(score > 0 AS INTEGER)) + 1e-10, 6) AS positive FROM qnotes GROUP BY source_type"""


def spot_check(spark: SparkSession, d: str) -> DataFrame:
    """Ten chunks of each source, picked by hash, with the beginning of their quote."""
    x = stratified(notes_with_quarter(spark, d), "source_type", "chunk_id", 10)
    return x.select("source_type", "chunk_id", F.substring(F.coalesce("quote", F.lit("")), 1, 80).alias("preview"))


SPOT_SQL = with_(QNOTES) + """SELECT source_type, chunk_id, substr(coalesce(quote, ''), 1, 80) AS preview FROM qnotes
QUALIFY row_number() OVER (PARTITION BY source_type ORDER BY md5('42|' || chunk_id), chunk_id) <= 10"""


def cache_miss(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content hasn't been annotated, as that of all news has: a key from text, prompt version and model, anti-joined with the keys there are."""
    docs = table(spark, d, "documents").select("doc_id", "source", content_key(F.col("text"), F.lit("v1"), F.lit("annotator-a")).alias("cache_key"))
    known = docs.where("source = 'news'").select("cache_key")
    return docs.join(known, on="cache_key", how="left_anti").select("doc_id", "cache_key")


MISS_SQL = """WITH k AS (SELECT doc_id, source, sha256(CAST(encode(text) || '\\x00'::BLOB || encode('v1') || '\\x00'::BLOB || encode('annotator-a') AS BLOB)) AS cache_key FROM documents)
SELECT doc_id, cache_key FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE source = 'news')"""

def _daily(spark: SparkSession, d: str) -> DataFrame:
    """Every ticker's trading day with the topic and sentiment features of its issuer's quarters as known by then, and its news of the last 30 days."""
    s = Series(["issuer"], ["call_date"])
    q = quarterly(notes_with_quarter(spark, d), ["issuer", "quarter"], None, TOPICS)
    cols = ["transcript_ceo_prep_sentiment_mean", "transcript_cfo_prep_sentiment_mean", "report_sentiment_mean", "framing_gap", "topic_entropy", *[f"topic_{t}_{k}" for t in TOPICS if t != "other" for k in ("share", "sentiment")]]
    calls = table(spark, d, "call_dates").select("issuer", F.col("fiscal_quarter").alias("quarter"), "call_date")
    q = with_changes(q.join(calls, on=["issuer", "quarter"]), s, cols)
    x = project_daily(bars(spark, d).select("ticker", "issuer", "date"), q, entity=["issuer"], date="date", known="call_date", columns=cols)
    return x.join(news_windows(spark, d), on=["ticker", "date"])


def quarterly_to_daily(spark: SparkSession, d: str) -> DataFrame:
    return _six(_daily(spark, d))


_KEPT = ("transcript_ceo_prep_sentiment_mean", "transcript_cfo_prep_sentiment_mean", "report_sentiment_mean", "framing_gap", "topic_entropy", *[f"topic_{t}_{k}" for t in TOPICS if t != "other" for k in ("share", "sentiment")])
_UNSIX = QUARTERLY_SQL.replace(" + 1e-10, 6)", ", 14)").replace(f"WHERE quarter <= '{CUTOFF}'", "WHERE quarter IS NOT NULL")
_DAILY = f"""WITH q AS ({_UNSIX}), c AS (SELECT q.*, call_date FROM q JOIN call_dates d ON d.issuer = q.issuer AND d.fiscal_quarter = q.quarter),
ch AS (SELECT issuer, call_date, """ + ", ".join(f'"{c}" AS "{c}_ffill", "{c}" - lag("{c}") OVER w AS "{c}_delta", "{c}" - avg("{c}") OVER (PARTITION BY issuer ORDER BY call_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS "{c}_surprise"' for c in _KEPT) + """ FROM c WINDOW w AS (PARTITION BY issuer ORDER BY call_date)),
""" + BARS + """, line AS (SELECT issuer, call_date AS date, 0 AS o, NULL AS ticker, call_date, """ + ", ".join(f'"{c}_{k}"' for c in _KEPT for k in ("ffill", "delta", "surprise")) + """ FROM ch
  UNION ALL SELECT issuer, date, 1, ticker, NULL, """ + ", ".join(["NULL"] * (3 * len(_KEPT))) + """ FROM bars),
seen AS (SELECT ticker, issuer, date, o, CAST(date - last_value(call_date IGNORE NULLS) OVER w AS INTEGER) AS days_since_call, """ + ", ".join(f'last_value("{c}_{k}" IGNORE NULLS) OVER w AS "{c}_{k}"' for c in _KEPT for k in ("ffill", "delta", "surprise")) + """
  FROM line WINDOW w AS (PARTITION BY issuer ORDER BY date, o ROWS UNBOUNDED PRECEDING)),
daily AS (SELECT s.* EXCLUDE (o), CAST(coalesce(days_since_call <= 5, false) AS INTEGER) AS is_earnings_week, n.* EXCLUDE (ticker, date) FROM seen s JOIN (""" + NEWS_SQL + """) n ON n.ticker = s.ticker AND n.date = s.date WHERE o = 1)
"""
DAILY_SQL = _DAILY + "SELECT ticker, issuer, date, days_since_call, is_earnings_week, news_count_7d, news_count_30d, days_since_last_news, is_news_burst, round(news_sent_mean_30d + 1e-10, 6) AS news_sent_mean_30d, " + ", ".join(f'round("{c}_{k}" + 1e-10, 6) AS "{c}_{k}"' for c in _KEPT for k in ("ffill", "delta", "surprise")) + " FROM daily"


QUERIES = {
    "quarterly_to_daily": quarterly_to_daily,
    "quarterly_nlp": quarterly_nlp,
    "topic_share": topic_share,
    "topic_pivot": topic_pivot,
    "topic_row_share": topic_row_share,
    "source_by_quarter": source_by_quarter,
    "label_mix": label_mix,
    "label_counts": label_counts,
    "topic_quotes": topic_quotes,
    "annotator_agreement": annotator_agreement,
    "score_summary": score_summary,
    "spot_check": spot_check,
    "cache_miss": cache_miss,
}

ORACLE = {
    "quarterly_to_daily": DAILY_SQL,
    "quarterly_nlp": QUARTERLY_SQL,
    "topic_share": TOPIC_SQL,
    "topic_pivot": PIVOT_SQL,
    "topic_row_share": ROW_SHARE_SQL,
    "source_by_quarter": SOURCE_SQL,
    "label_mix": LABEL_SQL,
    "label_counts": COUNTS_SQL,
    "topic_quotes": QUOTES_SQL,
    "annotator_agreement": AGREE_SQL,
    "score_summary": SUMMARY_SQL,
    "cache_miss": MISS_SQL,
    "spot_check": SPOT_SQL,
}
