"""Ordered time-series queries over prices, macro series and calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import band, decay, row_mean, row_std
from tidemark.operators.asof import around, asof, exact_then_fill, in_interval
from tidemark.operators.rolling import Series, adjusted, average_rank, by_entity, latest_row, technical, trend
from tidemark.operators.trailing import trailing, windows_of_rows
from tidemark.plans.base import BARS, MARKET, NOTES, TICKER, annotations, bars, macro, macro_sql, market, with_
from tidemark.session import table

W = "OVER (PARTITION BY ticker ORDER BY date)"


def _w(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


def _full(agg: str, c: str, n: int) -> str:
    """SQL of an aggregate of c over n rows that must all be there."""
    return f"CASE WHEN count({c}) {_w(n)} = {n} THEN {agg}({c}) {_w(n)} END"


def _change(c: str, n: int) -> str:
    return f"{c} / nullif(lag({c}, {n}) {W}, 0) - 1"


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


def _tech(spark: SparkSession, d: str) -> DataFrame:
    return technical(by_entity(adjusted(bars(spark, d)), TICKER), TICKER)


def _pick(*names: str):  # noqa: ANN202
    def q(spark: SparkSession, d: str) -> DataFrame:
        return _tech(spark, d).select("ticker", "date", *[r6(n) for n in names])

    return q


def _r(*cols: tuple[str, str]) -> str:
    return ", ".join(f"round({e}, 6) AS {n}" for e, n in cols)


ADJ = """adj AS (SELECT ticker, date, adj_close AS close, high * coalesce(adj_close / nullif(close, 0), 1) AS high, low * coalesce(adj_close / nullif(close, 0), 1) AS low,
  CAST(volume AS DOUBLE) AS volume FROM bars)"""
RET = f"ret AS (SELECT *, {_change('close', 1)} AS r, {_change('volume', 1)} AS vc, close - lag(close) {W} AS d FROM adj)"
BASE = with_(BARS, ADJ, RET)


def returns(spark: SparkSession, d: str) -> DataFrame:
    s = TICKER
    b = bars(spark, d)
    return b.select("ticker", "date", *[F.round(s.change("adj_close", n), 6).alias(f"return_{n}d") for n in (1, 5, 20)])


def forward_return(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select("ticker", "date", F.round(TICKER.forward_change("adj_close", 5), 6).alias("forward_5d"))


def lag_diff(spark: SparkSession, d: str) -> DataFrame:
    s = TICKER
    return bars(spark, d).select("ticker", "date", F.round(s.diff("adj_close"), 6).alias("diff_1"), F.round(s.diff("adj_close", 5), 6).alias("diff_5"), s.lag("adj_close", 2).alias("lag_2"), s.number().cast("long").alias("n"))


def rolling_stats(spark: SparkSession, d: str) -> DataFrame:
    s = TICKER
    cols = [F.round(f("open", w), 6).alias(f"{n}_{w}") for w in (5, 14, 20) for n, f in (("mean", s.mean), ("std", s.std), ("min", s.min), ("max", s.max), ("sum", s.sum))]
    return bars(spark, d).select("ticker", "date", *cols, F.round(s.cumulative_mean("open") + 1e-10, 6).alias("cum_mean"), F.round(s.mean_before("open", 4), 6).alias("mean_before_4"))


def ols_trend(spark: SparkSession, d: str) -> DataFrame:
    x = trend(by_entity(bars(spark, d), TICKER), TICKER, "adj_close", (5, 20, 60))
    return x.select("ticker", "date", *[r6(f"{k}_{w}d") for w in (5, 20, 60) for k in ("beta", "rsqr", "resi")])


def _ols_sql(w: int) -> str:
    f = _w(w)
    ok = f"count(adj_close) {f} = {w} AND first_value(adj_close) {f} <> 0"
    y0 = f"first_value(adj_close) {f}"
    b = f"regr_slope(adj_close, t) {f} / {y0}"
    return (
        f"CASE WHEN {ok} THEN round({b}, 6) END AS beta_{w}d, "
        f"CASE WHEN {ok} THEN round(CASE WHEN regr_syy(adj_close, t) {f} / ({y0} * {y0}) > 1e-12 THEN power(regr_sxy(adj_close, t) {f}, 2) / (regr_sxx(adj_close, t) {f} * regr_syy(adj_close, t) {f}) ELSE 0 END, 6) END AS rsqr_{w}d, "
        f"CASE WHEN {ok} THEN round(adj_close / {y0} - (avg(adj_close) {f} / {y0} + {b} * {(w - 1) / 2}), 6) END AS resi_{w}d"
    )


OLS_SQL = with_(BARS, f"t AS (SELECT *, CAST(row_number() {W} AS DOUBLE) AS t FROM bars)") + "SELECT ticker, date, " + ", ".join(map(_ols_sql, (5, 20, 60))) + " FROM t"


def _excess(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).select("ticker", "date", "adj_close")
    s = Series([], ["date"])
    m = market(b.withColumn("volume", F.lit(1)))
    m = m.select("date", s.forward_change("market_close", 5).alias("market_5d"), s.change("market_close", 5).alias("market_back"))
    x = b.select("ticker", "date", TICKER.forward_change("adj_close", 5).alias("own_5d"), TICKER.change("adj_close", 5).alias("own_back"))
    # a row a calendar day
    x = x.join(F.broadcast(m), on="date", how="left")
    return x.withColumn("excess_5d", F.col("own_5d") - F.col("market_5d")).withColumn("momentum", F.col("own_back") - F.col("market_back"))


def excess_target(spark: SparkSession, d: str) -> DataFrame:
    """Five-day excess return over the market and its class by bands of 0.5 %."""
    x = _excess(spark, d).where("excess_5d is not null")
    return x.select("ticker", "date", r6("excess_5d"), band(F.round("excess_5d", 6), 0.005).alias("label"), r6("momentum"))


EXCESS = with_(
    BARS, MARKET,
    "m AS (SELECT date, lead(market_close, 5) OVER (ORDER BY date) / nullif(market_close, 0) - 1 AS market_5d, market_close / nullif(lag(market_close, 5) OVER (ORDER BY date), 0) - 1 AS market_back FROM market)",
    f"x AS (SELECT ticker, b.date, lead(adj_close, 5) OVER (PARTITION BY ticker ORDER BY b.date) / nullif(adj_close, 0) - 1 - market_5d AS excess_5d, "
    "adj_close / nullif(lag(adj_close, 5) OVER (PARTITION BY ticker ORDER BY b.date), 0) - 1 - market_back AS momentum FROM bars b LEFT JOIN m ON m.date = b.date)",
)
EXCESS_SQL = EXCESS + """SELECT ticker, date, round(excess_5d, 6) AS excess_5d, CASE WHEN round(excess_5d, 6) > 0.005 THEN 1 WHEN round(excess_5d, 6) < -0.005 THEN -1 ELSE 0 END AS label, round(momentum, 6) AS momentum
FROM x WHERE excess_5d IS NOT NULL"""


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return excess_target(spark, d).groupBy("label").agg(F.count("*").alias("n"))


LABEL_SQL = EXCESS + "SELECT CASE WHEN round(excess_5d, 6) > 0.005 THEN 1 WHEN round(excess_5d, 6) < -0.005 THEN -1 ELSE 0 END AS label, count(*) AS n FROM x WHERE excess_5d IS NOT NULL GROUP BY 1"


def excess_momentum_rank(spark: SparkSession, d: str) -> DataFrame:
    """Average rank of the five-day momentum among the tickers of a date, the strongest first."""
    x = _excess(spark, d).where("momentum is not null").select("ticker", "date", r6("momentum"))
    return x.select("ticker", "date", average_rank("momentum", ["date"], descending=True).alias("rank"))


RANK_SQL = EXCESS + """, y AS (SELECT ticker, date, round(momentum, 6) AS momentum FROM x WHERE momentum IS NOT NULL)
SELECT ticker, date, rank() OVER (PARTITION BY date ORDER BY momentum DESC) + (count(*) OVER (PARTITION BY date, momentum) - 1) / 2.0 AS rank FROM y"""


# macro series onto the spine of trading dates ------------------------------------------------------------------
def _spine(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select("date").distinct()


SPINE = "spine AS (SELECT DISTINCT date FROM bars)"
DAY = Series([], ["date"])


def _on_spine(spark: SparkSession, d: str, names: dict[str, str]) -> DataFrame:
    x = _spine(spark, d)
    for series, name in names.items():
        x = exact_then_fill(x, macro(spark, d, series).withColumnRenamed("value", name), entity=[], date="date", columns=[name])
    return x


def _on_spine_sql(names: dict[str, str]) -> list[str]:
    fills = ", ".join(f"last_value({s}.value IGNORE NULLS) OVER (ORDER BY spine.date ROWS UNBOUNDED PRECEDING) AS {n}" for s, n in names.items())
    joins = " ".join(f"LEFT JOIN {s} ON {s}.date = spine.date" for s in names)
    return [BARS, SPINE, *map(macro_sql, names), f"m AS (SELECT spine.date, {fills} FROM spine {joins})"]


def fx_block(spark: SparkSession, d: str) -> DataFrame:
    x = _on_spine(spark, d, {"fx_usdcad": "fx_level"}).withColumn("r", DAY.change("fx_level"))
    return x.select("date", "fx_level", F.round(DAY.change("fx_level", 5), 6).alias("fx_return_5d"), F.round(DAY.std("r", 20), 6).alias("fx_volatility_20d"))


FX_SQL = with_(*_on_spine_sql({"fx_usdcad": "fx_level"}), "n AS (SELECT *, fx_level / nullif(lag(fx_level) OVER (ORDER BY date), 0) - 1 AS r FROM m)") + """
SELECT date, fx_level, round(fx_level / nullif(lag(fx_level, 5) OVER (ORDER BY date), 0) - 1, 6) AS fx_return_5d,
  round(CASE WHEN count(r) OVER (ORDER BY date ROWS 19 PRECEDING) = 20 THEN stddev_samp(r) OVER (ORDER BY date ROWS 19 PRECEDING) END, 6) AS fx_volatility_20d FROM n"""


def fear_block(spark: SparkSession, d: str) -> DataFrame:
    x = _on_spine(spark, d, {"vix": "vix_level"}).withColumn("r", DAY.change("vix_level"))
    return x.select("date", "vix_level", F.round(DAY.change("vix_level", 5), 6).alias("vix_return_5d"), F.round(DAY.std("r", 20), 6).alias("vix_volatility_20d"))


FEAR_SQL = FX_SQL.replace("fx_usdcad", "vix").replace("fx_", "vix_")


def rates_block(spark: SparkSession, d: str) -> DataFrame:
    x = _on_spine(spark, d, {"overnight_avg": "overnight", "goc_2y": "y2", "goc_10y": "y10"}).withColumn("slope", F.col("y10") - F.col("y2"))
    return x.select("date", "overnight", F.round(DAY.diff("overnight", 5), 6).alias("overnight_change_5d"), "y2", "y10", r6("slope"), F.round(DAY.diff("slope", 5), 6).alias("slope_change_5d"))


RATES_SQL = with_(*_on_spine_sql({"overnight_avg": "overnight", "goc_2y": "y2", "goc_10y": "y10"})) + """
SELECT date, overnight, round(overnight - lag(overnight, 5) OVER (ORDER BY date), 6) AS overnight_change_5d, y2, y10, round(y10 - y2, 6) AS slope,
  round((y10 - y2) - lag(y10 - y2, 5) OVER (ORDER BY date), 6) AS slope_change_5d FROM m"""


def cpi_block(spark: SparkSession, d: str) -> DataFrame:
    """Year-on-year change at monthly grain, then carried to days; stamps off the spine are lost."""
    m = macro(spark, d, "cpi_all_items").withColumn("cpi_yoy", DAY.change("value", 12)).withColumnRenamed("value", "cpi_level")
    x = exact_then_fill(_spine(spark, d), m, entity=[], date="date", columns=["cpi_level", "cpi_yoy"])
    return x.select("date", "cpi_level", r6("cpi_yoy"))


CPI_SQL = with_(BARS, SPINE, macro_sql("cpi_all_items"), "c AS (SELECT *, value / nullif(lag(value, 12) OVER (ORDER BY date), 0) - 1 AS yoy FROM cpi_all_items)") + """
SELECT spine.date, last_value(value IGNORE NULLS) OVER (ORDER BY spine.date ROWS UNBOUNDED PRECEDING) AS cpi_level,
  round(last_value(yoy IGNORE NULLS) OVER (ORDER BY spine.date ROWS UNBOUNDED PRECEDING), 6) AS cpi_yoy FROM spine LEFT JOIN c ON c.date = spine.date"""


# quarters and calls ---------------------------------------------------------------------------------------------
SCORES = ("transcript_ceo_prep_sentiment_mean", "report_sentiment_mean", "topic_entropy")
ISSUER_CALL = Series(["issuer"], ["call_date"])


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    """Last version of each issuer's quarter, with its call date, framing gap, deltas and surprises."""
    q = table(spark, d, "nlp_quarterly").select("issuer", "fiscal_quarter", "version", *SCORES).distinct()
    q = latest_row(q, ["issuer", "fiscal_quarter"], ["version"]).drop("version")
    q = q.join(table(spark, d, "call_dates"), on=["issuer", "fiscal_quarter"]).withColumn("framing_gap", F.col(SCORES[0]) - F.col(SCORES[1]))
    s = ISSUER_CALL
    cols = [*SCORES, "framing_gap"]
    return q.select("*", *[s.diff(c).alias(f"{c}_delta") for c in cols], *[(F.col(c) - s.mean_before(c, 4)).alias(f"{c}_surprise") for c in cols])


def delta_surprise(spark: SparkSession, d: str) -> DataFrame:
    q = _quarters(spark, d)
    return q.select("issuer", "fiscal_quarter", "call_date", *[F.round(c, 6).alias(c) for c in q.columns if c not in ("issuer", "fiscal_quarter", "call_date")])


_QCOLS = [*SCORES, "framing_gap"]
QUARTERS = ", ".join([
    f"latest AS (SELECT issuer, fiscal_quarter, {', '.join(SCORES)} FROM nlp_quarterly QUALIFY row_number() OVER (PARTITION BY issuer, fiscal_quarter ORDER BY version DESC, {SCORES[0]} DESC NULLS LAST) = 1)",
    f"called AS (SELECT l.*, c.call_date, {SCORES[0]} - {SCORES[1]} AS framing_gap FROM latest l JOIN call_dates c USING (issuer, fiscal_quarter))",
    "quarters AS (SELECT *, " + ", ".join(
        f"{c} - lag({c}) OVER w AS {c}_delta, {c} - avg({c}) OVER (PARTITION BY issuer ORDER BY call_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS {c}_surprise" for c in _QCOLS
    ) + " FROM called WINDOW w AS (PARTITION BY issuer ORDER BY call_date))",
])
DELTA_SQL = f"WITH {QUARTERS} SELECT issuer, fiscal_quarter, call_date, " + ", ".join(f"round({c}{s}, 6) AS {c}{s}" for c in _QCOLS for s in ("", "_delta", "_surprise")) + " FROM quarters"


def _days(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).select("ticker", "issuer", "date")


def asof_quarter(spark: SparkSession, d: str) -> DataFrame:
    """Each ticker's day with its issuer's quarterly values, column by column the last known one, and the days since the call."""
    q = _quarters(spark, d)
    cols = [*_QCOLS, "framing_gap_delta", "framing_gap_surprise"]
    x = asof(_days(spark, d), q, entity=["issuer"], date="date", fact_date="call_date", columns=cols, distance="days_since_call")
    week = F.coalesce((F.col("days_since_call") <= 5).cast("int"), F.lit(0)).alias("is_earnings_week")
    return x.select("ticker", "date", *[F.round(c, 6).alias(c) for c in cols], "days_since_call", week)


ASOF_SQL = f"WITH {QUARTERS}, {BARS}, " + """
line AS (SELECT issuer, call_date AS date, 0 AS o, NULL AS ticker, call_date, """ + ", ".join([*_QCOLS, "framing_gap_delta", "framing_gap_surprise"]) + """ FROM quarters
  UNION ALL SELECT issuer, date, 1, ticker, NULL, """ + ", ".join(["NULL"] * 6) + """ FROM bars),
seen AS (SELECT ticker, date, o, """ + ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in [*_QCOLS, "framing_gap_delta", "framing_gap_surprise"]) + """,
  date - last_value(call_date IGNORE NULLS) OVER w AS days FROM line WINDOW w AS (PARTITION BY issuer ORDER BY date, o ROWS UNBOUNDED PRECEDING))
SELECT ticker, date, """ + ", ".join(f"round({c}, 6) AS {c}" for c in [*_QCOLS, "framing_gap_delta", "framing_gap_surprise"]) + """,
  CAST(days AS INTEGER) AS days_since_call, CAST(coalesce(days <= 5, false) AS INTEGER) AS is_earnings_week FROM seen WHERE o = 1"""


def intercall_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per issuer's interval between calls: trading days, highest and lowest close."""
    b = bars(spark, d).select("issuer", "date", "adj_close")
    x = in_interval(b, table(spark, d, "call_dates"), entity=["issuer"], date="date", start="call_date", columns=["fiscal_quarter"])
    return x.groupBy("issuer", "fiscal_quarter", "call_date").agg(F.countDistinct("date").alias("n_days"), F.count("*").alias("n_rows"), F.max("adj_close").alias("high"), F.min("adj_close").alias("low"))


INTERCALL_SQL = f"WITH {BARS}, " + """iv AS (SELECT *, lead(call_date) OVER (PARTITION BY issuer ORDER BY call_date) AS nxt FROM call_dates)
SELECT b.issuer, fiscal_quarter, call_date, count(DISTINCT date) AS n_days, count(*) AS n_rows, max(adj_close) AS high, min(adj_close) AS low
FROM bars b JOIN iv ON iv.issuer = b.issuer AND b.date >= call_date AND (nxt IS NULL OR b.date < nxt) GROUP BY ALL"""


def around_calls(spark: SparkSession, d: str) -> DataFrame:
    """The issuer's trading day before each call and the first on or after it, with the middle close."""
    days = bars(spark, d).groupBy("issuer", "date").agg(F.max("adj_close").alias("top"))
    return around(days, table(spark, d, "call_dates").select("issuer", "call_date"), entity=["issuer"], date="date", event_date="call_date", columns=["top"])


AROUND_SQL = f"WITH {BARS}, days AS (SELECT issuer, date, max(adj_close) AS top FROM bars GROUP BY ALL) " + """
SELECT c.issuer, c.call_date, p.date AS prev_date, p.top AS prev_top, n.date AS next_date, n.top AS next_top FROM call_dates c
LEFT JOIN (SELECT c.issuer, c.call_date, max(d.date) AS date, max_by(d.top, d.date) AS top FROM call_dates c JOIN days d ON d.issuer = c.issuer AND d.date < c.call_date GROUP BY ALL) p ON p.issuer = c.issuer AND p.call_date = c.call_date
LEFT JOIN (SELECT c.issuer, c.call_date, min(d.date) AS date, min_by(d.top, d.date) AS top FROM call_dates c JOIN days d ON d.issuer = c.issuer AND d.date >= c.call_date GROUP BY ALL) n ON n.issuer = c.issuer AND n.call_date = c.call_date"""


def news_windows(spark: SparkSession, d: str) -> DataFrame:
    """News of the last 7 and 30 days (both ends in), days since the last and the burst flag, per ticker and trading day."""
    n = annotations(spark, d).where("source_type = 'news'").select("ticker", "date", "score")
    days = bars(spark, d).select("ticker", "date")
    t = trailing(n, days, entity="ticker", date="date", value="score", periods=(7, 30))
    since = asof(days, n.select("ticker", F.col("date").alias("on")).distinct(), entity=["ticker"], date="date", fact_date="on", columns=[], distance="days_since_last_news")
    x = windows_of_rows(since, t, entity="ticker", date="date")
    return x.select("ticker", "date", F.col("count_7").alias("news_count_7d"), F.col("count_30").alias("news_count_30d"), F.round(F.col("mean_30") + 1e-10, 6).alias("news_sent_mean_30d"), "days_since_last_news", (F.col("count_7") > 10).cast("int").alias("is_news_burst"))


NEWS_SQL = with_(BARS, NOTES, "news AS (SELECT * FROM notes WHERE source_type = 'news')") + """
SELECT b.ticker, b.date, count(n.score) FILTER (n.date >= b.date - 7) AS news_count_7d, count(n.score) FILTER (n.date >= b.date - 30) AS news_count_30d,
  round(coalesce(avg(n.score) FILTER (n.date >= b.date - 30), 0) + 1e-10, 6) AS news_sent_mean_30d, CAST(b.date - max(n.date) AS INTEGER) AS days_since_last_news,
  CAST(count(n.score) FILTER (n.date >= b.date - 7) > 10 AS INTEGER) AS is_news_burst FROM bars b LEFT JOIN news n ON n.ticker = b.ticker AND n.date <= b.date GROUP BY b.ticker, b.date"""


def event_decay(spark: SparkSession, d: str) -> DataFrame:
    """Signals that fade with the days since the call or the last news; sentinels are missing values on the way in and out."""
    m = table(spark, d, "model_features_daily").select("row_id", "framing_gap_ffill", "days_since_call", "transcript_ceo_prep_sentiment_mean_ffill", "transcript_ceo_prep_sentiment_mean_delta", "news_count_30d", "days_since_last_news", "report_sentiment_mean_ffill")
    x = m.select("row_id", "days_since_call", *[F.nullif(F.nanvl(c, F.lit(None).cast("double")), F.lit(-9999.0)).alias(c) for c in ("framing_gap_ffill", "transcript_ceo_prep_sentiment_mean_ffill", "transcript_ceo_prep_sentiment_mean_delta", "days_since_last_news", "report_sentiment_mean_ffill")], "news_count_30d")
    call, news = decay(F.col("days_since_call"), 20.0), decay(F.col("days_since_last_news"), 15.0)
    tone = [F.col("transcript_ceo_prep_sentiment_mean_ffill"), F.col("report_sentiment_mean_ffill")]
    return x.select(
        "row_id", F.round(F.col("framing_gap_ffill") * call, 6).alias("evt_framing_gap"), F.round(F.abs("transcript_ceo_prep_sentiment_mean_delta") * call, 6).alias("evt_shift"),
        F.round(F.log1p(F.col("news_count_30d").cast("double")) * news, 6).alias("evt_news_flow"), F.round(row_mean(*tone), 6).alias("tone_mean"), F.round(row_std(*tone), 6).alias("tone_std"),
        F.coalesce(F.round("transcript_ceo_prep_sentiment_mean_delta", 6), F.lit(-9999.0)).alias("delta_or_sentinel"),
    )


EVENT_SQL = """WITH x AS (SELECT row_id, days_since_call, news_count_30d, """ + ", ".join(f"nullif(CASE WHEN NOT isnan({c}) THEN {c} END, -9999) AS {n}" for c, n in (("framing_gap_ffill", "gap"), ("transcript_ceo_prep_sentiment_mean_ffill", "ceo"), ("transcript_ceo_prep_sentiment_mean_delta", "delta"), ("days_since_last_news", "news"), ("report_sentiment_mean_ffill", "report"))) + """ FROM model_features_daily)
SELECT row_id, round(gap * exp(-greatest(coalesce(days_since_call, 999), 0) / 20.0), 6) AS evt_framing_gap, round(abs(delta) * exp(-greatest(coalesce(days_since_call, 999), 0) / 20.0), 6) AS evt_shift,
  round(ln(1 + CAST(news_count_30d AS DOUBLE)) * exp(-greatest(coalesce(news, 999), 0) / 15.0), 6) AS evt_news_flow,
  round(CASE WHEN ceo IS NULL THEN report WHEN report IS NULL THEN ceo ELSE (ceo + report) / 2 END, 6) AS tone_mean, round(abs(ceo - report) / sqrt(2), 6) AS tone_std, coalesce(round(delta, 6), -9999.0) AS delta_or_sentinel FROM x"""


def near_calls(spark: SparkSession, d: str) -> DataFrame:
    """Trading days within three calendar days of a call of their issuer."""
    days = _days(spark, d).select("issuer", "date").distinct()
    c = table(spark, d, "call_dates").select("issuer", "call_date", F.explode(F.sequence(F.date_sub("call_date", 3), F.date_add("call_date", 3))).alias("date"))
    return days.join(c, on=["issuer", "date"]).select("issuer", "date", "call_date")


NEAR_SQL = f"WITH {BARS} SELECT DISTINCT b.issuer, b.date, c.call_date FROM bars b JOIN call_dates c ON c.issuer = b.issuer AND b.date BETWEEN c.call_date - 3 AND c.call_date + 3"

_V20 = _full("avg", "volume", 20)
QUERIES = {
    "returns": returns,
    "forward_return": forward_return,
    "lag_diff": lag_diff,
    "rolling_stats": rolling_stats,
    "volatility_zscore": _pick("volatility_20d", "volume_zscore_20d"),
    "volume_changes": _pick("volume_change_1d", "volume_change_5d", "volume_change_20d"),
    "corr_pv": _pick("corr_pv_5d", "corr_pv_20d"),
    "wvma_cntd_sumd": _pick("wvma_5d", "wvma_20d", "cntd_5d", "cntd_20d", "sumd_5d", "sumd_20d"),
    "rsv_rsi_boll": _pick("rsv_5d", "rsv_14d", "rsv_20d", "rsi_14", "bb_position"),
    "dist_high": _pick("dist_52w_high"),
    "ols_trend": ols_trend,
    "excess_target": excess_target,
    "label_distribution": label_distribution,
    "momentum_rank": excess_momentum_rank,
    "fx_block": fx_block,
    "fear_block": fear_block,
    "rates_block": rates_block,
    "cpi_block": cpi_block,
    "delta_surprise": delta_surprise,
    "asof_quarter": asof_quarter,
    "intercall_stats": intercall_stats,
    "around_calls": around_calls,
    "near_calls": near_calls,
    "news_windows": news_windows,
    "event_decay": event_decay,
}


def _corr_sql(w: int) -> str:
    f = _w(w)
    return f"CASE WHEN count(CASE WHEN r IS NOT NULL AND vc IS NOT NULL THEN 1 END) {f} = {w} THEN covar_pop(r, vc) {f} / nullif(stddev_pop(r) {f} * stddev_pop(vc) {f}, 0) END"


_ACT = "act AS (SELECT *, abs(r) * coalesce(volume / nullif(" + _V20 + ", 0), 1) AS active, CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END AS up, CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END AS dn, greatest(r, r * 0) AS pos, greatest(-r, r * 0) AS neg, abs(r) AS ab FROM ret)"
_RSI = "osc AS (SELECT *, greatest(d, d * 0) AS gain, greatest(-d, d * 0) AS loss FROM ret)"


def _rsv(w: int) -> tuple[str, str]:
    lo, hi = _full("min", "low", w), _full("max", "high", w)
    return f"coalesce((close - {lo}) / (nullif({hi} - {lo}, 0) + 1e-12), 0.5)", f"rsv_{w}d"


ORACLE = {
    "returns": with_(BARS) + "SELECT ticker, date, " + _r(*[(_change("adj_close", n), f"return_{n}d") for n in (1, 5, 20)]) + " FROM bars",
    "forward_return": with_(BARS) + f"SELECT ticker, date, round(lead(adj_close, 5) {W} / nullif(adj_close, 0) - 1, 6) AS forward_5d FROM bars",
    "lag_diff": with_(BARS) + f"SELECT ticker, date, round(adj_close - lag(adj_close) {W}, 6) AS diff_1, round(adj_close - lag(adj_close, 5) {W}, 6) AS diff_5, lag(adj_close, 2) {W} AS lag_2, row_number() {W} AS n FROM bars",
    "rolling_stats": with_(BARS) + "SELECT ticker, date, " + _r(*[(_full(f, "open", w), f"{n}_{w}") for w in (5, 14, 20) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("sum", "sum"))])
    + ", round(avg(open) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) + 1e-10, 6) AS cum_mean, round(avg(open) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS mean_before_4 FROM bars",
    "volatility_zscore": BASE + "SELECT ticker, date, " + _r((_full("stddev_samp", "r", 20), "volatility_20d"), (f"(volume - {_full('avg', 'volume', 20)}) / nullif({_full('stddev_samp', 'volume', 20)}, 0)", "volume_zscore_20d")) + " FROM ret",
    "volume_changes": with_(BARS, ADJ, RET, f"v AS (SELECT *, {_full('avg', 'volume', 5)} AS v5, {_V20} AS v20 FROM ret)") + "SELECT ticker, date, " + _r(("vc", "volume_change_1d"), (_change("v5", 5), "volume_change_5d"), (f"coalesce({_change('v20', 20)}, 0)", "volume_change_20d")) + " FROM v",
    "corr_pv": BASE + "SELECT ticker, date, " + _r((_corr_sql(5), "corr_pv_5d"), (_corr_sql(20), "corr_pv_20d")) + " FROM ret",
    "wvma_cntd_sumd": with_(BARS, ADJ, RET, _ACT) + "SELECT ticker, date, " + _r(*[x for w in (5, 20) for x in (
        (f"coalesce({_full('stddev_samp', 'active', w)} / ({_full('avg', 'active', w)} + 1e-12), 0)", f"wvma_{w}d"), (f"{_full('avg', 'up', w)} - {_full('avg', 'dn', w)}", f"cntd_{w}d"),
        (f"({_full('sum', 'pos', w)} - {_full('sum', 'neg', w)}) / ({_full('sum', 'ab', w)} + 1e-12)", f"sumd_{w}d"))]) + " FROM act",
    "rsv_rsi_boll": with_(BARS, ADJ, RET, _RSI) + "SELECT ticker, date, " + _r(_rsv(5), _rsv(14), _rsv(20),
        (f"coalesce(100 - 100 / nullif(1 + {_full('avg', 'gain', 14)} / nullif({_full('avg', 'loss', 14)}, 0), 0), 50)", "rsi_14"),
        (f"coalesce((close - {_full('avg', 'close', 20)}) / nullif(2 * {_full('stddev_samp', 'close', 20)}, 0), 0)", "bb_position")) + " FROM osc",
    "dist_high": BASE + "SELECT ticker, date, " + _r((f"coalesce((close - {_full('max', 'close', 252)}) / nullif({_full('max', 'close', 252)}, 0), 0)", "dist_52w_high")) + " FROM ret",
    "ols_trend": OLS_SQL,
    "excess_target": EXCESS_SQL,
    "label_distribution": LABEL_SQL,
    "momentum_rank": RANK_SQL,
    "fx_block": FX_SQL,
    "fear_block": FEAR_SQL,
    "rates_block": RATES_SQL,
    "cpi_block": CPI_SQL,
    "delta_surprise": DELTA_SQL,
    "asof_quarter": ASOF_SQL,
    "intercall_stats": INTERCALL_SQL,
    "around_calls": AROUND_SQL,
    "near_calls": NEAR_SQL,
    "news_windows": NEWS_SQL,
    "event_decay": EVENT_SQL,
}
