"""The assembled daily matrix with all its blocks, its targets, its event signals and its lineage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import band
from tidemark.operators.features import EVENTS, event_signals, project_daily, with_changes
from tidemark.operators.narrative import quarterly
from tidemark.operators.rolling import Series, adjusted, by_entity, latest_row, technical, trend
from tidemark.operators.tables import feature_lineage, with_sentinel
from tidemark.operators.trailing import trailing, windows_of_rows
from tidemark.operators.asof import asof
from tidemark.plans import market_queries as mq
from tidemark.plans.evaluation_queries import FEATURES, feature_ranking
from tidemark.plans.base import BARS, TICKER, annotations, bars, with_
from tidemark.plans.narrative_queries import QNOTES, QUARTERLY_SQL, TOPICS, notes_with_quarter
from tidemark.session import table

DAY = Series([], ["date"])
CALLS = Series(["issuer"], ["call_date"])

#: Macro series and what their levels are called; a series that the table hasn't gives NULLs.
MACRO = {
    "fx_usdcad": "fx_usdcad_level", "overnight_avg": "rate_overnight_level", "goc_2y": "yield_2y_level", "goc_5y": "yield_5y_level", "goc_10y": "yield_10y_level",
    "vix": "vix_level", "gold": "gold_level", "dxy": "dxy_level", "cpi_all_items": "cpi_level",
}

#: Quarterly values that are projected to days, each with its change and surprise.
QUARTERLY = [
    "transcript_ceo_prep_sentiment_mean", "transcript_cfo_prep_sentiment_mean", "transcript_exec_qa_sentiment_mean", "transcript_analyst_qa_sentiment_mean", "transcript_sentiment_std",
    "news_sentiment_mean", "report_sentiment_mean", *[f"topic_{t}_{k}" for t in TOPICS for k in ("share", "sentiment")], "topic_entropy", "framing_gap",
]
TRENDS = [f"{k}_{w}d" for w in (5, 20, 60) for k in ("beta", "rsqr", "resi")]
TECHNICAL = [
    "return_1d", "return_5d", "return_20d", "volatility_20d", "volume_zscore_20d", "volume_change_1d", "volume_change_5d", "volume_change_20d", "corr_pv_5d", "corr_pv_20d", "wvma_5d", "wvma_20d",
    "cntd_5d", "cntd_20d", "sumd_5d", "sumd_20d", "rsv_5d", "rsv_14d", "rsv_20d", "rsi_14", "bb_position", "dist_52w_high",
]


def _benchmark(b: DataFrame, by: list[str], name: str) -> DataFrame:
    """The middle close and the whole volume of a group and day: returns over 1, 5, 20 days, five days ahead, and how unusual the volume is."""
    s = Series(by, ["date"])
    x = b.groupBy(*by, "date").agg(F.median("adj_close").alias("c"), F.sum("volume").cast("double").alias("v"))
    cols = [s.change("c", n).alias(f"{name}_return_{n}d") for n in (1, 5, 20)]
    return x.select(*by, "date", *cols, s.forward_change("c", 5).alias(f"{name}_5d_fwd"), s.zscore("v", 20).alias(f"{name}_volume_zscore_20d"))


def _price(b: DataFrame) -> DataFrame:
    """The price block of each ticker and day, against its issuer's tickers ("peer") and all ("market")."""
    x = trend(technical(by_entity(adjusted(b), TICKER), TICKER), TICKER, "close", (5, 20, 60))
    top = TICKER.max("close", 252)
    x = x.select(
        "ticker", "issuer", "date", *[F.round(c, 6).alias(f"td_{c}") for c in TECHNICAL], *[F.coalesce(F.round(c, 6), F.lit(0.0)).alias(f"td_{c}") for c in TRENDS],
        TICKER.forward_change("close", 5).alias("td_return_5d_fwd"), F.try_divide(F.col("close") - top, F.col("close")).alias("td_dist_52w_high_v2"),
        F.col("return_5d").alias("__5"), F.col("return_20d").alias("__20"),
    )
    x = x.join(_benchmark(b, ["issuer"], "peer"), on=["issuer", "date"]).join(F.broadcast(_benchmark(b, [], "market")), on="date")  # a row a calendar day
    vs = {f"td_vs_{k}_{n}d": F.col(f"__{n}") - F.col(f"{k}_return_{n}d") for k, n in (("peer", 5), ("market", 5), ("peer", 20))}
    targets = {f"target_excess_{k}_5d": F.col("td_return_5d_fwd") - F.col(f"{k}_5d_fwd") for k in ("peer", "market")}
    return x.withColumns(vs | targets).drop("peer_5d_fwd", "market_5d_fwd", "__5", "__20")


def _macro(spark: SparkSession, d: str, days: DataFrame) -> DataFrame:
    """All macro blocks on the days given, from one read: levels carried forward, changes, volatilities; prices' yearly change by months."""
    m = table(spark, d, "macro").where(F.col("series").isin(*MACRO) & F.col("value").isNotNull() & ~F.isnan("value")).select("series", "date", "recorded_at", "value")
    m = latest_row(m, ["series", "date"], ["recorded_at", "value"])
    m = m.withColumn("yearly", Series(["series"], ["date"]).change("value", 12))
    wide = m.groupBy("date").agg(
        *[F.max(F.when(F.col("series") == s, F.col("value"))).alias(n) for s, n in MACRO.items()], F.max(F.when(F.col("series") == "cpi_all_items", F.col("yearly"))).alias("cpi_yoy_change")
    )
    x = days.join(wide, on="date", how="left")
    x = x.select("date", *[DAY.fill(c).alias(c) for c in [*MACRO.values(), "cpi_yoy_change"]])
    x = x.withColumn("yield_curve_slope", F.col("yield_10y_level") - F.col("yield_2y_level"))
    moving = ("fx_usdcad", "vix", "gold", "dxy")
    x = x.select("*", *[DAY.change(f"{n}_level").alias(f"__{n}") for n in moving])
    x = x.select(
        "*", *[DAY.change(f"{n}_level", 5).alias(f"{n}_return_5d") for n in moving], *[DAY.std(f"__{n}", 20).alias(f"{n}_volatility_20d") for n in moving],
        DAY.diff("rate_overnight_level", 5).alias("rate_overnight_change_5d"), DAY.diff("yield_curve_slope", 5).alias("yield_curve_slope_change_5d"),
    )
    return x.drop(*[f"__{n}" for n in moving])


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    q = quarterly(notes_with_quarter(spark, d), ["issuer", "quarter"], None, TOPICS)
    q = q.join(table(spark, d, "call_dates").select("issuer", F.col("fiscal_quarter").alias("quarter"), "call_date"), on=["issuer", "quarter"])
    return with_changes(q.select("issuer", "call_date", *QUARTERLY), CALLS, QUARTERLY)


def _news(spark: SparkSession, d: str, days: DataFrame) -> DataFrame:
    n = annotations(spark, d).where("source_type = 'news'").select("ticker", "date", "score")
    t = trailing(n, days, entity="ticker", date="date", value="score", periods=(7, 30))
    x = asof(days, n.select("ticker", F.col("date").alias("on")).distinct(), entity=["ticker"], date="date", fact_date="on", columns=[], distance="days_since_last_news")
    x = windows_of_rows(x, t, entity="ticker", date="date")
    return x.select(
        "ticker", "date", F.col("mean_7").alias("news_sent_mean_7d"), F.col("mean_30").alias("news_sent_mean_30d"), F.col("count_7").alias("news_count_7d"), F.col("count_30").alias("news_count_30d"),
        "days_since_last_news", (F.col("count_7") > 10).cast("int").alias("is_news_burst"),
    )


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    x = _price(b).join(F.broadcast(_macro(spark, d, b.groupBy("date").agg(F.count("*").alias("n")).select("date"))), on="date")  # a row a calendar day
    x = project_daily(x, _quarters(spark, d), entity=["issuer"], date="date", known="call_date", columns=QUARTERLY)
    return x.join(_news(spark, d, b.select("ticker", "date")), on=["ticker", "date"])


def _six(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[f"round(`{c}` + 1e-10D, 6) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes])


def daily_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The daily matrix of 169 features and its forward return: price, currency, rates, prices, fear, quarterly and news blocks on the tickers' trading days.

    Days before the issuer's first call and without a five-day forward return
    are left out; missing changes and surprises of quarters become the
    sentinel, missing trends 0. Numbers to six places.
    """
    x = _matrix(spark, d).drop("td_dist_52w_high_v2", "td_vs_peer_20d", "target_excess_peer_5d", "target_excess_market_5d")
    x = x.where("days_since_call is not null and td_return_5d_fwd is not null")
    return with_sentinel(_six(x), [f"{c}_{k}" for c in QUARTERLY for k in ("delta", "surprise")])


def excess_targets(spark: SparkSession, d: str) -> DataFrame:
    """Five-day excess returns ahead over the issuer's tickers and over all, with their classes by bands of 0.3 %, the distance from the high and the 20-day excess behind."""
    x = _six(_price(bars(spark, d)).select("ticker", "date", "target_excess_peer_5d", "target_excess_market_5d", "td_dist_52w_high_v2", "td_vs_peer_20d"))
    x = x.where("target_excess_peer_5d is not null and target_excess_market_5d is not null")
    return x.select("*", *[band(F.col(f"target_excess_{k}_5d"), 0.003).alias(f"label_{k}") for k in ("peer", "market")])


def event_features(spark: SparkSession, d: str) -> DataFrame:
    """Signals that fade from the last call or news on, and the mean tone of the executives."""
    topic = lambda t: (f"topic_{t}_share", f"topic_{t}_sentiment")
    b = bars(spark, d)
    x = project_daily(b.select("ticker", "issuer", "date"), _quarters(spark, d), entity=["issuer"], date="date", known="call_date", columns=QUARTERLY)
    x = x.join(_news(spark, d, b.select("ticker", "date")), on=["ticker", "date"])
    x = event_signals(x, pressure=topic("regulatory_AML"), guidance=topic("guidance"), outlook=topic("macro"), broad=[topic(t) for t in ("credit_quality", "capital", "wealth", "insurance", "margins")])
    return _six(x.select("ticker", "date", *EVENTS, "exec_tone_ffill"))


def matrix_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Of every feature of the matrix its family, source, construction, timing and missing values, and how steadily it goes with the forward return, where that was ranked."""
    names = [c for c in daily_matrix(spark, d).columns if c not in ("ticker", "issuer", "date", "td_return_5d_fwd")]
    return feature_lineage(spark, [*names, *EVENTS], fixed=("td_return_5d", "td_volatility_20d", "days_since_call"), reduced=FEATURES, ranking=feature_ranking(spark, d))


# the same in SQL ------------------------------------------------------------------------------------------------
def _s(e: str, n: str) -> str:
    return f'round({e} + 1e-10, 6) AS "{n}"'


def _bench_sql(by: str, name: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, date" if by else "date"
    w = f"OVER ({part}ORDER BY date)"
    f = f"OVER ({part}ORDER BY date ROWS 19 PRECEDING)"
    return (
        f"{name}0 AS (SELECT {keys}, median(adj_close) AS c, CAST(sum(volume) AS DOUBLE) AS v FROM bars GROUP BY {keys}), {name} AS (SELECT {keys}, "
        + ", ".join(f"c / nullif(lag(c, {n}) {w}, 0) - 1 AS {name}_return_{n}d" for n in (1, 5, 20))
        + f", lead(c, 5) {w} / nullif(c, 0) - 1 AS {name}_5d_fwd, CASE WHEN count(v) {f} = 20 THEN (v - avg(v) {f}) / nullif(stddev_samp(v) {f}, 0) END AS {name}_volume_zscore_20d FROM {name}0)"
    )


_TOP = "CASE WHEN count(adj_close) OVER w = 252 THEN max(adj_close) OVER w END"
_OWN = f"""own AS (SELECT ticker, issuer, date, lead(adj_close, 5) {mq.W} / nullif(adj_close, 0) - 1 AS fwd, adj_close / nullif(lag(adj_close, 5) {mq.W}, 0) - 1 AS r5,
  adj_close / nullif(lag(adj_close, 20) {mq.W}, 0) - 1 AS r20, (adj_close - {_TOP}) / nullif(adj_close, 0) AS v2 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 251 PRECEDING))"""
TARGETS_SQL = with_(BARS, _bench_sql("issuer", "peer"), _bench_sql("", "market"), _OWN, f"""x AS (SELECT o.ticker, o.date, {_s('fwd - peer_5d_fwd', 'target_excess_peer_5d')}, {_s('fwd - market_5d_fwd', 'target_excess_market_5d')},
  {_s('v2', 'td_dist_52w_high_v2')}, {_s('r20 - peer_return_20d', 'td_vs_peer_20d')} FROM own o JOIN peer p ON p.issuer = o.issuer AND p.date = o.date JOIN market m ON m.date = o.date)""") + """
SELECT *, CASE WHEN target_excess_peer_5d > 0.003 THEN 1 WHEN target_excess_peer_5d < -0.003 THEN -1 ELSE 0 END AS label_peer, CASE WHEN target_excess_market_5d > 0.003 THEN 1 WHEN target_excess_market_5d < -0.003 THEN -1 ELSE 0 END AS label_market
FROM x WHERE target_excess_peer_5d IS NOT NULL AND target_excess_market_5d IS NOT NULL"""

_HERE = {k: v for k, v in MACRO.items() if k not in ("goc_5y", "gold", "dxy")}
_M = "OVER (ORDER BY date)"
_MOVING = ("fx_usdcad", "vix", "gold", "dxy")
_MACRO = [
    "latest AS (SELECT series, date, value FROM macro WHERE value IS NOT NULL AND NOT isnan(value) QUALIFY row_number() OVER (PARTITION BY series, date ORDER BY recorded_at DESC, value DESC) = 1)",
    "yearly AS (SELECT *, value / nullif(lag(value, 12) OVER (PARTITION BY series ORDER BY date), 0) - 1 AS y FROM latest)",
    "wide AS (SELECT date, " + ", ".join(f"max(value) FILTER (series = '{s}') AS {n}" for s, n in MACRO.items()) + ", max(y) FILTER (series = 'cpi_all_items') AS cpi_yoy_change FROM yearly GROUP BY date)",
    "spine AS (SELECT DISTINCT date FROM bars)",
    "held AS (SELECT s.date, " + ", ".join(f"last_value({n} IGNORE NULLS) OVER (ORDER BY s.date ROWS UNBOUNDED PRECEDING) AS {n}" for n in [*MACRO.values(), "cpi_yoy_change"]) + " FROM spine s LEFT JOIN wide w ON w.date = s.date)",
    "steps AS (SELECT *, yield_10y_level - yield_2y_level AS yield_curve_slope, " + ", ".join(f"{n}_level / nullif(lag({n}_level) {_M}, 0) - 1 AS s_{n}" for n in _MOVING) + " FROM held)",
    "macros AS (SELECT * EXCLUDE (" + ", ".join(f"s_{n}" for n in _MOVING) + "), " + ", ".join(
        f"{n}_level / nullif(lag({n}_level, 5) {_M}, 0) - 1 AS {n}_return_5d, CASE WHEN count(s_{n}) OVER w = 20 THEN stddev_samp(s_{n}) OVER w END AS {n}_volatility_20d" for n in _MOVING
    ) + f", rate_overnight_level - lag(rate_overnight_level, 5) {_M} AS rate_overnight_change_5d, yield_curve_slope - lag(yield_curve_slope, 5) {_M} AS yield_curve_slope_change_5d FROM steps WINDOW w AS (ORDER BY date ROWS 19 PRECEDING))",
]
_ALL = [f"{c}_{k}" for c in QUARTERLY for k in ("ffill", "delta", "surprise")]
_UNROUNDED = QUARTERLY_SQL.replace(" + 1e-10, 6)", ", 14)").split("WHERE quarter <=")[0] + "WHERE quarter IS NOT NULL GROUP BY issuer, quarter"
_QUARTERS = [
    f"q AS ({_UNROUNDED})", "c AS (SELECT q.*, call_date FROM q JOIN call_dates d ON d.issuer = q.issuer AND d.fiscal_quarter = q.quarter)",
    "ch AS (SELECT issuer, call_date, " + ", ".join(f'"{c}" AS "{c}_ffill", "{c}" - lag("{c}") OVER w AS "{c}_delta", "{c}" - avg("{c}") OVER (PARTITION BY issuer ORDER BY call_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS "{c}_surprise"' for c in QUARTERLY) + " FROM c WINDOW w AS (PARTITION BY issuer ORDER BY call_date))",
    "line AS (SELECT issuer, call_date AS date, 0 AS o, call_date, " + ", ".join(f'"{c}"' for c in _ALL) + " FROM ch UNION ALL SELECT DISTINCT issuer, date, 1, NULL, " + ", ".join(["NULL"] * len(_ALL)) + " FROM bars)",
    "seen AS (SELECT issuer, date, o, CAST(date - last_value(call_date IGNORE NULLS) OVER w AS INTEGER) AS days_since_call, " + ", ".join(f'last_value("{c}" IGNORE NULLS) OVER w AS "{c}"' for c in _ALL) + " FROM line WINDOW w AS (PARTITION BY issuer ORDER BY date, o ROWS UNBOUNDED PRECEDING))",
    "quarters AS (SELECT * EXCLUDE (o), CAST(coalesce(days_since_call <= 5, false) AS INTEGER) AS is_earnings_week FROM seen WHERE o = 1)",
]
_NEWS = [
    QNOTES,
    """news AS (SELECT b.ticker, b.date, coalesce(avg(n.score) FILTER (n.date >= b.date - 7), 0.0) AS news_sent_mean_7d, coalesce(avg(n.score) FILTER (n.date >= b.date - 30), 0.0) AS news_sent_mean_30d,
  count(n.score) FILTER (n.date >= b.date - 7) AS news_count_7d, count(n.score) FILTER (n.date >= b.date - 30) AS news_count_30d, CAST(b.date - max(n.date) AS INTEGER) AS days_since_last_news,
  CAST(count(n.score) FILTER (n.date >= b.date - 7) > 10 AS INTEGER) AS is_news_burst FROM bars b LEFT JOIN notes n ON n.ticker = b.ticker AND n.date <= b.date AND n.source_type = 'news' GROUP BY b.ticker, b.date)""",
]
_TECH = {"returns": ("return_1d", "return_5d", "return_20d"), "volatility_zscore": None, "volume_changes": None, "corr_pv": None, "wvma_cntd_sumd": None, "rsv_rsi_boll": None, "dist_high": None}
MATRIX_SQL = with_(BARS, _bench_sql("issuer", "peer"), _bench_sql("", "market"), _OWN, *_MACRO, *_NEWS, *_QUARTERS) + (
    "SELECT o.ticker, o.issuer, o.date, " + ", ".join(f"tech.{c} AS td_{c}" for c in TECHNICAL) + ", " + ", ".join(f"coalesce(tr.{c}, 0.0) AS td_{c}" for c in TRENDS)
    + f", {_s('fwd', 'td_return_5d_fwd')}, {_s('r5 - peer_return_5d', 'td_vs_peer_5d')}, {_s('r5 - market_return_5d', 'td_vs_market_5d')}, "
    + ", ".join(_s(f"{k}_{c}", f"{k}_{c}") for k in ("peer", "market") for c in ("return_1d", "return_5d", "return_20d", "volume_zscore_20d")) + ", "
    + ", ".join(_s(f"CAST(mc.{c} AS DOUBLE)", c) for c in [*MACRO.values(), "cpi_yoy_change", "yield_curve_slope", *[f"{n}_{k}" for n in _MOVING for k in ("return_5d", "volatility_20d")], "rate_overnight_change_5d", "yield_curve_slope_change_5d"])
    + ", days_since_call, is_earnings_week, " + ", ".join(_s(f'"{c}"', c) if c.endswith("_ffill") else f'coalesce(round("{c}" + 1e-10, 6), -9999.0) AS "{c}"' for c in _ALL)
    + f", {_s('news_sent_mean_7d', 'news_sent_mean_7d')}, {_s('news_sent_mean_30d', 'news_sent_mean_30d')}, news_count_7d, news_count_30d, days_since_last_news, is_news_burst"
    + " FROM own o JOIN (SELECT * FROM " + " JOIN ".join(f"({mq.ORACLE[k]}) {k}" + (" USING (ticker, date)" if i else "") for i, k in enumerate(_TECH)) + f""") tech ON tech.ticker = o.ticker AND tech.date = o.date
JOIN ({mq.ORACLE['ols_trend']}) tr ON tr.ticker = o.ticker AND tr.date = o.date JOIN peer p ON p.issuer = o.issuer AND p.date = o.date JOIN market m ON m.date = o.date JOIN macros mc ON mc.date = o.date
JOIN quarters qu ON qu.issuer = o.issuer AND qu.date = o.date JOIN news nw ON nw.ticker = o.ticker AND nw.date = o.date WHERE days_since_call IS NOT NULL AND fwd IS NOT NULL"""
)

_CALL, _NEWSD = "exp(-greatest(coalesce(days_since_call, 999), 0) / 20.0)", "exp(-greatest(coalesce(days_since_last_news, 999), 0) / 15.0)"
_L = lambda c: f'"{c}_ffill"'
_BROAD = ("credit_quality", "capital", "wealth", "insurance", "margins")
_CEO, _CFO = _L("transcript_ceo_prep_sentiment_mean"), _L("transcript_cfo_prep_sentiment_mean")
_SHIFT = lambda t: f'abs("topic_{t}_share_delta") + abs("topic_{t}_sentiment_delta")'
_TILT = lambda t: f'"topic_{t}_share_ffill" * ("topic_{t}_sentiment_ffill" - 0.5)'
_FADING = {
    "evt_ceo_tone": _CEO, "evt_cfo_tone": _CFO, "evt_framing_gap": _L("framing_gap"), "evt_aml_pressure": '"topic_regulatory_AML_share_ffill" * (1 - "topic_regulatory_AML_sentiment_ffill")',
    "evt_aml_shift": f"({_SHIFT('regulatory_AML')})", "evt_guidance_strength": '"topic_guidance_share_ffill" * "topic_guidance_sentiment_ffill"', "evt_guidance_shift": '("topic_guidance_share_delta" + "topic_guidance_sentiment_delta")',
    "evt_macro_topic": _TILT("macro"), "evt_topic_entropy": _L("topic_entropy"), "evt_broad_topic_signal": f"list_avg([{', '.join(map(_TILT, _BROAD))}])", "evt_broad_topic_shift": f"list_avg([{', '.join(map(_SHIFT, _BROAD))}])",
    "evt_cfo_lead": f"({_CFO} - {_CEO})", "evt_ceo_surprise": '"transcript_ceo_prep_sentiment_mean_surprise"', "evt_analyst_qa_tone": _L("transcript_analyst_qa_sentiment_mean"),
    "evt_exec_scripted_gap": f"({_L('transcript_exec_qa_sentiment_mean')} - {_CEO})", "evt_source_dispersion": f"list_aggregate([{_CEO}, {_L('news_sentiment_mean')}, {_L('report_sentiment_mean')}], 'stddev_samp')",
    "evt_transcript_reliability": f"(1 / (1 + {_L('transcript_sentiment_std')}))", "evt_exec_tone": f"list_avg([{_CEO}, {_CFO}])", "evt_guidance_topic": _L("topic_guidance_share"), "evt_guidance_sentiment": _L("topic_guidance_sentiment"),
    "evt_aml_topic": _L("topic_regulatory_AML_share"), "evt_aml_sentiment": _L("topic_regulatory_AML_sentiment"),
}
EVENTS_SQL = with_(BARS, *_NEWS, *_QUARTERS) + (
    "SELECT b.ticker, b.date, " + ", ".join(_s(f"{e} * {_CALL}", n) for n, e in _FADING.items()) + f", {_s(f'news_sent_mean_30d * {_NEWSD}', 'evt_news_tone')}, {_s(f'ln(1 + CAST(news_count_30d AS DOUBLE)) * {_NEWSD}', 'evt_news_flow')}, "
    + _s(f"list_avg([{_CEO}, {_CFO}])", "exec_tone_ffill") + " FROM bars b JOIN quarters qu ON qu.issuer = b.issuer AND qu.date = b.date JOIN news nw ON nw.ticker = b.ticker AND nw.date = b.date"
)

QUERIES = {"daily_matrix": daily_matrix, "excess_targets": excess_targets, "event_features": event_features, "matrix_lineage": matrix_lineage}
ORACLE = {"daily_matrix": MATRIX_SQL, "excess_targets": TARGETS_SQL, "event_features": EVENTS_SQL}
