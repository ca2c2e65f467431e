"""Queries p1 to p6 over the daily feature matrix, prices and annotations, with their SQL."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.missing import Reading, usable
from tidemark.functions.scalar import fiscal_quarter, quarter_label
from tidemark.operators.hot_deck import hot_deck, marked_cells
from tidemark.operators.known_at import known_at
from tidemark.operators.profile import Check, add_loads, column_states, merge_states, out_of_control, state_metrics
from tidemark.operators.regrid import calendar_cells, regrid
from tidemark.operators.spikes import Measure, implausible
from tidemark.operators.trailing import clean_key, latest_per, trailing, windows_of_rows
from tidemark.plans.base import BARS, bars
from tidemark.session import shared_folder, table

MATRIX = "model_features_daily"

#: What a true reading of each field can be. A price can't stand above its own
#: 52-week high nor lose more than all of it; days are counted from 0, and 999
#: is the fill for "no news yet"; a gap is the difference of two scores in [-1, 1].
FILLABLE = {
    "td_dist_52w_high": Reading(low=-1.0, high=0.0),
    "days_since_last_news": Reading(stand_ins=(-9999.0, 999.0), low=0.0),
    "evt_framing_gap": Reading(low=-2.0, high=2.0),
}

GRIDDED = ("cpi_yoy_change", "rate_overnight_level", "fx_usdcad_level", "yield_10y_level")


# p1 -----------------------------------------------------------------------------------------------------------
def _p1(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, MATRIX).select("row_id", "date", "ticker", "issuer", *FILLABLE)
    return hot_deck(m, FILLABLE, row_id="row_id", date="date", within="ticker", levels=("issuer", ""))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return marked_cells(_p1(spark, d), list(FILLABLE), "row_id")


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    """The cells found, each with what it was filled with and from where."""
    return marked_cells(_p1(spark, d), list(FILLABLE), "row_id", "_filled", "_donor_level", "_donor_date", "_distance")


P1_SQL = """
SELECT row_id, 'td_dist_52w_high' AS field FROM model_features_daily
WHERE td_dist_52w_high IS NULL OR isnan(td_dist_52w_high) OR NOT td_dist_52w_high BETWEEN -1 AND 0
UNION ALL SELECT row_id, 'days_since_last_news' FROM model_features_daily
WHERE days_since_last_news IS NULL OR isnan(days_since_last_news) OR days_since_last_news < 0 OR days_since_last_news = 999 OR isinf(days_since_last_news)
UNION ALL SELECT row_id, 'evt_framing_gap' FROM model_features_daily
WHERE evt_framing_gap IS NULL OR isnan(evt_framing_gap) OR NOT evt_framing_gap BETWEEN -2 AND 2
"""

P1_FILLED_SQL = """
WITH base AS (
  SELECT row_id, date, ticker,
    CASE WHEN NOT isnan(td_dist_52w_high) AND td_dist_52w_high BETWEEN -1 AND 0 THEN td_dist_52w_high END AS td_dist_52w_high,
    CASE WHEN NOT isnan(days_since_last_news) AND days_since_last_news >= 0 AND days_since_last_news <> 999 AND NOT isinf(days_since_last_news) THEN days_since_last_news END AS days_since_last_news,
    CASE WHEN NOT isnan(evt_framing_gap) AND evt_framing_gap BETWEEN -2 AND 2 THEN evt_framing_gap END AS evt_framing_gap
  FROM model_features_daily),
cells AS (SELECT * FROM base UNPIVOT INCLUDE NULLS (v FOR field IN (td_dist_52w_high, days_since_last_news, evt_framing_gap))),
near AS (
  SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'v': v, 'd': date} END IGNORE NULLS) OVER (PARTITION BY ticker, field ORDER BY date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
    first_value(CASE WHEN v IS NOT NULL THEN {'v': v, 'd': date} END IGNORE NULLS) OVER (PARTITION BY ticker, field ORDER BY date, row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q
  FROM cells),
pick AS (SELECT *, CASE WHEN p IS NULL THEN q WHEN q IS NULL THEN p WHEN q.d - date < date - p.d THEN q ELSE p END AS x FROM near WHERE v IS NULL)
SELECT row_id, field, x.v AS filled, 'ticker' AS donor_level, x.d AS donor_date, CAST(abs(date - x.d) AS INTEGER) AS distance FROM pick
"""


# p2 -----------------------------------------------------------------------------------------------------------
def _news(spark: SparkSession, d: str) -> DataFrame:
    """One row per news chunk: its latest annotation with a usable score."""
    a = table(spark, d, "annotations").where(F.col("source_type") == "news").select(
        "chunk_id", F.try_to_timestamp("created_at").alias("created"), "ticker",
        F.to_date(F.try_to_timestamp(F.substring("date", 1, 10), F.lit("yyyy-MM-dd"))).alias("day"), F.col("output.sentiment_score").alias("score"),
    )
    a = a.where(F.col("score").isNotNull() & ~F.isnan("score"))
    x = latest_per(a, "chunk_id", "created", "ticker", "day", "score")
    return x.select(clean_key(F.col("ticker")).alias("key"), "day", "score")


def _p2(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, MATRIX).select("row_id", "date", clean_key(F.col("ticker")).alias("key"), "news_count_30d", "news_sent_mean_30d", "news_sent_mean_7d")
    news = _news(spark, d).withColumnRenamed("day", "date")
    t = trailing(news, m, entity="key", date="date", value="score", periods=(7, 30))
    return windows_of_rows(m, t, entity="key", date="date")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    x = _p2(spark, d)

    def off(stored: str, real: str, by: float) -> Column:
        s, r = F.col(stored).cast("double"), F.col(real).cast("double")
        return F.struct(F.lit(stored).alias("field"), (s.isNull() | F.isnan(s) | ~F.coalesce((s == r) | (F.abs(s - r) <= by), F.lit(False))).alias("bad"))

    cells = F.array(off("news_count_30d", "count_30", 0.0), off("news_sent_mean_30d", "mean_30", 0.001), off("news_sent_mean_7d", "mean_7", 0.001))
    return x.select("row_id", F.explode(F.filter(cells, lambda c: c["bad"])).alias("c")).select("row_id", F.col("c.field").alias("field"))


def p2_windows(spark: SparkSession, d: str) -> DataFrame:
    """Per ticker and date of the matrix: number and mean score of the news of the last 7 and 30 days (means to six places, halves upwards)."""
    t = _p2(spark, d).select(F.col("key").alias("ticker"), "date", "count_7", F.round(F.col("mean_7") + 1e-10, 6).alias("mean_7"), "count_30", F.round(F.col("mean_30") + 1e-10, 6).alias("mean_30"))
    return t.distinct()


_P2_CTE = """
WITH news AS (
  SELECT upper(trim(ticker)) AS key, CAST(substr(date, 1, 10) AS DATE) AS day, output.sentiment_score AS score
  FROM annotations WHERE source_type = 'news' AND output.sentiment_score IS NOT NULL AND NOT isnan(output.sentiment_score)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, ticker DESC, date DESC, output.sentiment_score DESC) = 1),
keys AS (SELECT DISTINCT upper(trim(ticker)) AS key, date FROM model_features_daily),
w AS (
  SELECT k.key, k.date, count(n.score) FILTER (n.day >= k.date - 7) AS count_7, coalesce(avg(n.score) FILTER (n.day >= k.date - 7), 0.0) AS mean_7,
    count(n.score) AS count_30, coalesce(avg(n.score), 0.0) AS mean_30
  FROM keys k LEFT JOIN news n ON n.key = k.key AND n.day BETWEEN k.date - 30 AND k.date GROUP BY ALL)
"""

P2_SQL = _P2_CTE + """
, x AS (SELECT * FROM model_features_daily m JOIN w ON upper(trim(m.ticker)) = w.key AND m.date = w.date)
SELECT row_id, 'news_count_30d' AS field FROM x WHERE news_count_30d IS NULL OR news_count_30d <> count_30
UNION ALL SELECT row_id, 'news_sent_mean_30d' FROM x WHERE news_sent_mean_30d IS NULL OR isnan(news_sent_mean_30d) OR abs(news_sent_mean_30d - mean_30) > 0.001
UNION ALL SELECT row_id, 'news_sent_mean_7d' FROM x WHERE news_sent_mean_7d IS NULL OR isnan(news_sent_mean_7d) OR abs(news_sent_mean_7d - mean_7) > 0.001
"""

P2_WINDOWS_SQL = _P2_CTE + "SELECT key AS ticker, date, count_7, round(mean_7 + 1e-10, 6) AS mean_7, count_30, round(mean_30 + 1e-10, 6) AS mean_30 FROM w"


# p3 -----------------------------------------------------------------------------------------------------------
QUARTER = Check(pattern=r"^FY\d{4}Q[1-4]$")

#: Declared once for all tables; a column that isn't listed is profiled without a check of its own.
CHECKS = {
    "fiscal_quarter": QUARTER,
    "ticker": Check(pattern=r"^[A-Z]{4}-P\d{6}\.QX$"),
    "issuer": Check(pattern=r"^[A-Z]{4}$"),
    "is_news_burst": Check(domain=(0, 1)),
    "is_earnings_week": Check(domain=(0, 1)),
    "td_return_1d": Check(low=-1.0),
    "td_return_5d": Check(low=-1.0),
    "td_return_20d": Check(low=-1.0),
    "td_return_5d_fwd": Check(low=-1.0),
    "framing_gap_ffill": Check(low=-2.0, high=2.0),
    "evt_framing_gap": Check(low=-2.0, high=2.0),
    "td_dist_52w_high": Check(low=-1.0, high=0.0),
    "days_since_last_news": Check(low=0.0, stand_ins=(-9999.0, 999.0)),
    "adj_close": Check(low=0.0),
    "vix_level": Check(low=0.0),
    "created_at": Check(pattern=r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"),
    "lang": Check(pattern=r"^[a-z]{2}$"),
}


def _quarters_ahead(label: Column, day: Column) -> Column:
    """By how many quarters a label lies ahead of the fiscal quarter of its row's date; NULL where either can't be read."""
    index = lambda q: F.substring(q, 3, 4).cast("int") * 4 + F.substring(q, 8, 1).cast("int")
    return index(quarter_label(label)) - index(fiscal_quarter(day))


def _checks(day: Column) -> dict[str, Check]:
    """CHECKS, with quarters compared by their lag to ``day``: a load's quarters move on with its dates."""
    lag = replace(QUARTER, shares_of=_quarters_ahead(F.col("fiscal_quarter"), day))
    return {**CHECKS, "fiscal_quarter": lag}


def _loads(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    m = table(spark, d, MATRIX)
    s = column_states(m, "load_id", columns, _checks(F.col("date")))
    return state_metrics(s, merge_states(s, "field"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    x = _loads(spark, d, list(_P3_FIELDS))
    return out_of_control(x).select(F.col("part").cast("long").alias("load_id"), "field").distinct()


def p3_alarms(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the matrix: what was out of line in which load."""
    return out_of_control(_loads(spark, d)).withColumnRenamed("part", "load_id")


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every column of the large tables by load, changes included: of the matrix by load_id, of the others by month of arrival.

    Fields of structs are columns of their own, named struct.field.
    """
    month = lambda c: F.date_format(F.trunc(c, "month"), "yyyy-MM")
    stamp = lambda c: F.to_date(F.try_to_timestamp(c))
    parts = {
        MATRIX: (F.lpad(F.col("load_id").cast("string"), 6, "0"), F.col("date")),
        "prices": (month(F.col("ingested_at")), None),
        "annotations": (month(stamp(F.col("created_at"))), stamp(F.substring("date", 1, 10))),
        "documents": (month(F.col("doc_date")), F.col("doc_date")),
    }
    out = []
    for name, (by, day) in parts.items():
        t = table(spark, d, name)
        inner = [F.col(f"`{c.name}`.`{f.name}`").alias(f"{c.name}.{f.name}") for c in t.schema if isinstance(c.dataType, T.StructType) for f in c.dataType]
        s = column_states(t.select("*", by.alias("__load"), *inner), "__load", None, CHECKS if day is None else _checks(day))
        out.append(s.withColumn("field", F.concat(F.lit(f"{name}/"), "field")))
    # one plan for all tables from here on: the states are few
    s = reduce(DataFrame.unionByName, out)
    x = state_metrics(s, merge_states(s, "field"))
    return x.withColumn("table_name", F.split_part("field", F.lit("/"), F.lit(1))).withColumn("field", F.split_part("field", F.lit("/"), F.lit(2)))


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Profile of every column of the large tables by load, with its distances from the other loads."""
    return _profiles(spark, d).select("table_name", F.col("part").alias("load"), *PROFILE)


def p3_table_alarms(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the large tables: what was out of line in which load, loads of fewer than 30 rows aside."""
    return out_of_control(_profiles(spark, d), by=("table_name", "field"), least_rows=30).withColumnRenamed("part", "load")


def p3_watch(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the matrix, each load judged by the up to 100 before it, from states kept load by load.

    The states are written in the shared folder in two deliveries, of which the
    second profiles only the loads that the first hadn't.
    """
    m, at = table(spark, d, MATRIX), shared_folder(spark, "states")
    half = m.where(F.col("load_id") <= m.agg(F.floor((F.min("load_id") + F.max("load_id")) / 2)).first()[0])
    add_loads(half, "load_id", at, None, _checks(F.col("date")))
    kept = add_loads(m, "load_id", at, None, _checks(F.col("date")))
    return out_of_control(state_metrics(kept), memory=100).withColumnRenamed("part", "load_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """The exact part of p3_found, for comparison with SQL: rates of loads that are out of line."""
    x = column_states(table(spark, d, MATRIX), "load_id", list(_P3_FIELDS), CHECKS)
    got = out_of_control(state_metrics(x)).where(F.col("metric").endswith("_rate"))
    return got.select(F.col("part").cast("long").alias("load_id"), "field", "metric", F.round("value", 9).alias("value"), F.round("centre", 9).alias("centre"))


_P3_FIELDS = ("framing_gap_ffill", "td_return_5d_fwd", "is_news_burst", "fiscal_quarter")

PROFILE = (
    "field", "n", "nulls", "nans", "stand_ins", "off_pattern", "off_domain", "off_range", "used", "low", "high", "mean", "sd", "n_distinct", "q25", "q50", "q75", "mode_share",
    "top_share", "distance", "mix_distance", "step_distance",
)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The exact part of the matrix's profile by load, for comparison with SQL."""
    s = column_states(table(spark, d, MATRIX), "load_id", ["framing_gap_ffill", "td_return_5d_fwd", "is_news_burst", "fiscal_quarter"], CHECKS)
    return s.select(F.col("part").cast("long").alias("load_id"), "field", "n", "nulls", "nans", "stand_ins", "off_pattern", "off_domain", "off_range", "used", "low", "high")


def _p3_sql(field: str, x: str, nan: str, standing: str, off_pattern: str = "false", off_domain: str = "false", off_range: str = "false") -> str:
    used = f"{field} IS NOT NULL AND NOT coalesce({nan}, false) AND NOT coalesce({standing}, false)"
    n = lambda c: f"CAST(count(*) FILTER ({c}) AS BIGINT)"
    return (
        f"SELECT CAST(load_id AS BIGINT) AS load_id, '{field}' AS field, count(*) AS n, {n(field + ' IS NULL')} AS nulls, {n(nan)} AS nans, {n(standing)} AS stand_ins, "
        f"{n(used + ' AND ' + off_pattern)} AS off_pattern, {n(used + ' AND ' + off_domain)} AS off_domain, {n(used + ' AND ' + off_range)} AS off_range, {n(used)} AS used, "
        f"CAST(min({x}) FILTER ({used}) AS DOUBLE) AS low, CAST(max({x}) FILTER ({used}) AS DOUBLE) AS high FROM {MATRIX} GROUP BY load_id"
    )


P3_COUNTS_SQL = " UNION ALL ".join([
    _p3_sql("framing_gap_ffill", "framing_gap_ffill", "isnan(framing_gap_ffill)", "framing_gap_ffill = -9999", off_range="NOT framing_gap_ffill BETWEEN -2 AND 2"),
    _p3_sql("td_return_5d_fwd", "td_return_5d_fwd", "isnan(td_return_5d_fwd)", "td_return_5d_fwd = -9999", off_range="td_return_5d_fwd < -1"),
    _p3_sql("is_news_burst", "is_news_burst", "false", "is_news_burst = -9999", off_domain="is_news_burst NOT IN (0, 1)"),
    _p3_sql("fiscal_quarter", "length(fiscal_quarter)", "false", "false", off_pattern="NOT regexp_full_match(fiscal_quarter, 'FY[0-9]{4}Q[1-4]')"),
])


P3_RATES_SQL = f"""WITH s AS ({P3_COUNTS_SQL}),
x AS (SELECT load_id, field, n, metric || '_rate' AS metric, c / CAST(n AS DOUBLE) AS value FROM s UNPIVOT (c FOR metric IN (nulls, nans, stand_ins, off_pattern, off_domain, off_range))),
c AS (SELECT *, median(value) OVER w AS centre, count(*) OVER w AS history FROM x WINDOW w AS (PARTITION BY field, metric)),
m AS (SELECT *, 1.4826 * median(abs(value - centre)) OVER (PARTITION BY field, metric) AS spread, (centre * n + 1) / (n + 2) AS usual FROM c)
SELECT load_id, field, metric, round(value, 9) AS value, round(centre, 9) AS centre FROM m
WHERE history >= 5 AND abs(value - centre) > greatest(5 * spread, CASE WHEN metric = 'nulls_rate' THEN 0.05 ELSE least(0.05, greatest(0.02, 5 * sqrt(usual * (1 - usual) / n))) END)"""


# p4 -----------------------------------------------------------------------------------------------------------
def p4_faults(spark: SparkSession, d: str) -> DataFrame:
    """Faulty readings, each with what is wrong about it."""
    prices = implausible(table(spark, d, "prices"), [Measure("adj_close")], source="ticker", date="date", row_id="price_id")
    matrix = implausible(table(spark, d, MATRIX), [Measure("vix_level"), Measure("td_return_1d", "return", "td_close")], source="ticker", date="date", row_id="row_id")
    a = prices.select(F.lit("prices").alias("table_name"), F.col("price_id").alias("row_id"), "field", "out_of_range", "spike", "stuck")
    return a.unionByName(matrix.withColumn("table_name", F.lit(MATRIX)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_faults(spark, d).select("table_name", "row_id", "field")


# p5 -----------------------------------------------------------------------------------------------------------
def _cells(spark: SparkSession, d: str) -> DataFrame:
    """date, cell, open; a row a calendar day."""
    return calendar_cells(table(spark, d, "trading_calendar"), "cal_date", "is_trading_day").select(F.col("day").alias("date"), "cell", "open")


def _on_days(g: DataFrame, cal: DataFrame) -> DataFrame:
    """A grid by (ticker, field) and cell with its trading days."""
    x = g.join(F.broadcast(cal.where("open").select("cell", "date")), on="cell")
    return x.select(F.col("series.ticker").alias("ticker"), F.col("series.field").alias("field"), F.date_format("date", "yyyy-MM-dd").alias("trade_date"), F.round(F.col("value"), 9).alias("value"), "marked")


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    """One line per ticker, field and trading day: the level (to nine places), read or filled, and whether it is marked as having no reading of its own."""
    m = table(spark, d, MATRIX)
    kinds = {x.name: x.dataType for x in m.schema}
    day = m.where(F.col("ticker").isNotNull() & F.col("date").isNotNull()).groupBy("ticker", "date").agg(
        *[F.max_by(usable(F.col(f), kinds[f]), F.when(usable(F.col(f), kinds[f]).isNotNull(), F.col("row_id"))).alias(f) for f in GRIDDED]
    )
    cal = _cells(spark, d)
    on = day.join(F.broadcast(cal), on="date")
    ids = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in GRIDDED]
    # a reading on a closed day holds from the next open day on, unless that has one, and is none of that day's own
    long = on.select("ticker", F.col("date").alias("o"), "cell", "open", F.explode(F.array(*ids)).alias("x"))
    long = long.select(F.struct("ticker", F.col("x.field").alias("field")).alias("series"), "o", "cell", "open", F.col("x.value").alias("value"))
    bounds = long.select("series", F.col("cell").alias("first_cell"), F.when(F.col("open"), F.col("cell")).otherwise(F.col("cell") - 1).alias("last_cell"))
    bounds = bounds.groupBy("series").agg(F.min("first_cell").alias("first_cell"), F.max("last_cell").alias("last_cell"))
    return _on_days(regrid(long, bounds, entity="series", time="cell", value="value", order="o", kind="level", own="open"), cal)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_grid(spark, d).where("marked").select("ticker", "field", "trade_date")


def p5_turnover(spark: SparkSession, d: str) -> DataFrame:
    """Volume per ticker and trading day out of a counter: the volume traded since the year began, read where there is a bar.

    The counter starts anew each year; days without a bar get their share of
    what the next reading adds, and are marked.
    """
    b = bars(spark, d).where("ticker is not null and date is not null and volume is not null").select("ticker", "date", "volume")
    year = Window.partitionBy("ticker", F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    b = b.select("ticker", "date", F.sum("volume").over(year).alias("counted"))
    cal = _cells(spark, d)
    # the reading is taken when the day ends
    r = b.join(F.broadcast(cal.where("open")), on="date").select(F.struct("ticker", F.lit("volume").alias("field")).alias("series"), "date", "cell", (F.col("cell") + 1).alias("t"), "counted")
    bounds = r.groupBy("series").agg((F.min("cell") + 1).alias("first_cell"), F.max("cell").alias("last_cell"))
    g = regrid(r, bounds, entity="series", time="t", value="counted", order="date", kind="counter")
    read = r.select("series", "cell", F.lit(True).alias("read"))
    return _on_days(g.drop("marked").join(read, on=["series", "cell"], how="left").withColumn("marked", F.col("read").isNull()), cal)


_P5_CELLS = """cells AS (
  SELECT ticker, field, date, row_id, v FROM (SELECT row_id, ticker, date, cpi_yoy_change, rate_overnight_level, fx_usdcad_level, yield_10y_level FROM model_features_daily)
  UNPIVOT INCLUDE NULLS (v FOR field IN (cpi_yoy_change, rate_overnight_level, fx_usdcad_level, yield_10y_level))),
span AS (SELECT ticker, field, min(date) AS a, max(date) AS z FROM cells GROUP BY ALL),
readings AS (SELECT ticker, field, date, v FROM cells WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AND v <> -9999
  QUALIFY row_number() OVER (PARTITION BY ticker, field, date ORDER BY row_id DESC) = 1)"""

P5_GRID_SQL = f"""WITH {_P5_CELLS},
days AS (SELECT s.ticker, s.field, c.cal_date, c.is_trading_day, r.v FROM span s JOIN trading_calendar c ON c.cal_date BETWEEN s.a AND s.z LEFT JOIN readings r ON r.ticker = s.ticker AND r.field = s.field AND r.date = c.cal_date),
held AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker, field ORDER BY cal_date ROWS UNBOUNDED PRECEDING) AS held FROM days)
SELECT ticker, field, strftime(cal_date, '%Y-%m-%d') AS trade_date, round(held, 9) AS value, v IS NULL AS marked FROM held WHERE is_trading_day"""

P5_TURNOVER_SQL = f"""WITH {BARS},
open AS (SELECT cal_date AS date, row_number() OVER (ORDER BY cal_date) AS cell FROM trading_calendar WHERE is_trading_day),
r AS (SELECT ticker, o.date, cell, sum(volume) OVER (PARTITION BY ticker, year(o.date) ORDER BY o.date) AS c FROM bars JOIN open o ON o.date = bars.date WHERE volume IS NOT NULL),
i AS (SELECT *, lag(cell) OVER w AS before, lag(c) OVER w AS was FROM r WINDOW w AS (PARTITION BY ticker ORDER BY cell))
SELECT ticker, 'volume' AS field, strftime(o.date, '%Y-%m-%d') AS trade_date, round(CAST(CASE WHEN c < was THEN c ELSE c - was END AS DOUBLE) / (i.cell - before), 9) AS value, o.cell <> i.cell AS marked
FROM i JOIN open o ON o.cell > before AND o.cell <= i.cell"""

P5_SQL = """
WITH cells AS (
  SELECT ticker, field, date, v FROM (SELECT ticker, date, cpi_yoy_change, rate_overnight_level, fx_usdcad_level, yield_10y_level FROM model_features_daily)
  UNPIVOT INCLUDE NULLS (v FOR field IN (cpi_yoy_change, rate_overnight_level, fx_usdcad_level, yield_10y_level))),
span AS (SELECT ticker, field, min(date) AS a, max(date) AS z FROM cells GROUP BY ALL),
grid AS (SELECT ticker, field, cal_date FROM span JOIN trading_calendar ON is_trading_day AND cal_date BETWEEN a AND z)
SELECT g.ticker, g.field, strftime(cal_date, '%Y-%m-%d') AS trade_date FROM grid g
ANTI JOIN (SELECT * FROM cells WHERE v IS NOT NULL AND NOT isnan(v) AND v <> -9999) c ON c.ticker = g.ticker AND c.field = g.field AND c.date = g.cal_date
"""


# p6 -----------------------------------------------------------------------------------------------------------
def _p6(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, MATRIX).select("row_id", "date", "issuer", "days_since_call", "transcript_ceo_prep_sentiment_mean_ffill", "topic_regulatory_AML_share_ffill")
    calls = table(spark, d, "call_dates")
    quarters = table(spark, d, "nlp_quarterly").join(calls.select("issuer", "fiscal_quarter", "call_date"), on=["issuer", "fiscal_quarter"])
    facts = quarters.select(
        "issuer", F.col("known_from").alias("known"), F.col("call_date").alias("valid"), F.col("version").cast("double").alias("version"),
        F.lit(None).cast("double").alias("call_day"), F.col("transcript_ceo_prep_sentiment_mean").alias("ceo"), F.col("topic_regulatory_AML_share").alias("aml"),
    )
    facts = facts.unionByName(
        calls.select(
            "issuer", F.col("call_date").alias("known"), F.col("call_date").alias("valid"), F.lit(0.0).alias("version"),
            F.unix_date("call_date").cast("double").alias("call_day"), F.lit(None).cast("double").alias("ceo"), F.lit(None).cast("double").alias("aml"),
        )
    )
    x = known_at(
        m, facts, entity="issuer", event_time="date", known_time="known", valid_time="valid", order="version", columns=("call_day", "ceo", "aml"),
        keep=("row_id", "date", "days_since_call", "transcript_ceo_prep_sentiment_mean_ffill", "topic_regulatory_AML_share_ffill"),
    )
    return x.withColumn("days_known", (F.unix_date("date") - F.col("call_day_known")).cast("int"))


_P6_PAIRS = {"days_since_call": "days_known", "transcript_ceo_prep_sentiment_mean_ffill": "ceo_known", "topic_regulatory_AML_share_ffill": "aml_known"}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    def cell(stored: str, real: str) -> Column:
        s, r = F.col(stored).cast("double"), F.col(real).cast("double")
        s = F.when(~F.isnan(s), s)
        return F.struct(F.lit(stored).alias("field"), ((s.isNull() != r.isNull()) | F.coalesce(F.abs(s - r) > 1e-9, F.lit(False))).alias("bad"))

    cells = F.array(*[cell(s, r) for s, r in _P6_PAIRS.items()])
    return _p6(spark, d).select("row_id", F.explode(F.filter(cells, lambda c: c["bad"])).alias("c")).select("row_id", F.col("c.field").alias("field"))


def p6_known(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the matrix with the three attributes as known on its date."""
    return _p6(spark, d).select("row_id", *[F.col(r).alias(s) for s, r in _P6_PAIRS.items()])


_P6_CTE = """
WITH keys AS (SELECT DISTINCT issuer, date FROM model_features_daily),
facts AS (SELECT q.*, c.call_date FROM nlp_quarterly q JOIN call_dates c USING (issuer, fiscal_quarter)),
days AS (SELECT k.issuer, k.date, k.date - max(c.call_date) AS days_known FROM keys k LEFT JOIN call_dates c ON c.issuer = k.issuer AND c.call_date <= k.date GROUP BY k.issuer, k.date),
ceo AS (SELECT k.issuer, k.date, transcript_ceo_prep_sentiment_mean AS ceo_known FROM keys k JOIN facts f ON f.issuer = k.issuer AND f.known_from <= k.date
  AND f.transcript_ceo_prep_sentiment_mean IS NOT NULL AND NOT isnan(f.transcript_ceo_prep_sentiment_mean)
  QUALIFY row_number() OVER (PARTITION BY k.issuer, k.date ORDER BY f.call_date DESC, f.known_from DESC, f.version DESC) = 1),
aml AS (SELECT k.issuer, k.date, topic_regulatory_AML_share AS aml_known FROM keys k JOIN facts f ON f.issuer = k.issuer AND f.known_from <= k.date
  AND f.topic_regulatory_AML_share IS NOT NULL AND NOT isnan(f.topic_regulatory_AML_share)
  QUALIFY row_number() OVER (PARTITION BY k.issuer, k.date ORDER BY f.call_date DESC, f.known_from DESC, f.version DESC) = 1),
x AS (SELECT m.*, days_known, ceo_known, aml_known FROM model_features_daily m JOIN days USING (issuer, date) LEFT JOIN ceo USING (issuer, date) LEFT JOIN aml USING (issuer, date))
"""

P6_SQL = _P6_CTE + """
SELECT row_id, 'days_since_call' AS field FROM x WHERE days_since_call IS DISTINCT FROM days_known
UNION ALL SELECT row_id, 'transcript_ceo_prep_sentiment_mean_ffill' FROM x WHERE (transcript_ceo_prep_sentiment_mean_ffill IS NULL) <> (ceo_known IS NULL) OR abs(transcript_ceo_prep_sentiment_mean_ffill - ceo_known) > 1e-9
UNION ALL SELECT row_id, 'topic_regulatory_AML_share_ffill' FROM x WHERE (topic_regulatory_AML_share_ffill IS NULL) <> (aml_known IS NULL) OR abs(topic_regulatory_AML_share_ffill - aml_known) > 1e-9
"""

P6_KNOWN_SQL = _P6_CTE + "SELECT row_id, CAST(days_known AS INTEGER) AS days_since_call, ceo_known AS transcript_ceo_prep_sentiment_mean_ffill, aml_known AS \"topic_regulatory_AML_share_ffill\" FROM x"

QUERIES = {
    "p1_found": p1_found,
    "p1_filled": p1_filled,
    "p2_found": p2_found,
    "p2_windows": p2_windows,
    "p3_found": p3_found,
    "p3_alarms": p3_alarms,
    "p3_profile": p3_profile,
    "p3_table_alarms": p3_table_alarms,
    "p3_watch": p3_watch,
    "p3_rates": p3_rates,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_faults": p4_faults,
    "p5_found": p5_found,
    "p5_grid": p5_grid,
    "p5_turnover": p5_turnover,
    "p6_found": p6_found,
    "p6_known": p6_known,
}

ORACLE = {
    "p1_found": P1_SQL,
    "p1_filled": P1_FILLED_SQL,
    "p2_found": P2_SQL,
    "p2_windows": P2_WINDOWS_SQL,
    "p3_counts": P3_COUNTS_SQL,
    "p3_rates": P3_RATES_SQL,
    "p5_found": P5_SQL,
    "p5_grid": P5_GRID_SQL,
    "p5_turnover": P5_TURNOVER_SQL,
    "p6_found": P6_SQL,
    "p6_known": P6_KNOWN_SQL,
}
