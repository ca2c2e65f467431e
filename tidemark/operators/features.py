"""Quarterly values made into daily ones, and signals that fade from an event on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import decay, row_mean, row_std
from tidemark.operators.asof import asof
from tidemark.operators.rolling import Series


def with_changes(quarters: DataFrame, s: Series, columns: Sequence[str], memory: int = 4) -> DataFrame:
    """Each column's difference from the quarter before (_delta) and from the mean of up to ``memory`` quarters before (_surprise)."""
    by = f"PARTITION BY {', '.join(s.entity)} " if s.entity else ""
    over = f"{by}ORDER BY {', '.join(s.order)}"
    # as text: a call to the driver's JVM for each column, not for each part of it
    deltas = [f"`{c}` - lag(`{c}`) OVER ({over}) AS `{c}_delta`" for c in columns]
    surprises = [f"`{c}` - avg(`{c}`) OVER ({over} ROWS BETWEEN {memory} PRECEDING AND 1 PRECEDING) AS `{c}_surprise`" for c in columns]
    return quarters.selectExpr("*", *deltas, *surprises)


def project_daily(spine: DataFrame, quarters: DataFrame, *, entity: Sequence[str], date: str, known: str, columns: Sequence[str]) -> DataFrame:
    """``spine`` with c_ffill, c_delta and c_surprise of each column, as known on the row's date, days_since_call and is_earnings_week.

    Column by column: where a quarter has no value the one before it stays.
    """
    q = quarters.withColumnsRenamed({c: f"{c}_ffill" for c in columns})
    cols = [f"{c}_{k}" for c in columns for k in ("ffill", "delta", "surprise")]
    x = asof(spine, q, entity=entity, date=date, fact_date=known, columns=cols, distance="days_since_call")
    return x.withColumn("is_earnings_week", F.coalesce((F.col("days_since_call") <= 5).cast("int"), F.lit(0)))


#: The signals of ``event_signals``, in its order.
EVENTS = (
    "evt_ceo_tone", "evt_cfo_tone", "evt_framing_gap", "evt_aml_pressure", "evt_aml_shift", "evt_guidance_strength", "evt_guidance_shift", "evt_macro_topic", "evt_topic_entropy", "evt_news_tone", "evt_news_flow",
    "evt_broad_topic_signal", "evt_broad_topic_shift", "evt_cfo_lead", "evt_ceo_surprise", "evt_analyst_qa_tone", "evt_exec_scripted_gap", "evt_source_dispersion", "evt_transcript_reliability",
    "evt_exec_tone", "evt_guidance_topic", "evt_guidance_sentiment", "evt_aml_topic", "evt_aml_sentiment",
)


def event_signals(
    df: DataFrame,
    *,
    pressure: tuple[str, str],
    guidance: tuple[str, str],
    outlook: tuple[str, str],
    broad: Sequence[tuple[str, str]],
    ceo: str = "transcript_ceo_prep_sentiment_mean",
    cfo: str = "transcript_cfo_prep_sentiment_mean",
    answers: str = "transcript_exec_qa_sentiment_mean",
    questions: str = "transcript_analyst_qa_sentiment_mean",
    spread: str = "transcript_sentiment_std",
    news: str = "news_sentiment_mean",
    report: str = "report_sentiment_mean",
    gap: str = "framing_gap",
    entropy: str = "topic_entropy",
    news_mean: str = "news_sent_mean_30d",
    news_count: str = "news_count_30d",
    days_since_call: str = "days_since_call",
    days_since_news: str = "days_since_last_news",
    call_scale: float = 20.0,
    news_scale: float = 15.0,
) -> DataFrame:
    """``df`` with EVENTS, signals that fade from the last call, or the last news, on, and exec_tone_ffill.

    Names are of quarterly columns without suffix; of each df has _ffill, of
    ceo _surprise too and, for topics (pairs of share and sentiment), _delta. A
    signal is NULL where a part of it is; broad ones are means over the pairs
    that have a value, dispersion and executives' tone over the sources that do.
    """
    call, recent = decay(F.col(days_since_call), call_scale), decay(F.col(days_since_news), news_scale)
    level, delta = (lambda c: F.col(f"{c}_ffill")), (lambda c: F.col(f"{c}_delta"))

    def tilt(p: tuple[str, str]) -> Column:
        return level(p[0]) * (level(p[1]) - 0.5)

    def shift(p: tuple[str, str]) -> Column:
        return F.abs(delta(p[0])) + F.abs(delta(p[1]))

    executives = row_mean(level(ceo), level(cfo))
    since_call = {
        "ceo_tone": level(ceo),
        "cfo_tone": level(cfo),
        "framing_gap": level(gap),
        "aml_pressure": level(pressure[0]) * (1 - level(pressure[1])),
        "aml_shift": shift(pressure),
        "guidance_strength": level(guidance[0]) * level(guidance[1]),
        "guidance_shift": delta(guidance[0]) + delta(guidance[1]),
        "macro_topic": tilt(outlook),
        "topic_entropy": level(entropy),
        "broad_topic_signal": row_mean(*map(tilt, broad)),
        "broad_topic_shift": row_mean(*map(shift, broad)),
        "cfo_lead": level(cfo) - level(ceo),
        "ceo_surprise": F.col(f"{ceo}_surprise"),
        "analyst_qa_tone": level(questions),
        "exec_scripted_gap": level(answers) - level(ceo),
        "source_dispersion": row_std(level(ceo), level(news), level(report)),
        "transcript_reliability": 1 / (1 + level(spread)),
        "exec_tone": executives,
        "guidance_topic": level(guidance[0]),
        "guidance_sentiment": level(guidance[1]),
        "aml_topic": level(pressure[0]),
        "aml_sentiment": level(pressure[1]),
    }
    since_news = {"news_tone": F.col(news_mean), "news_flow": F.log1p(F.col(news_count).cast("double"))}
    return df.withColumns({
        **{f"evt_{k}": v * call for k, v in since_call.items()},
        **{f"evt_{k}": v * recent for k, v in since_news.items()},
        "exec_tone_ffill": executives,
    })


def flips(df: DataFrame, s: Series, c: str, w: int, name: str = "flips") -> DataFrame:
    """``df`` with the number of sign changes of c over the last w rows, NULL where one is unknown."""
    x = df.withColumn("__turn", (F.signum(F.col(c)) != F.signum(s.lag(c))).cast("int"))
    return x.withColumn(name, s.sum("__turn", w)).drop("__turn")


def persistence(df: DataFrame, s: Series, c: str, w: int, name: str = "autocorrelation") -> DataFrame:
    """``df`` with the correlation of c with its own value a row before, over the last w such pairs; NULL where one is missing or nothing varies."""
    x = df.withColumn("__before", s.lag(c))
    return x.withColumn(name, s.corr(c, "__before", w)).drop("__before")
