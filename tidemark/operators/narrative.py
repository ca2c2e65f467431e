"""Nested annotations made into features of a period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The topic labels, in their usual order.
TOPICS = ("NIM", "credit_quality", "capital", "US_retail", "Canadian_personal", "wealth_wholesale", "regulatory_AML", "macro_outlook", "cost_efficiency", "guidance", "M_and_A", "other")


def conditional_means(notes: DataFrame, by: Sequence[str], score: str, conditions: Mapping[str, Column], topics: str, labels: Sequence[str] = TOPICS, aside: Sequence[str] = ("other",), extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per ``by``: n, the mean score under each condition, and for each label its share, mean score, and the entropy over labels.

    A label's share is its mentions over all rows, to four places (a label
    twice in one row counts twice); its sentiment the mean score of its
    mentions. Entropy is in bits over the mentions of labels not ``aside``, to
    four places, 0 without any. Means are NULL where nothing qualifies.

    ``extra`` aggregates by name come along.

    One aggregation, combined before the shuffle; arrays are not exploded.
    NULL scores count as rows but enter no mean, NULL arrays mention nothing.
    """
    has = F.col(score).isNotNull()
    held = F.coalesce(F.col(topics), F.array().cast("array<string>"))
    mentions = {t: F.size(held) - F.size(F.array_remove(held, t)) for t in labels}
    aggs = [F.count("*").alias("n")]
    aggs += [F.avg(F.when(c, F.col(score))).alias(k) for k, c in conditions.items()]
    aggs += [c.alias(k) for k, c in (extra or {}).items()]
    for i, t in enumerate(labels):
        aggs += [F.sum(mentions[t]).alias(f"__c{i}"), F.sum(F.when(has, mentions[t])).alias(f"__k{i}"), F.sum(F.when(has, mentions[t] * F.col(score))).alias(f"__s{i}")]
    x = notes.groupBy(*by).agg(*aggs)
    cols = [*by, "n", *conditions, *(extra or {})]
    for i, t in enumerate(labels):
        cols += [F.bround(F.col(f"__c{i}") / F.col("n"), 4).alias(f"topic_{t}_share"), F.try_divide(f"__s{i}", f"__k{i}").alias(f"topic_{t}_sentiment")]
    counted = [F.col(f"__c{i}") for i, t in enumerate(labels) if t not in aside]
    total = sum(counted[1:], counted[0])
    parts = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counted]
    return x.select(*cols, F.when(total > 0, F.bround(sum(parts[1:], parts[0]), 4)).otherwise(0.0).alias("topic_entropy"))


def quarterly(notes: DataFrame, by: Sequence[str], last_quarter: str | None = None, labels: Sequence[str] = TOPICS) -> DataFrame:
    """The sentiment and topic features of each quarter; needs quarter, source_type, section, role, score, topics.

    Means by source, section and role; transcript_sentiment_std is a population
    deviation, NULL for a single score; report_sentiment_mean takes quarterly
    reports and else the annual one. Quarters after ``last_quarter``, compared
    as text, are left out.
    """
    src, sec, role = F.col("source_type"), F.coalesce("section", F.lit("")), F.coalesce("role", F.lit(""))
    call = src == "transcripts"
    conditions = {
        "transcript_ceo_prep_sentiment_mean": call & (sec == "prepared_remarks") & (role == "ceo"),
        "transcript_cfo_prep_sentiment_mean": call & (sec == "prepared_remarks") & (role == "cfo"),
        "transcript_exec_qa_sentiment_mean": call & (sec == "qa") & role.isin("ceo", "cfo", "other_exec"),
        "transcript_analyst_qa_sentiment_mean": call & (sec == "qa") & (role == "analyst"),
        "news_sentiment_mean": src == "news",
        "report_40f_sentiment_mean": src == "reports_40f",
        "report_quarterly_sentiment_mean": src == "reports_quarterly",
    }
    n = notes if last_quarter is None else notes.where(F.col("quarter") <= last_quarter)
    n = n.where(F.col("quarter").isNotNull())
    t = F.when(call, F.col("score"))
    spread = {"transcript_sentiment_std": F.when(F.count(t) > 1, F.stddev_pop(t))}
    x = conditional_means(n, by, "score", conditions, "topics", labels, extra=spread).withColumn("report_sentiment_mean", F.coalesce("report_quarterly_sentiment_mean", "report_40f_sentiment_mean"))
    return x.withColumn("framing_gap", F.col("transcript_ceo_prep_sentiment_mean") - F.col("report_sentiment_mean")).withColumnRenamed("n", "n_chunks_annotated")


def label_table(notes: DataFrame, by: str, labels: str, values: Sequence[str]) -> DataFrame:
    """by x label counts of an array of labels, missing ones 0: one column per value."""
    x = notes.select(by, F.explode(labels).alias("__l"))
    return x.groupBy(by).pivot("__l", list(values)).count().na.fill(0)


def shares_by_row(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts divided by their row's total; NULL where that is 0."""
    total = sum((F.col(c) for c in columns), F.lit(0))
    return counts.select(*[c for c in counts.columns if c not in columns], *[F.try_divide(F.col(c), total).alias(c) for c in columns])


def extreme_quotes(notes: DataFrame, labels: str, score: str, quote: str, tie: str) -> DataFrame:
    """Per label the quotes of its lowest and highest score; of equals the one with the least ``tie``."""
    x = notes.where(F.col(score).isNotNull()).select(F.explode(F.array_distinct(labels)).alias("label"), score, quote, tie)
    low = F.min(F.struct(score, tie, quote))
    high = F.min(F.struct((-F.col(score)).alias("s"), tie, quote))
    y = x.groupBy("label").agg(low.alias("a"), high.alias("b"))
    return y.select("label", F.col(f"a.{score}").alias("low_score"), F.col(f"a.{quote}").alias("low_quote"), (-F.col("b.s")).alias("high_score"), F.col(f"b.{quote}").alias("high_quote"))


def counts_over(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """Rows per value, every one of ``values`` there, 0 where it never occurs."""
    all_ = df.sparkSession.createDataFrame([(v,) for v in values], df.select(column).schema)
    return all_.join(df.groupBy(column).agg(F.count("*").alias("n")), on=column, how="left").na.fill(0, ["n"])


def stratified(df: DataFrame, by: str, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n rows of each group, picked by a hash of the row's id: the same on every run, whatever the partitioning.

    Only the n least hashes of a group are ever gathered, in an aggregate that
    keeps n values, so that a large group costs no more than a small one.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col(row_id)))
    w = Window.partitionBy(by).orderBy("__h", row_id)
    first = Window.partitionBy(by, "__b").orderBy("__h", row_id)
    x = df.withColumn("__h", key).withColumn("__b", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(row_id)), F.lit(64)))
    x = x.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n)  # a large group in 64 parts
    return x.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__h", "__b", "__r")


def agreement(a: DataFrame, b: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """How two annotators' (key, score) agree: pairs, pairs in which both are clearly signed, share of those with one sign, Pearson correlation of all pairs.

    Scores within 0.05 of zero have no sign. NULL scores pair with nothing.
    """
    j = a.where("score is not null").select(key, *by, F.col("score").alias("x")).join(b.where("score is not null").select(key, F.col("score").alias("y")), on=key)
    sign = lambda c: F.when(F.col(c) > 0.05, 1).when(F.col(c) < -0.05, -1).otherwise(0)
    j = j.withColumn("both", (sign("x") != 0) & (sign("y") != 0)).withColumn("same", F.when(F.col("both"), (sign("x") == sign("y")).cast("int")))
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("both").cast("long")).alias("n_signed"), F.avg("same").alias("agreement"), r.alias("r"))
