"""Annotation of chunks by a model that is passed in: keys, prompts, answers, what is still to do."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import clamp, content_key
from tidemark.operators.narrative import TOPICS
from tidemark.text.clean import is_administrative, is_table_heavy

ANSWER = "sentiment string, sentiment_score double, topics array<string>, key_quote string"


def worth_annotating(chunks: DataFrame, least_tokens: int = 45) -> DataFrame:
    """Chunks with enough tokens that aren't tables nor, in transcripts, administrative; the cheap test first."""
    c = chunks.where(F.col("token_count") >= least_tokens)
    return c.where(~is_table_heavy(F.col("chunk")) & ~((F.col("source_type") == "transcripts") & is_administrative(F.col("chunk"), F.col("role"))))


def pending(chunks: DataFrame, done: DataFrame, text: str, prompt_version: str, model: str) -> DataFrame:
    """Chunks, with cache_key, whose key isn't among ``done``'s."""
    keyed = chunks.drop("cache_key").withColumn("cache_key", content_key(F.col(text), F.lit(prompt_version), F.lit(model)))
    return keyed.join(done.select("cache_key").where("cache_key is not null"), on="cache_key", how="left_anti")


def prompt(source: Column, quarter: Column, section: Column, speaker: Column, role: Column, text: Column, topics: Sequence[str] = TOPICS) -> Column:
    """What the model is asked about a chunk: what it is, its text, the answer's form; NULL parts are empty, the speaker's line is there only with a name."""
    s = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("Excerpt of "), s(source), F.lit(", "), s(quarter), F.lit(", part "), s(section), F.lit("."))
    who = F.when(s(speaker) != "", F.concat(F.lit("Said by "), speaker, F.lit(", "), s(role), F.lit(".")))
    ask = (
        "Judge its tone. Answer in JSON alone, an object of four fields: sentiment (positive, neutral, negative), sentiment_score (a number between -1 and 1), "
        f"topics (a list of one to three of: {', '.join(topics)}) and key_quote (the excerpt's point in one sentence of up to 20 words)."
    )
    return F.concat_ws("\n", head, who, F.lit("<excerpt>"), text, F.lit("</excerpt>"), F.lit(ask))


def parse_answer(answer: Column, topics: Sequence[str] = TOPICS) -> Column:
    """STRUCT of ANSWER, or NULL where the JSON or a field of it is unusable. Fences are stripped, scores clamped, unknown topics dropped, ["other"] where none is left."""
    body = F.regexp_replace(F.trim(answer), r"(?s)^```(?:json)?\s*|\s*```.*$", "")
    x = F.from_json(F.regexp_replace(body, "^`+|`+$", ""), ANSWER)
    known = F.filter(x["topics"], lambda t: t.isin(*topics))
    ok = x["sentiment"].isin("positive", "neutral", "negative") & x["sentiment_score"].isNotNull() & ~F.isnan(x["sentiment_score"]) & x["topics"].isNotNull()
    return F.when(ok, F.struct(
        x["sentiment"].alias("sentiment"), clamp(x["sentiment_score"]).alias("sentiment_score"),
        F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("other"))).alias("topics"), F.substring(x["key_quote"], 1, 200).alias("key_quote"),
    ))


def annotate(chunks: DataFrame, ask: str, model: Callable[[list[str]], list[str | None]], *, batch: int = 20, attempts: int = 2) -> DataFrame:
    """``chunks`` with the model's answer to the prompt in column ``ask``, parsed, as output (NULL where no attempt gave a usable one).

    The model gets up to ``batch`` prompts at a time, in the task that holds
    them; what it couldn't answer is asked again, up to ``attempts`` times in
    all. A lost task asks anew, so a model should be safe to ask twice.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in chunks.schema if f.name != 'answer')}, answer string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got: list[str | None] = [None] * len(f)
            for _ in range(attempts):
                todo = [i for i, a in enumerate(got) if a is None]
                for k in range(0, len(todo), batch):
                    part = todo[k : k + batch]
                    for i, a in zip(part, model([f[ask].iloc[i] for i in part])):
                        got[i] = a
            yield f.assign(answer=got)

    x = chunks.drop("answer").mapInPandas(run, schema)
    return x.withColumn("output", parse_answer(F.col("answer"))).drop("answer")


def second_score(positive: Column, negative: Column, neutral: Column) -> Column:
    """STRUCT<label, score> of a three-way classifier: the likeliest label (positive, negative, neutral on ties), score positive less negative."""
    top = F.greatest(positive, negative, neutral)
    label = F.when(positive == top, "positive").when(negative == top, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), (positive - negative).alias("score"))
