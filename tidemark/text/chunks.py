"""Texts cut into chunks along paragraphs and sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a sentence ends before white space that a capital, a figure or a quotation mark follows.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\"'“])"


def rough_count(text: str) -> int:
    """Tokens: a fourth of the characters, rounded down, at least 1."""
    return max(1, len(text) // 4)


def sentences(text: Column) -> Column:
    """The sentences of a text, stripped, none empty."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def pieces(text: str | None, target: int = 1800, most: int = 4000, least: int = 200, count: Callable[[str], int] = rough_count) -> list[str]:
    """Chunks of about ``target`` tokens.

    Paragraphs gather until the next would pass target, once they make
    ``least``. A paragraph beyond ``most`` is cut into sentences, which gather
    up to target. A last chunk below least joins the one before it.
    """
    made: list[str] = []

    def gather(units: list[str], glue: str, floor: int) -> None:
        held: list[str] = []
        size = 0
        for u in units:
            n = count(u)
            if held and size >= floor and size + n > target:
                made.append(glue.join(held))
                held, size = [], 0
            held.append(u)
            size += n
        if held:
            made.append(glue.join(held))

    run: list[str] = []
    for p in filter(None, map(str.strip, re.split(r"\n{2,}", text or ""))):
        if count(p) <= most:
            run.append(p)
            continue
        gather(run, "\n\n", least)
        run = []
        gather([s for s in map(str.strip, re.split(SENTENCE_END, p)) if s], " ", 0)
    gather(run, "\n\n", least)
    if len(made) > 1 and count(made[-1]) < least:
        tail = made.pop()
        made[-1] += "\n\n" + tail
    return made


def chunk(docs: DataFrame, text: str, *, target: int = 1800, most: int = 4000, least: int = 200, count: Callable[[str], int] = rough_count) -> DataFrame:
    """Every row of ``docs`` once per chunk of its text: all other columns, chunk_no from 0, chunk, token_count.

    Packing carries state from paragraph to paragraph, so it runs in Python
    over Arrow batches, without a shuffle; the other columns don't travel.
    NULL and empty texts have no chunk. Columns named like an output are replaced.
    """

    @F.pandas_udf("array<struct<chunk: string, token_count: int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"chunk": c, "token_count": count(c)} for c in pieces(t, target, most, least, count)] for t in texts])

    keep = [c for c in docs.columns if c not in ("chunk_no", "chunk", "token_count") and c != text]
    x = docs.select(*keep, F.posexplode(cut(F.col(text))).alias("chunk_no", "__c"))
    return x.select(*keep, "chunk_no", "__c.chunk", "__c.token_count")


def with_chunk_ids(chunks: DataFrame, source: str, doc_id: str, section: str) -> DataFrame:
    """chunk_id = source:document:section:nnn."""
    return chunks.withColumn("chunk_id", F.format_string("%s:%s:%s:%03d", F.col(source).cast("string"), F.col(doc_id).cast("string"), F.col(section).cast("string"), F.col("chunk_no")))
