"""Chunk records of the three kinds of documents: releases, reports, transcripts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.text.chunks import chunk, rough_count, with_chunk_ids
from tidemark.text.clean import SECTIONS, clean_text, sections_or_body
from tidemark.text.turns import transcript

OUT = ("chunk_id", "source_type", "doc_id", "section", "chunk_no", "chunk", "token_count")


def _records(x: DataFrame, source: str, keep: Sequence[str], sizes: dict[str, int], count: Callable[[str], int]) -> DataFrame:
    c = chunk(x.withColumn("source_type", F.lit(source)), "__text", count=count, **sizes)
    return with_chunk_ids(c, "source_type", "doc_id", "section").select(*OUT, *keep)


def release_chunks(docs: DataFrame, *, headline: str = "headline", body: str = "text", source: str = "news", keep: Sequence[str] = (), count: Callable[[str], int] = rough_count, **sizes: int) -> DataFrame:
    """Chunks of releases: the headline, a blank line, the cleaned body; section press_release.

    Needs doc_id. A NULL or empty headline leaves the body alone; a release
    whose body is empty once cleaned has no chunk. ``sizes`` are target, most
    and least of ``chunk``; ``keep`` names columns that come along.
    """
    x = docs.withColumn("__text", clean_text(F.col(body))).where("__text <> ''")
    head = F.trim(F.coalesce(F.col(headline), F.lit("")))
    x = x.withColumn("__text", F.when(head != "", F.concat(head, F.lit("\n\n"), "__text")).otherwise(F.col("__text"))).withColumn("section", F.lit("press_release"))
    return _records(x, source, keep, sizes, count)


def report_chunks(docs: DataFrame, *, text: str = "text", source: str = "reports_quarterly", least_chars: int = 500, headings: Sequence[str] = SECTIONS, keep: Sequence[str] = (), count: Callable[[str], int] = rough_count, **sizes: int) -> DataFrame:
    """Chunks of reports by section, of those whose cleaned text has at least ``least_chars`` characters; a text with fewer than two sections is one, body.

    Chunks are numbered within a section of a document; where a heading comes
    again, chunk_id is the same as of the section before of that name.
    """
    x = docs.withColumn("__clean", clean_text(F.col(text))).where(F.length("__clean") >= least_chars)
    x = x.withColumn("__s", F.explode(sections_or_body(F.col("__clean"), headings))).withColumns({"section": F.col("__s.section"), "__text": F.col("__s.text")})
    return _records(x, source, keep, sizes, count)


def transcript_chunks(docs: DataFrame, *, text: str = "text", source: str = "transcripts", keep: Sequence[str] = (), count: Callable[[str], int] = rough_count, **sizes: int) -> DataFrame:
    """Chunks of transcripts, turn by turn, each cleaned by itself, with turn (its place in the document) and speaker (name, role, affiliation).

    Sections are prepared_remarks and qa; chunks are numbered within a turn.
    Turns that are empty once cleaned, and texts without a speaker line, have none.
    """
    x = docs.select("*", F.posexplode(transcript(F.col(text))).alias("turn", "__t")).withColumn("__text", clean_text(F.col("__t.text"))).where("__text <> ''")
    x = x.withColumns({"section": F.col("__t.section"), "speaker": F.struct(F.col("__t.speaker_name").alias("name"), F.col("__t.role").alias("role"), F.col("__t.affiliation").alias("affiliation"))})
    c = _records(x, source, ["turn", "speaker", *keep], sizes, count)
    return c.withColumn("chunk_id", F.format_string("%s:%s:%s:t%d:%03d", "source_type", F.col("doc_id").cast("string"), "section", "turn", "chunk_no"))
