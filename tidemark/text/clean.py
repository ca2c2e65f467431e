"""Cleaning, sections and table tests of document texts, as Columns: everything stays in the row and in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that mark boilerplate paragraphs, lines of page furniture, section headings and words of introductions.
BOILERPLATE = (
    r"forward[-\s]?looking statements?",
    r"safe harbor",
    r"private securities litigation reform act",
    r"this document and other documents? filed or furnished",
    r"non[-\s]?gaap (financial )?measures",
    r"please refer to (our|td's|the bank's) annual report",
    r"toronto[-\s]dominion bank\s*\(td\)\s*operates",
    r"for further information:?\s*$",
    r"members of the media",
    r"td bank group is a subsidiary of the toronto",
    r"the information in this document",
    r"the material in this report",
)
PAGE_LINES = (
    r"page\s+\d+\s+of\s+\d+",
    r"^\s*\d+\s*$",
    r"^\s*-\s*\d+\s*-\s*$",
    r"td bank group\s*\|\s*(q[1-4]|quarterly).*(conference call|transcript)",
)
SECTIONS = (
    "business overview", "how we performed", "financial highlights", "management's discussion and analysis", "operating environment", "economic summary and outlook",
    "accounting policies and estimates", "financial results overview", "business segment results", "canadian personal and commercial banking", "u.s. retail",
    "wealth management and insurance", "wholesale banking", "corporate segment", "balance sheet review", "risk factors", "managing risk", "credit risk", "market risk",
    "liquidity risk", "operational risk", "capital position", "regulatory developments", "significant and subsequent events", "controls and procedures",
)
INTRODUCTIONS = ("introduced", "introduce", "leadership team", "participants", "presenting", "joining", "welcome", "moderator", "operator")
NUMERIC_TOKEN = r"^[\d,.\$%\(\)\-\/\|]+$"


def strip(c: Column) -> Column:
    """White space, of any kind, off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def any_of(patterns: Sequence[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def paragraphs(text: Column) -> Column:
    """The parts between blank lines, stripped, none empty."""
    return F.filter(F.transform(F.split(text, r"\n{2,}"), strip), lambda p: p != "")


def clean_text(text: Column, boilerplate: Sequence[str] = BOILERPLATE, page_lines: Sequence[str] = PAGE_LINES) -> Column:
    """Paragraphs without page furniture (below 100 characters) and boilerplate (below 400), white space collapsed, a blank line between; "" for NULL and empty texts.

    Single line breaks become blanks, so that only what is a paragraph of its own can be a heading afterwards.
    """
    page = lambda p: p.rlike(any_of(page_lines)) & (F.length(p) < 100)
    stock = lambda p: F.lower(p).rlike(any_of(boilerplate)) & (F.length(p) < 400)
    kept = F.filter(paragraphs(F.coalesce(text, F.lit(""))), lambda p: ~page(p) & ~stock(p))
    flat = F.transform(kept, lambda p: strip(F.regexp_replace(F.regexp_replace(p, r"[ \t]+", " "), r"(?U)\s*\n\s*", " ")))
    return F.array_join(flat, "\n\n")


def sections(text: Column, headings: Sequence[str] = SECTIONS) -> Column:
    """ARRAY<STRUCT<section, text>>: what stands under each heading line, case aside, in order; before the first, "preamble". Empty ones are left out.

    Heading lines are marked by one replacement and the text split at the
    marks: one pass, however many lines there are.
    """
    lines = "|".join("\\Q" + h + "\\E" for h in headings)
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x01\\x02]", ""), rf"(?im)^[^\S\n]*({lines})[^\S\n]*$", "\u0001$1\u0002")
    parts = F.transform(
        F.split(marked, "\u0001"),
        lambda p, i: F.when(i == 0, F.struct(F.lit("preamble").alias("section"), strip(p).alias("text"))).otherwise(
            F.struct(F.lower(strip(F.substring_index(p, "\u0002", 1))).alias("section"), strip(F.substring_index(p, "\u0002", -1)).alias("text"))
        ),
    )
    return F.filter(parts, lambda s: s["text"] != "")


def sections_or_body(text: Column, headings: Sequence[str] = SECTIONS) -> Column:
    """``sections``, or all of the text as "body" where there are fewer than two."""
    s = sections(text, headings)
    whole = F.array(F.struct(F.lit("body").alias("section"), F.coalesce(text, F.lit("")).alias("text")))
    return F.when(F.size(s) > 1, s).otherwise(whole)


def table_share(text: Column) -> Column:
    """Share of the words that are figures and symbols only; NULL without words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return F.try_divide(F.size(F.filter(words, lambda w: w.rlike(NUMERIC_TOKEN))), F.size(words))


def is_table_heavy(text: Column, most: float = 0.40) -> Column:
    """Whether more than ``most`` of the words are figures; true without words."""
    return F.coalesce(table_share(text) > most, F.lit(True))


def is_administrative(text: Column, role: Column, words: Sequence[str] = INTRODUCTIONS, below: int = 80) -> Column:
    """Whether the speaker is investor relations, or the text is short and introduces somebody."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.size(F.filter(F.split(low, r"(?U)\s+"), lambda w: w != ""))
    named = low.rlike("|".join(words))
    return (F.coalesce(role, F.lit("")) == "ir") | ((n < below) & named)
