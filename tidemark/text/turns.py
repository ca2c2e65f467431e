"""Transcripts: prepared remarks and questions, speaker turns, roles; Columns that stay in the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.text.clean import strip

# How a speaker line, the head of the questions and their implicit beginning look, and words that no person's name begins or ends with.
SPEAKER_LINE = r"^\s*([A-Z][A-Za-z'\-\.]+(?:\s+[A-Z][A-Za-z'\-\.]+){0,3})(?:\s*[-–—,]\s*([^,\n]{3,120}))?\s*$"
QUESTIONS_HEAD = r"(?im)^\s*(?:questions?\s*(?:and|&)\s*answers?|q\s*&\s*a|question[-\s]and[-\s]answer|Q\s+U\s+E\s+S\s+T\s+I\s+O\s+N\s+A\s+N\s+D\s+A\s+N\s+S\s+W\s+E\s+R)\s*$"
QUESTIONS_BEGIN = r"(?im)(?=^(?:Thank you[,.]?\s+)?We(?:'ll| will) now take questions from the telephone)"
NOT_FIRST = (
    "in", "on", "at", "to", "the", "we", "our", "as", "for", "this", "that", "these", "those", "a", "an", "and", "or", "but", "if", "when", "while", "with",
    "also", "thank", "convenient", "wholesale", "td", "wealth", "investor", "complete", "income", "united", "tech", "djsi",
)
NOT_LAST = ("management", "markets", "rewards", "checking", "survey", "index", "banking", "technologies", "solutions", "payments", "program", "programme", "fund", "bank")
NOT_NAMES = ("convenient bank", "td bank group")
EXECUTIVES = ("ceo", "cfo", "other_exec")


def role_of(name: Column, affiliation: Column) -> Column:
    """operator, analyst, ceo, cfo, other_exec, ir or other: the first rule that fits, so that a vice president of investor relations is other_exec."""
    a = F.lower(F.coalesce(affiliation, F.lit("")))
    return (
        F.when(F.lower(F.coalesce(name, F.lit(""))) == "operator", "operator")
        .when(a.rlike("analyst|research"), "analyst")
        .when(a.rlike("chief executive|ceo"), "ceo")
        .when(a.rlike("chief financial|cfo"), "cfo")
        .when(a.rlike("group head|president|chief"), "other_exec")
        .when(a.rlike("investor relations|ir head"), "ir")
        .otherwise("other")
    )


def plausible_name(name: Column) -> Column:
    """Whether this may be a person: two to five words, not beginning or ending like a product or sentence; "operator" is one."""
    n = F.lower(strip(F.coalesce(name, F.lit(""))))
    parts = F.split(n, r"(?U)\s+")
    person = F.size(parts).between(2, 5) & ~F.get(parts, F.lit(0)).isin(*NOT_FIRST) & ~F.element_at(parts, -1).isin(*NOT_LAST) & ~n.isin(*NOT_NAMES)
    return (n == "operator") | ((n != "") & person)


def split_questions(text: Column, head: str = QUESTIONS_HEAD, begin: str = QUESTIONS_BEGIN) -> Column:
    """STRUCT<prepared, questions>: parted at the first ``head`` line, which is dropped, else before the first ``begin``; else all is prepared.

    ``begin`` matches a place, not text. It may be the very beginning of the text.
    """
    t = F.coalesce(text, F.lit(""))
    # a character in front, so that a place at the beginning parts too
    first = F.split(F.concat(F.lit("\n"), t), begin, 2)
    parts = F.split(t, head, 2)
    parts = F.when(F.size(parts) == 2, parts).when(F.size(first) == 2, F.transform(first, lambda p, i: F.when(i == 0, F.substring(p, 2, 1 << 30)).otherwise(p))).otherwise(F.array(t, F.lit("")))
    return F.struct(F.get(parts, F.lit(0)).alias("prepared"), F.get(parts, F.lit(1)).alias("questions"))


def turns(block: Column) -> Column:
    """ARRAY<STRUCT<speaker_name, affiliation, role, text>> of a block.

    A speaker line is under 160 characters, doesn't end in a stop and names an
    affiliation or the operator. What follows it is the turn: lines joined by
    blanks, blank lines as breaks. Lines before the first speaker and turns
    without text are left out.
    """
    lines = F.transform(F.split(F.coalesce(block, F.lit("")), r"\r\n|[\n\r\x0b\x0c]"), strip)

    def speaks(ln: Column) -> Column:
        named = F.regexp_extract(ln, SPEAKER_LINE, 1)
        return (named != "") & (F.length(ln) < 160) & ~ln.endswith(".") & ((F.regexp_extract(ln, SPEAKER_LINE, 2) != "") | (F.lower(named) == "operator"))

    at = F.filter(F.transform(lines, lambda ln, i: F.when(speaks(ln), i)), lambda i: i.isNotNull())

    def turn(i: Column, k: Column) -> Column:
        ln = F.get(lines, i)
        end = F.coalesce(F.get(at, k + 1), F.size(lines))
        said = F.transform(F.slice(lines, i + 2, end - i - 1), lambda x: F.when(x == "", "\n").otherwise(F.concat(F.lit(" "), x)))
        name, affiliation = strip(F.regexp_extract(ln, SPEAKER_LINE, 1)), strip(F.regexp_extract(ln, SPEAKER_LINE, 2))
        return F.struct(name.alias("speaker_name"), affiliation.alias("affiliation"), role_of(name, affiliation).alias("role"), strip(F.array_join(said, "")).alias("text"))

    return F.filter(F.transform(at, turn), lambda t: t["text"] != "")


def inherit_executive(prepared: Column) -> Column:
    """Turns in which an "other" that is no person's name takes name, role and affiliation of the last executive before it."""

    def heir(t: Column, i: Column) -> Column:
        before = F.filter(F.slice(prepared, 1, i), lambda x: x["role"].isin(*EXECUTIVES))
        last = F.when(F.size(before) > 0, F.element_at(before, -1))
        takes = (t["role"] == "other") & ~plausible_name(t["speaker_name"]) & last.isNotNull()
        pick = lambda c: F.when(takes, last[c]).otherwise(t[c]).alias(c)
        return F.struct(pick("speaker_name"), pick("affiliation"), pick("role"), t["text"].alias("text"))

    return F.transform(prepared, heir)


def transcript(text: Column) -> Column:
    """ARRAY<STRUCT<section, speaker_name, affiliation, role, text>>: the turns of prepared_remarks, then of qa."""
    parts = split_questions(text)
    tag = lambda a, s: F.transform(a, lambda t: F.struct(F.lit(s).alias("section"), t["speaker_name"].alias("speaker_name"), t["affiliation"].alias("affiliation"), t["role"].alias("role"), t["text"].alias("text")))
    return F.concat(tag(inherit_executive(turns(parts["prepared"])), "prepared_remarks"), tag(turns(parts["questions"]), "qa"))
