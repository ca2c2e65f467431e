"""What a document's address says about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hosts of industry conferences whose files lie among the quarterly ones, and how dates, quarters and annual forms are written in addresses.
CONFERENCES = ("barclays", "scotia", "rbc", "nbf", "national-bank", "bmo", "cibc", "goldman", "morgan-stanley", "cowen", "ubs", "jefferies", "fireside", "rbccm", "rbfig")
DAY = r"(\d{4})[-_](\d{2})[-_](\d{2})"
YEAR_QUARTER, QUARTER_YEAR = r"(?i)(\d{4})[-_/]?q([1-4])", r"(?i)q([1-4])[-_](\d{4})"
ANNUAL_FORM = r"(?i)(?:^|[-_/])(?:e[-_])?(\d{4})[-_]?form[-_]?40[-_]?f"


def day_in(url: Column) -> Column:
    """The first yyyy-mm-dd (or with underscores) in an address, NULL where there is none or no such day."""
    d = F.concat_ws("-", *[F.regexp_extract(url, DAY, i) for i in (1, 2, 3)])
    return F.when(url.rlike(DAY), d.try_cast("date"))


def quarter_in(url: Column) -> Column:
    """FYyyyyQn of 2024-q2, 2024q2, 2024/q2 or q2-2024 in an address."""
    first = F.concat(F.lit("FY"), F.regexp_extract(url, YEAR_QUARTER, 1), F.lit("Q"), F.regexp_extract(url, YEAR_QUARTER, 2))
    second = F.concat(F.lit("FY"), F.regexp_extract(url, QUARTER_YEAR, 2), F.lit("Q"), F.regexp_extract(url, QUARTER_YEAR, 1))
    return F.when(url.rlike(YEAR_QUARTER), first).when(url.rlike(QUARTER_YEAR), second)


def annual_year_in(url: Column) -> Column:
    """The year of an annual form in an address."""
    return F.when(url.rlike(ANNUAL_FORM), F.regexp_extract(url, ANNUAL_FORM, 1).cast("int"))


def is_transcript(url: Column, not_of: Sequence[str] = CONFERENCES) -> Column:
    """An English PDF transcript that isn't a conference's; NULL addresses aren't."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return low.contains(".pdf") & low.contains("transcript") & ~low.rlike("/fr/|-fr/|_fr/") & ~low.rlike("|".join(not_of))


def is_shareholder_report(url: Column) -> Column:
    """An English PDF report to shareholders."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return low.contains(".pdf") & low.contains("shareholders") & ~low.rlike("/fr/|-fr/|_fr/")


def first_seen(links: DataFrame, url: str, order: str) -> DataFrame:
    """One row per address, the first by ``order``; of equals the least by the other columns. NULL addresses are left out."""
    rest = [c for c in links.columns if c not in (url, order)]
    x = links.where(F.col(url).isNotNull()).groupBy(url).agg(F.min(F.struct(order, *rest)).alias("__m"))
    return x.select(*[F.col(c) if c == url else F.col(f"__m.{c}").alias(c) for c in links.columns])
