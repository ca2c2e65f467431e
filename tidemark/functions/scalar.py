"""Scalar functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fiscal_quarter(day: Column, first_month: int = 11) -> Column:
    """FYyyyyQn of a date, where the fiscal year that ends in yyyy begins with ``first_month`` (of the year before, unless 1)."""
    at = F.pmod(F.month(day) - first_month, F.lit(12))
    year = F.year(day) + (F.when(F.month(day) >= first_month, 1).otherwise(0) if first_month > 1 else F.lit(0))
    return F.when(day.isNotNull(), F.format_string("FY%dQ%d", year, (F.floor(at / 3) + 1).cast("int")))


def quarter_label(label: Column) -> Column:
    """FYyyyyQn for both spellings, with a dash before the Q and without; NULL for blanks, "nan" and anything else."""
    return F.regexp_replace(F.when(label.rlike(r"^FY\d{4}-?Q[1-4]$"), label), "-", "")


def quarter_of(stated: Column, hint: Column, policy: str = "stated") -> Column:
    """The quarter by ``policy``: "stated", the stated one and else the hint; "hint", the other way round."""
    a, b = quarter_label(stated), quarter_label(hint)
    return F.coalesce(a, b) if policy == "stated" else F.coalesce(b, a)


def band(value: Column, width: float) -> Column:
    """1 above width, -1 below -width, else 0; NULL is in neither band."""
    return F.when(value > width, 1).when(value < -width, -1).otherwise(0)


def decay(days: Column, scale: float) -> Column:
    """exp(-days / scale) of days since an event, 0 at least; NULL counts as 999 days."""
    return F.exp(-F.greatest(F.coalesce(days.cast("double"), F.lit(999.0)), F.lit(0.0)) / scale)


def row_mean(*cols: Column) -> Column:
    """Mean over the columns that have a value."""
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)), n)


def row_std(*cols: Column) -> Column:
    """Sample standard deviation over the columns that have a value, NULL for fewer than two."""
    m = row_mean(*cols)
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(n > 1, F.sqrt(sum((F.coalesce((c - m) * (c - m), F.lit(0.0)) for c in cols), F.lit(0.0)) / (n - 1)))


def content_key(*parts: Column) -> Column:
    """SHA-256 of the parts' UTF-8 bytes with a zero byte between; NULL parts count as empty."""
    cells = []
    for p in parts:
        cells += [F.unhex(F.lit("00")), F.encode(F.coalesce(p, F.lit("")), "UTF-8")]
    return F.sha2(F.concat(*cells[1:]), 256)


def rough_tokens(text: Column) -> Column:
    """A fourth of the characters, rounded down, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def clamp(value: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def slug(text: Column, most: int = 80) -> Column:
    """Lower case, runs of anything but letters and digits as one dash, none at the ends, cut to ``most``."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


#: Month names in the order of the calendar.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def written_date(text: Column, within: int | None = None) -> Column:
    """The first "Month D, YYYY" in the text or its first ``within`` characters (the reference's 6,000), letter-spaced spelling included; NULL where there is none or no such day."""
    head = text if within is None else F.substring(text, 1, within)
    plain = r"(?i)\b(" + "|".join(MONTHS) + r")\s+(\d{1,2}),?\s+(\d{4})\b"
    spaced = r"(?i)(" + "|".join(r"\s*".join(m) for m in MONTHS) + r")\s*((?:\d\s*){1,2}),\s*((?:\d\s*){4})"
    tight = lambda c: F.regexp_replace(c, r"\s", "")

    def of(pattern: str) -> Column:
        m, d, y = (tight(F.regexp_extract(head, pattern, i)) for i in (1, 2, 3))
        return F.when(m != "", F.concat_ws(" ", F.initcap(F.lower(m)), d, y))

    return F.to_date(F.try_to_timestamp(F.coalesce(of(plain), of(spaced)), F.lit("MMMM d yyyy")))
