"""What counts as a usable value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Reading:
    """What a true reading of a field can be.

    stand_ins: values written where there was none. low, high: the bounds of
    true readings, both inclusive; None leaves a side open.
    """

    stand_ins: Sequence[float] = (-9999.0,)
    low: float | None = None
    high: float | None = None


def usable(c: Column, kind: T.DataType, rule: Reading = Reading()) -> Column:
    """``c`` where it holds a true reading, else NULL.

    NULL, NaN, infinities, stand-ins and values outside the bounds are none.
    Strings count as missing when blank or spelled nan, none, null or n/a.
    """
    if isinstance(kind, T.StringType):
        return F.when(~F.lower(F.trim(c)).isin("", "nan", "none", "null", "n/a"), c)
    ok = c.isNotNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        ok &= ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    if isinstance(kind, T.NumericType):
        if rule.stand_ins:
            ok &= ~c.isin(*[float(x) for x in rule.stand_ins])
        if rule.low is not None:
            ok &= c >= F.lit(rule.low)
        if rule.high is not None:
            ok &= c <= F.lit(rule.high)
    return F.when(ok, c)
