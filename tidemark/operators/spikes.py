"""Implausible readings, judged by each source's own normal behaviour."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

P = "__sp_"
RANGE, SPIKE, STUCK = 1, 2, 4


@dataclass(frozen=True)
class Measure:
    """A measurement to test.

    kind "level": positive by nature, judged by its log; "return": a relative
    change, judged against ``witness``, a sound level of the same rows.
    """

    column: str
    kind: str = "level"
    witness: str | None = None


def robust_pca(d: np.ndarray, weight: float | None = None, steps: int = 30, tol: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Principal component pursuit of each matrix of the stack d (b, m, n): d = low + sparse.

    Minimises the nuclear norm of low plus ``weight`` (1/sqrt(max(m, n)) if not
    given) times the sum of absolutes of sparse, by augmented Lagrange multipliers. n should be small:
    singular values come from the n x n Gram matrices of the whole stack at once.
    """
    b, m, n = d.shape
    lam = weight or 1 / np.sqrt(max(m, n))
    norm = np.sqrt(np.maximum(np.linalg.eigvalsh(np.swapaxes(d, 1, 2) @ d)[:, -1], 1e-30))
    y = d / np.maximum(norm, np.abs(d).max((1, 2)) / lam)[:, None, None]
    mu = 1.25 / norm
    sparse, low, full = np.zeros_like(d), np.zeros_like(d), np.maximum(np.sqrt((d**2).sum((1, 2))), 1e-30)
    for _ in range(steps):
        at = mu[:, None, None]
        a = d - sparse + y / at
        val, vec = np.linalg.eigh(np.swapaxes(a, 1, 2) @ a)
        sing = np.sqrt(np.maximum(val, 1e-30))
        keep = np.maximum(1 - 1 / (mu[:, None] * sing), 0)
        low = a @ ((vec * keep[:, None, :]) @ np.swapaxes(vec, 1, 2))
        x = d - low + y / at
        sparse = np.sign(x) * np.maximum(np.abs(x) - lam / at, 0)
        rest = d - low - sparse
        y += at * rest
        mu = mu * 1.6
        if (np.sqrt((rest**2).sum((1, 2))) / full).max() < tol:
            break
    return low, sparse


def _stack(rows: pd.Series, n: int, fill: float = np.nan) -> np.ndarray:
    out = np.full((len(rows), n), fill)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _scale(x: np.ndarray) -> np.ndarray:
    """1.4826 times the median of absolutes, by row."""
    bad = np.isnan(x).all(1)
    x = np.where(bad[:, None], 0.0, x)
    return 1.4826 * np.nanmedian(np.abs(x), axis=1)


def _held(e: np.ndarray) -> np.ndarray:
    """Rows of e, NaN only at their ends, with the last value held on; 0 where there is none."""
    size = (~np.isnan(e)).sum(1)
    at = np.minimum(np.arange(e.shape[1])[None, :], np.maximum(size - 1, 0)[:, None])
    return np.nan_to_num(np.take_along_axis(e, at, 1))


def _off_level(z: np.ndarray, half: int) -> np.ndarray:
    """The sparse part of each reading of the rows of z (NaN only at their ends): how far it is from its row's low-rank normal behaviour.

    The profile of a reading is itself with the ``half`` readings before and
    after; a row's profiles are one matrix, whose low-rank part follows levels
    and slopes. Where a new level begins, the lesser part of a profile is the
    sparse one, never its middle; a reading that leaves its level briefly is
    sparse in the middle of its own profile.

    The weight: a lone reading that is x off stands on a diagonal of 2 half + 1
    profiles, and weighs that many times x in the low-rank part. In the sparse
    part it weighs 1.5 times x with a weight of 1.5 to that number; usual
    movement, of which each profile has its share, weighs less in the low-rank one.
    """
    x = _held(z)
    x = np.pad(x - np.median(x, axis=1)[:, None], ((0, 0), (half, half)), mode="edge")
    profiles = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, 2 * half + 1, axis=1))
    return robust_pca(profiles, 1.5 / (2 * half + 1))[1][:, :, half]


def _off_witness(x: np.ndarray, shown: np.ndarray) -> np.ndarray:
    """How far each change x is off, by the sparse part of a matrix of a row's days with what was read and what the witness shows: of rank one where both are sound.

    Great changes that both have may stand in the sparse part on both sides; what
    counts is what only the reading has. What no witness shows is taken as shown.
    """
    d = np.stack([np.nan_to_num(x), np.nan_to_num(np.where(np.isnan(shown), x, shown))], axis=2)
    sparse = robust_pca(d)[1]
    own = np.abs(sparse[:, :, 0])
    return np.minimum(own, np.abs(sparse[:, :, 0] - sparse[:, :, 1]))


def _returns(z: np.ndarray, off: np.ndarray, threshold: float) -> np.ndarray:
    """Of readings whose sparse part ``off`` is beyond threshold, one or two in a row that leave a level and are followed by it.

    The readings before and after are nearer to each other than 0.6 of the way
    to those between, and this way is at least half of what these are off by
    (else the readings before and after are off themselves).
    """
    b, n = z.shape
    out = np.zeros((b, n), dtype=bool)
    off = np.abs(off)
    for r in (1, 2):
        if n < r + 2:
            continue
        a, c = z[:, : n - r - 1], z[:, r + 1 :]
        far, least, most = np.full(a.shape, np.inf), np.full(a.shape, np.inf), np.zeros(a.shape)
        for j in range(r):
            x, s = z[:, 1 + j : n - r + j], off[:, 1 + j : n - r + j]
            far = np.minimum(far, np.minimum(np.abs(x - a), np.abs(x - c)))
            least, most = np.minimum(least, s), np.maximum(most, s)
        with np.errstate(invalid="ignore"):
            hit = (least > threshold) & (np.abs(a - c) < 0.6 * far) & (far > 0.5 * most)
        for j in range(r):
            out[:, 1 + j : n - r + j] |= hit
    return out


def _flags(kind: str, v: pd.Series, market: pd.Series, group: pd.Series, witness: pd.Series | None, threshold: float, run: int, half: int) -> list[np.ndarray]:
    n = max(map(len, v))
    raw, mk = _stack(v, n), _stack(market, n, 0.0)
    size = np.array([len(x) for x in v])
    flags = np.zeros(raw.shape, dtype=np.int32)
    with np.errstate(invalid="ignore", divide="ignore"):
        if kind == "level":
            flags[raw <= 0] |= RANGE
            flags[np.isinf(raw)] |= RANGE
            x = np.where((raw > 0) & np.isfinite(raw), np.log(np.where(raw > 0, raw, 1.0)), np.nan)
        else:
            flags[(raw <= -1) | np.isinf(raw)] |= RANGE
            x = np.where((raw > -1) & np.isfinite(raw), raw, np.nan)
        order = np.argsort(np.isnan(x), axis=1, kind="stable")  # what can be judged moves together
        x = np.take_along_axis(x, order, 1)
        e = x - np.take_along_axis(mk, order, 1)
        if kind == "level":
            scale = np.maximum(_scale(np.diff(e, axis=1)), _scale(np.diff(x, axis=1))) if n > 1 else np.zeros(len(x))
            scale = np.maximum(scale, 1e-5)
            z = e / scale[:, None]
            hit = _returns(z, _off_level(z, half), threshold)
        else:
            scale = np.maximum(_scale(x), 1e-5)
            w = np.take_along_axis(_stack(witness, n), order, 1)
            g = np.take_along_axis(_stack(group, n, -1), order, 1)
            # the witness's last value of an earlier date
            first = np.maximum.accumulate(np.where(np.diff(g, axis=1, prepend=-9) != 0, np.arange(n)[None, :], 0), axis=1)
            before = np.where(first > 0, np.take_along_axis(w, np.maximum(first - 1, 0), 1), np.nan)
            off = _off_witness(x / scale[:, None], (w / before - 1) / scale[:, None]) > threshold
            hit = off & (np.abs(e) > threshold * scale[:, None])
    back = np.zeros_like(hit)
    np.put_along_axis(back, order, hit, 1)
    flags[back] |= SPIKE
    # constant runs, over the readings as they came
    same = np.zeros(raw.shape, dtype=bool)
    same[:, 1:] = raw[:, 1:] == raw[:, :-1]
    starts = np.maximum.accumulate(np.where(same, 0, np.arange(n)[None, :]), axis=1)
    ends = np.where(np.pad(same[:, 1:], ((0, 0), (0, 1))), n, np.arange(n)[None, :])
    ends = np.flip(np.minimum.accumulate(np.flip(ends, 1), axis=1), 1)
    flags[same & (ends - starts + 1 > run)] |= STUCK
    return [f[:k] for f, k in zip(flags, size)]


def implausible(
    df: DataFrame,
    measures: Sequence[Measure],
    *,
    source: str,
    date: str,
    row_id: str,
    threshold: float = 4.0,
    run: int = 5,
    block: int = 256,
    half: int = 4,
) -> DataFrame:
    """One row for each faulty reading: row_id, field, out_of_range, spike, stuck.

    Robust principal components split the matrix of a source's daily profiles
    into a low-rank part, the normal behaviour, and a sparse one; what lies in
    the sparse part by more than ``threshold`` usual movements of its source
    (1.4826 medians of absolute change) is off. The profile of a day's level is
    its log with those of the ``half`` readings before and after; of a return,
    itself and what ``witness``, a sound level, shows since an earlier date
    (without an earlier date it can't be judged). An exact check follows: a
    level is a spike if one or two readings are off and the levels before and
    after are nearer to each other than 0.6 of the way to them, which is half of
    what they are off by or more; a return if it
    is beyond threshold of what all sources share.

    What all sources share, the median move of a day, is taken off first; two
    moves of 0 are counted with those of a day, so that the move of a source by
    itself isn't taken for everyone's. Range (levels at or below zero, returns
    at or below -1, infinities) and runs of more than ``run`` equal readings
    (every one but the first) are tested apart.

    Scale: a source's readings are numbered (counts per source and day, summed
    along the days, plus the number within the day) and cut into blocks of
    ``block`` to twice as many, with some rows of the neighbours on both sides,
    so that no task ever holds all of a source. Only the daily medians, a row a
    calendar day, are broadcast.

    Nulls: a reading that is NULL or NaN is no fault, ends a run, and is passed
    over when neighbours are compared. Rows without source or date are not
    judged, but for range. Repeated rows are judged each. No rows, no faults.
    """
    halo = max(run + 2, 2 * half)
    names = [f"v{i}" for i in range(len(measures))]
    base = df.select(
        F.col(source).alias("k"), F.col(date).cast("date").alias("d"), F.col(row_id).alias("id"),
        *[F.col(m.column).cast("double").alias(n) for m, n in zip(measures, names)],
        *[F.col(m.witness).cast("double").alias(f"w{n}") for m, n in zip(measures, names) if m.witness],
    )
    inf = float("inf")
    ok = {n: F.when((F.abs(n) != inf) & ~F.isnan(n) & (F.col(n) > (0 if m.kind == "level" else -1)), F.col(n)) for m, n in zip(measures, names)}
    placed = base.where(F.col("k").isNotNull() & F.col("d").isNotNull())
    daily = placed.groupBy("k", "d").agg(F.count("*").alias("n"), *[F.max_by(ok[n], F.when(ok[n].isNotNull(), F.col("id"))).alias(n) for n in names])
    w = Window.partitionBy("k").orderBy("d")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    daily = daily.select(
        "k", "d", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"),
        *[(F.log(n) - F.log(F.lag(n).over(w)) if m.kind == "level" else F.col(n)).alias(n) for m, n in zip(measures, names)],
    )
    still = daily.select("d").distinct().select("d", F.explode(F.array(F.lit(0.0), F.lit(0.0))).alias("zero")).select("d", *[F.col("zero").alias(n) for n in names])
    shared = daily.select("d", *names).unionByName(still).groupBy("d").agg(*[F.percentile_approx(n, 0.5).alias(n) for n in names])
    days = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # a row a calendar day
    shared = shared.select("d", *[(F.sum(F.coalesce(n, F.lit(0.0))).over(days) if m.kind == "level" else F.coalesce(n, F.lit(0.0))).alias(f"m{n}") for m, n in zip(measures, names)])
    at = placed.join(daily.select("k", "d", "before", "total"), on=["k", "d"]).join(F.broadcast(shared), on="d")
    at = at.withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("k", "d").orderBy("id")) - 1)
    of = lambda p: F.greatest(F.lit(0), F.least(F.floor(p / block), F.greatest(F.floor(F.col("total") / block) - 1, F.lit(0)))).cast("int")
    at = at.withColumn("home", of(F.col("pos"))).withColumn("b", F.explode(F.array_distinct(F.array(of(F.col("pos") - halo), F.col("home"), of(F.col("pos") + halo)))))
    cols = ["pos", "id", "d", "home", *names, *[f"m{n}" for n in names], *[f"w{n}" for m, n in zip(measures, names) if m.witness]]
    cells = at.groupBy("k", "b").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("x"))

    def judge(n: str, m: Measure):  # noqa: ANN202
        def f(v: pd.Series, market: pd.Series, group: pd.Series, witness: pd.Series) -> pd.Series:
            out: list[np.ndarray] = []
            for i in range(0, len(v), 128):  # so many blocks at a time
                part = slice(i, i + 128)
                out += _flags(m.kind, v.iloc[part], market.iloc[part], group.iloc[part], witness.iloc[part], threshold, run, half)
            return pd.Series(out)

        arr = lambda c: F.transform("x", lambda r: F.coalesce(r[c], F.lit(float("nan"))))
        group = F.transform("x", lambda r: F.unix_date(r["d"]).cast("double"))
        return F.pandas_udf(f, "array<int>")(arr(n), arr(f"m{n}"), group, arr(f"w{n}") if m.witness else arr(n))

    flagged = cells.select("b", "x", *[judge(n, m).alias(f"f{i}") for i, (n, m) in enumerate(zip(names, measures))])
    zipped = flagged.select("b", F.explode(F.arrays_zip(F.col("x.id").alias("id"), F.col("x.home").alias("home"), *[f"f{i}" for i in range(len(names))])).alias("r"))
    mine = zipped.where(F.col("r.home") == F.col("b"))
    fault = F.array(*[F.struct(F.lit(m.column).alias("field"), F.col(f"r.f{i}").alias("bits")) for i, m in enumerate(measures)])
    got = mine.select(F.col("r.id").alias("id"), F.explode(F.filter(fault, lambda c: c["bits"] > 0)).alias("c"))
    got = got.select("id", F.col("c.field").alias("field"), F.col("c.bits").alias("bits"))
    # rows that have no place in a series still have a range
    loose = base.where(F.col("k").isNull() | F.col("d").isNull())
    beyond = F.array(*[F.struct(F.lit(m.column).alias("field"), F.coalesce((F.col(n) <= (0 if m.kind == "level" else -1)) | (F.abs(n) == inf), F.lit(False)).alias("bad")) for m, n in zip(measures, names)])
    loose = loose.select("id", F.explode(F.filter(beyond, lambda c: c["bad"])).alias("c")).select("id", F.col("c.field").alias("field"), F.lit(RANGE).alias("bits"))
    bit = lambda k: F.col("bits").bitwiseAND(k) > 0
    return got.unionByName(loose).select(F.col("id").alias(row_id), "field", bit(RANGE).alias("out_of_range"), bit(SPIKE).alias("spike"), bit(STUCK).alias("stuck"))
