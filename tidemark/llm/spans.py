"""Long exact stretches shared between texts: content-defined chunks, deduplicated by digest, matches extended to their ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: A gear hash of 32 bits forgets a character after 32 steps.
GEAR = 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE2 = np.uint64(pow(int(_BASE2), -1, 2**64))


def _gear(code: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear(code[i - j]) << j over j < 32, the rolling hash h[i] = (h[i - 1] << 1) + gear(code[i]), by doubling."""
    x = code.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE3D)
    x ^= x >> np.uint32(13)
    step = 1
    while step < GEAR:
        y = x.copy()
        y[step:] += x[:-step] << np.uint32(step)
        x, step = y, step * 2
    return x


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Where h is the least of some w consecutive values."""
    n = len(h)
    if n < w:
        return np.zeros(n, dtype=bool)
    m, step = h, 1
    while step < w:  # m[i] = min(h[i : i + step])
        move = min(step, w - step)
        m = np.minimum(m[:-move], m[move:])
        step += move
    top = np.zeros(n + w - 1, dtype=h.dtype)
    top[w - 1 : w - 1 + len(m)] = m
    step = 1
    while step < w:  # top[i] = max of the minima of the windows that hold i
        move = min(step, w - step)
        top = np.maximum(top[:-move], top[move:])
        step += move
    return top[:n] == h


def _digests(codes: np.ndarray, base: np.uint64 = _BASE, inverse: np.uint64 = _INVERSE):  # noqa: ANN202
    """A function that digests codes[a:b] for arrays a, b: polynomials modulo 2^64, from sums along the text."""
    n = len(codes)
    powers = np.ones(n + 1, dtype=np.uint64)
    powers[1:] = base
    powers = np.cumprod(powers, dtype=np.uint64)
    down = np.ones(n + 1, dtype=np.uint64)
    down[1:] = inverse
    down = np.cumprod(down, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    sums[1:] = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)

    def digest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (sums[b] - sums[a]) * down[a]
        return x ^ (x >> np.uint64(32))

    return digest


def chunk_keys(codes: np.ndarray, w: int, chunk: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of one text and the digest of what each begins.

    A cut is where the gear hash is least among w neighbours. A chunk runs from
    a cut to the first cut at least ``chunk`` on. The digest is of the chunk
    and of its surroundings from GEAR - 1 before the cut to ``reach`` after it.
    Of cuts that follow each other with one digest the first stays.
    """
    n = len(codes)
    if n < GEAR - 1 + reach:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = _gear(codes)[GEAR - 1 :]
    cuts = np.flatnonzero(_window_minima(h, w)) + GEAR - 1
    digest = _digests(codes)
    a = cuts[cuts + reach <= n]
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nxt = np.searchsorted(cuts, a + chunk)
    e = np.where(nxt < len(cuts), cuts[np.minimum(nxt, len(cuts) - 1)], n)
    key = digest(a, e) * np.uint64(0xD6E8FEB86659FD93) + digest(a - GEAR + 1, a + reach)
    key ^= key >> np.uint64(32)
    first = np.r_[True, key[1:] != key[:-1]]
    return a[first], key[first].view(np.int64)


def _meet(rows: DataFrame) -> DataFrame:
    """text_a < text_b, at_a, at_b of rows (text, key, at) with one key."""
    a = rows.select("key", F.col("text").alias("text_a"), F.col("at").alias("at_a"))
    b = rows.select("key", F.col("text").alias("text_b"), F.col("at").alias("at_b"))
    return a.join(b, on="key").where("text_a < text_b").select("text_a", "text_b", "at_a", "at_b")


def _stretches(cuts: DataFrame, least: int, w: int) -> DataFrame:
    """text, key, key2, at of every stretch of ``least`` characters of (text, ats, body) that has one of the cuts ``ats`` in its beginning."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, key, key2 = ([np.empty(0, np.int64)] for _ in range(4))
            for i, (ats, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                near = np.unique(np.asarray(ats, dtype=np.int64)[:, None] - GEAR + 1 - np.arange(w)[None, :])
                near = near[(near >= 0) & (near + least <= len(codes))]
                rows.append(np.full(len(near), i)), at.append(near), key.append(_digests(codes)(near, near + least).view(np.int64))
                key2.append(_digests(codes, _BASE2, _INVERSE2)(near, near + least).view(np.int64))
            of = batch.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([of, *[pa.array(np.concatenate(k)) for k in (key, key2)], pa.array(np.concatenate(at).astype(np.int32))], names=["text", "key", "key2", "at"])

    return cuts.select("text", "ats", "body").mapInArrow(hashes, "text binary, key long, key2 long, at int")


def _telling(crowded: DataFrame, least: int, w: int) -> DataFrame:
    """(text, key, at) of whole stretches of ``least`` characters around the cuts of (text, ats, body), as few as tell the pairs.

    Of the stretches that lie around a cut as the first one after their
    beginning, each is hashed as a whole: texts that don't share one never
    meet. One that the same texts have as the stretch a character before tells
    nothing new and is left out, unless some text has it as its first.
    """

    x = _stretches(crowded, least, w).drop("key2")
    h = F.xxhash64("text")
    who = x.groupBy("key").agg(F.count("*").alias("n"), F.sum(h.cast("double")).alias("s"), F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo < hi")
    who = who.select("key", F.xxhash64("n", "s", "lo", "hi").alias("who"))
    by = Window.partitionBy("text").orderBy("at")
    y = x.join(who, on="key")
    first = ~((F.lag("at").over(by) == F.col("at") - 1) & (F.lag("who").over(by) == F.col("who")))
    y = y.withColumn("first", F.coalesce(first, F.lit(True)))
    telling = y.where("first").select("key").distinct()
    return y.select("text", "key", "at").join(telling, on="key", how="left_semi")


def keys_of(codes: np.ndarray, w: int, chunk: int, reach: int, segment: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """``chunk_keys`` of a text of any length, in segments: each is read with as much on either side as what is decided within it depends on."""
    n = len(codes)
    if n <= segment:
        return chunk_keys(codes, w, chunk, reach)
    around = GEAR + w + chunk + reach
    at, key = [], []
    for low in range(0, n, segment):
        start = max(0, low - around)
        a, k = chunk_keys(codes[start : low + segment + around], w, chunk, reach)
        mine = (a + start >= low) & (a + start < low + segment)
        at.append(a[mine] + start), key.append(k[mine])
    return np.concatenate(at), np.concatenate(key)


def _shared_cuts(docs: DataFrame, doc_id: str, text: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """The texts (doc_id, body, text), members, and the cuts (text, key, at) whose digest more than one text has; w and reach of the cuts."""
    # A stretch has a cut within its first w positions where the hash is its own, and at least reach characters after it.
    # A chunk ends w - 1 to 2 w - 2 after its cut, and whether there is a cut depends on w - 1 more on either side:
    # with reach = 3 (w - 1) all of that lies within the stretch, so that every text that has it has this chunk.
    w = (least - GEAR + 4) // 4
    if w < 2:
        raise ValueError(f"stretches of {least} are too short for a gear hash of {GEAR} characters")
    reach, chunk = least - GEAR - w + 1, w - 1
    d = docs.where(F.length(text) >= least).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"), F.unhex(F.md5(text)).alias("text"))
    members = d.select("text", "doc_id", F.length("body").cast("long").alias("n_chars"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, key, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [0]
            for t in batch.column(0).to_pylist():
                a, k = keys_of(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), w, chunk, reach)
                at.append(a), key.append(k), ends.append(ends[-1] + len(a))
            held = pa.StructArray.from_arrays([pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(key))], names=["at", "key"])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)], names=["text", "cuts"])

    # kept, so that texts are cut once; twelve bytes a cut
    kept = cut(d.select("body", "text").mapInArrow(keys, "text binary, cuts array<struct<at: int, key: bigint>>"))
    cuts = kept.select("text", F.inline("cuts"))
    # one text's copies give the same rows; one of each stays. More than one text has a digest if min < max of their hashes
    h = F.xxhash64("text")
    shared = cuts.groupBy("key").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo < hi").select("key")
    held = cut(cuts.join(shared, on="key").distinct())
    return d, members, held, w, reach


def recurring_parts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 400) -> tuple[DataFrame, DataFrame]:
    """text, char_start, char_end: the parts of each text that recur in other documents in stretches of at least ``least`` characters, and members as of ``shared_spans``.

    The same parts as ``shared_parts`` of all spans, found without pairs: a
    shared stretch holds a shared cut in its beginning, so that every stretch of
    ``least`` characters around one is hashed as a whole (128 bits); what more
    than one text has recurs, and a text's parts are what its recurring
    stretches cover. A text that more than one document has recurs wholly.

    Scale: a row for each character at which a recurring stretch may begin,
    counts combined before the shuffle, so that a stretch that a third of all
    texts hold costs each of them no more than one that two hold.

    Nulls: as ``shared_spans``.
    """
    d, members, held, w, _ = _shared_cuts(docs, doc_id, text, least)
    bodies = d.join(held.select("text").distinct(), on="text", how="left_semi").dropDuplicates(["text"]).select("text", "body")
    x = _stretches(held.groupBy("text").agg(F.collect_set("at").alias("ats")).join(bodies, on="text"), least, w)
    h = F.xxhash64("text")
    shared = x.groupBy("key", "key2").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo < hi").select("key", "key2")
    at = x.join(shared, on=["key", "key2"], how="left_semi").select("text", F.col("at").cast("long").alias("a"), (F.col("at") + F.lit(least)).cast("long").alias("z"))
    line = at.unionByName(_whole(members)).groupBy("text", "a").agg(F.max("z").alias("z"))
    by = Window.partitionBy("text").orderBy("a")
    reach = F.max("z").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = line.withColumn("new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1))).withColumn("k", F.sum("new").over(by))
    return island.groupBy("text", "k").agg(F.min("a").alias("char_start"), F.max("z").alias("char_end")).drop("k"), members


def _whole(members: DataFrame) -> DataFrame:
    """text, a, z of the texts that more than one document has."""
    several = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int")) > 1
    copies = members.groupBy("text").agg(several.alias("several"), F.max("n_chars").alias("n")).where("several")
    return copies.select("text", F.lit(0).cast("long").alias("a"), F.col("n").alias("z"))


def shared_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 400, crowd: int = 64) -> tuple[DataFrame, DataFrame]:
    """Stretches of at least ``least`` characters (code points) that different texts share, and which documents have which text.

    The first table, spans, has text_a < text_b (digests), start_a, start_b and
    length, for every pair of texts and every alignment found the whole of the
    matching stretch. The second, members, has text, doc_id, n_chars for every
    document of at least ``least`` characters: copies of one text are one text.

    Cuts are placed by a gear rolling hash alone, so that they move with the
    text when something is inserted before it: any two stretches of ``least``
    equal characters have a cut in common whose digest lies wholly within them.
    Texts that share a digest are compared character by character; so nothing
    depends on a digest's being unique.

    Scale: one row per cut (two in w + 1 characters) is shuffled by digest, and
    those that only one text has are dropped there, counts combined before the
    shuffle. Copies meet as one text, never in pairs. A pair of texts is
    compared once for each alignment, not for each digest. A digest that more
    than ``crowd`` texts have forms no pairs: around it whole stretches of
    ``least`` characters are hashed, so that of a crowd only those texts meet
    that share one. These pairs are the result and all come out.

    Nulls: NULL, empty and shorter texts are in neither table. Repeated rows
    are members each.
    """
    d, members, held, w, reach = _shared_cuts(docs, doc_id, text, least)
    many = held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key")
    bodies = d.join(held.select("text").distinct(), on="text", how="left_semi").dropDuplicates(["text"]).select("text", "body")
    few = _meet(held.join(many, on="key", how="left_anti").select("text", "key", "at"))
    crowded = held.join(many, on="key", how="left_semi").groupBy("text").agg(F.collect_set("at").alias("ats"))
    pairs = few.unionByName(_meet(_telling(crowded.join(bodies, on="text"), least, w)))
    pairs = pairs.groupBy("text_a", "text_b", (F.col("at_a") - F.col("at_b")).alias("lag")).agg(F.min("at_a").alias("at_a"), F.max("at_a").alias("last_a"))
    x = pairs.join(bodies.select(F.col("text").alias("text_a"), F.col("body").alias("body_a")), on="text_a")
    x = x.join(bodies.select(F.col("text").alias("text_b"), F.col("body").alias("body_b")), on="text_b")
    return x.select("text_a", "text_b", "lag", "at_a", "last_a", "body_a", "body_b").mapInPandas(_matcher(least, reach), "text_a binary, text_b binary, start_a int, start_b int, length int"), members


def _matcher(least: int, reach: int):  # noqa: ANN202
    def common(a: str, b: str, i: int, j: int) -> int:
        """How far a from i and b from j agree."""
        most, got, step = min(len(a) - i, len(b) - j), 0, 256
        while got < most:
            if a[i + got : i + got + step] == b[j + got : j + got + step]:
                got += step
                step *= 2
            elif step == 1:
                return got
            else:
                step //= 2
        return most

    def common_back(a: str, b: str, i: int, j: int) -> int:
        """How far what ends before i in a and before j in b agrees."""
        most, got, step = min(i, j), 0, 256
        while got < most:
            s = min(step, most - got)
            if a[i - got - s : i - got] == b[j - got - s : j - got]:
                got += s
                step = s * 2
            elif s == 1:
                return got
            else:
                step = s // 2
        return most

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for ta, tb, lag, at, last, a, b in zip(f["text_a"], f["text_b"], f["lag"], f["at_a"], f["last_a"], f["body_a"], f["body_b"]):
                # along this alignment from the first shared cut to the last there may be several stretches
                i = at
                while i <= last:
                    back = common_back(a, b, i, i - lag)
                    far = common(a, b, i, i - lag)
                    if back + far >= least:
                        rows.append((ta, tb, i - back, i - back - lag, back + far))
                    i += max(far, 1)
            yield pd.DataFrame(rows, columns=["text_a", "text_b", "start_a", "start_b", "length"])

    return match


def sharing_documents(spans: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b of every two documents that share a stretch, copies of one text included.

    Scale: pairs of texts are many times fewer than pairs of documents where
    there are copies; they are expanded last, for this list alone.
    """
    texts = spans.select("text_a", "text_b").distinct()
    ma = members.select(F.col("text").alias("text_a"), F.col("doc_id").alias("x"))
    mb = members.select(F.col("text").alias("text_b"), F.col("doc_id").alias("y"))
    across = texts.join(ma, on="text_a").join(mb, on="text_b").select("x", "y")
    copies = ma.join(mb, on=F.col("text_a") == F.col("text_b")).select("x", "y").where("x < y")
    pairs = across.unionByName(copies)
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()


def shared_parts(spans: DataFrame, members: DataFrame) -> DataFrame:
    """text, char_start, char_end, n_stretches: the parts of each text that recur in other documents, merged where they touch or overlap.

    A text that more than one document has recurs wholly. n_stretches counts
    what was merged into one.
    """
    a, b = (F.col(f"start_{k}").cast("long") for k in "ab")
    line = spans.select(F.col("text_a").alias("text"), a.alias("a"), (a + F.col("length")).alias("z"))
    line = line.unionByName(spans.select(F.col("text_b").alias("text"), b.alias("a"), (b + F.col("length")).alias("z")))
    line = line.unionByName(_whole(members))
    # the stretches that begin at one place are one, the longest: at most as many rows as the text has characters
    line = line.groupBy("text", "a").agg(F.max("z").alias("z"), F.count("*").alias("c"))
    w = Window.partitionBy("text").orderBy("a")
    reach = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = line.withColumn("new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1))).withColumn("k", F.sum("new").over(w))
    return island.groupBy("text", "k").agg(F.min("a").alias("char_start"), F.max("z").alias("char_end"), F.sum("c").alias("n_stretches")).drop("k")


def parts_of_documents(parts: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, n_chars, char_start, char_end: every document with the parts of its text."""
    return parts.join(members, on="text").select("doc_id", "n_chars", "char_start", "char_end")


def shared_share(parts: DataFrame, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row of ``docs`` doc_id, n_chars, shared_chars and share (0.0 for an empty or NULL text) of its text found in other documents."""
    got = parts.groupBy(F.col("text").alias("__t")).agg(F.sum(F.col("char_end") - F.col("char_start")).alias("shared_chars"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), F.unhex(F.md5(text)).alias("__t"))
    x = d.join(got, on="__t", how="left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)).cast("long"))
    return x.select("doc_id", "n_chars", "shared_chars", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)).alias("share"))
