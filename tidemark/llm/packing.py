"""Filling sequences of fixed capacity with texts: sum-of-squares packing."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = "__pk_"

#: A token is this many characters where no vocabulary is given.
CHARS_PER_TOKEN = 4


def chars_to_tokens(n_chars: Column) -> Column:
    """Tokens of a text of so many code points: a fourth of them, rounded down, at least 1."""
    return F.greatest(F.lit(1), F.floor(n_chars / CHARS_PER_TOKEN)).cast("int")


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item, in the order given, its bin and its place (what the bin held before).

    n[h] counts the open bins that hold h. An item goes where the sum of the
    squares of n comes out smallest, a new bin being one of the choices; on a
    tie into the fullest. Sizes lie in 1..capacity.
    """
    n = np.zeros(capacity + 1)
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, place = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    bins = 0
    for i, s in enumerate(sizes.tolist()):
        room = capacity - s
        level = 0
        if room > 0:
            # half the change of the sum of squares, for a bin that holds 1..room
            change = n[1 + s : room + 1 + s] - n[1 : room + 1] + 1.0
            change[room - 1] = 0.5 - n[room]  # it would be full, and no longer open
            change[n[1 : room + 1] == 0] = np.inf
            best = room - 1 - int(change[::-1].argmin())
            if change[best] <= (n[s] + 0.5 if s < capacity else np.inf):
                level = best + 1
        if level:
            b = held[level].pop()
            n[level] -= 1
        else:
            b = bins
            bins += 1
        where[i], place[i] = b, level
        if level + s < capacity:
            held[level + s].append(b)
            n[level + s] += 1
    return where, place


def cut_texts(docs: DataFrame, doc_id: str, text: str, capacity: int) -> DataFrame:
    """doc_id, piece, char_start, char_end, length: one row per text, or as many as its tokens need where these exceed capacity."""
    width = capacity * CHARS_PER_TOKEN
    n = F.length(text)
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), n.alias("n"), chars_to_tokens(n).alias("t"))
    parts = F.ceil(F.col("t") / capacity).cast("int")
    d = d.select("doc_id", "n", parts.alias("k"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece"))
    start = (F.col("piece") * width).cast("long")
    end = F.when(F.col("piece") == F.col("k") - 1, F.col("n").cast("long")).otherwise(start + width)
    return d.select("doc_id", "piece", start.alias("char_start"), end.alias("char_end"), chars_to_tokens(end - start).alias("length"))


def cut_by_vocabulary(docs: DataFrame, doc_id: str, text: str, capacity: int, path: str, pattern: str, n_ranks: int | None = None) -> DataFrame:
    """As ``cut_texts``, in tokens of a public byte-pair vocabulary: a file of ranks at ``path`` that executors can read, and its splitting pattern.

    length is what a piece has when it is encoded by itself. That may be more
    than the same stretch has within its text, so a piece ends at the last of
    the text's token ends with which it holds ``capacity`` at most.

    With ``n_ranks``, a file of more or fewer ranks raises: a torn one would
    encode all the same, into more tokens.
    """
    if capacity < 4:
        raise ValueError("a character may take 4 tokens")
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, char_start long, char_end long, length int"

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if n_ranks is not None and len(ranks) != n_ranks:
            raise ValueError(f"{path} has {len(ranks)} ranks of {n_ranks}")
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for frame in frames:
            rows = []
            for i, t in zip(frame["doc_id"], frame["text"]):
                tokens = enc.encode_ordinary(t)
                if len(tokens) <= capacity:
                    rows.append((i, 0, 0, len(t), max(1, len(tokens))))
                    continue
                at = [*enc.decode_with_offsets(tokens)[1], len(t)]
                k, a, start = 0, 0, 0
                while start < len(t):
                    b = min(a + capacity, len(tokens))
                    while at[b] <= start:  # within the first character
                        b += 1
                    size = len(enc.encode_ordinary(t[start : at[b]]))
                    while size > capacity:
                        b -= 1
                        size = len(enc.encode_ordinary(t[start : at[b]]))
                    rows.append((i, k, start, at[b], size))
                    k, a, start = k + 1, b, at[b]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "char_start", "char_end", "length"])

    return d.mapInPandas(cut, schema)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken", n_ranks: int = 50_256) -> tuple[str, str, int]:
    """Path, splitting pattern and number of ranks of a vocabulary of the package public_tokenizers.

    Raises where the package, tiktoken or the file is missing: a packing in
    characters looks like one in tokens. Who wants characters calls ``pack``
    without a vocabulary.
    """
    import public_tokenizers
    import tiktoken  # noqa: F401

    path = public_tokenizers.path(name)
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path}")
    return path, public_tokenizers.PATTERN, n_ranks


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    pieces_per_shard: int = 100_000,
    vocabulary: tuple[str, str] | tuple[str, str, int] | None = None,
) -> DataFrame:
    """Every text placed in a sequence: doc_id, piece, char_start, char_end, length, sequence, place.

    Lengths are in tokens of CHARS_PER_TOKEN characters or, with ``vocabulary``
    (path of its ranks, splitting pattern, the number of ranks if known), in its
    tokens. A text is cut only if it alone exceeds ``capacity``, into whole
    sequences and a rest. Pieces of a sequence lie end to end: place is the
    number of tokens before the piece.

    Scale: pieces are dealt by hash into shards of about ``pieces_per_shard``,
    each packed by itself in one pass; only lengths travel, no text. A shard
    ends with a few open bins, so that what is lost by sharding is a few
    sequences a shard, of tens of thousands.

    Nulls: a NULL text has no piece; an empty one has one of length 1, as the
    count of tokens has it. Rows with one doc_id are packed each. No rows, no
    sequences. Sequences are numbered within shards: shard * 2^32 + bin.
    """
    pieces = cut_by_vocabulary(docs, doc_id, text, capacity, *vocabulary) if vocabulary else cut_texts(docs, doc_id, text, capacity)
    # counted in characters, so that no text is encoded twice
    shards = max(1, -(-cut_texts(docs, doc_id, text, capacity).count() // pieces_per_shard))
    placed = pieces.withColumn(f"{P}s", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, char_start long, char_end long, length int, sequence long, place int"

    def one(p: pd.DataFrame) -> pd.DataFrame:
        # an order that doesn't depend on the files' and is nothing like sorted by size
        mix = pd.util.hash_array(p["doc_id"].to_numpy()) ^ (p["piece"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        p = p.iloc[np.argsort(mix, kind="stable")]
        where, place = sum_of_squares(p["length"].to_numpy(), capacity)
        p = p.assign(sequence=p[f"{P}s"].astype("int64") * 2**32 + where, place=place.astype("int32"))
        return p.drop(columns=f"{P}s")[["doc_id", "piece", "char_start", "char_end", "length", "sequence", "place"]]

    return placed.groupBy(f"{P}s").applyInPandas(one, schema)
