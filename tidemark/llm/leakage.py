"""Held-out passages in a training corpus: one Aho-Corasick automaton over all of them."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")

#: Invisible characters that aren't of category Cf: the grapheme joiner and the variation selectors.
UNSEEN = re.compile("[\u034f\ufe00-\ufe0f\U000e0100-\U000e01ef]")


def visible(text: str) -> str:
    """``text`` without invisible format characters."""
    if text.isascii():
        return text
    text = UNSEEN.sub("", text)
    cf = {c for c in set(text) if unicodedata.category(c) == "Cf"}
    return text.translate(dict.fromkeys(map(ord, cf))) if cf else text


def fold(text: str) -> str:
    """``text`` with compatibility forms and case aside."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def words(text: str) -> list[str]:
    """Runs of letters and digits; case, punctuation, spacing, invisible format characters and compatibility forms aside."""
    return WORD.findall(fold(visible(text)))


def _joins(c: str) -> bool:
    """Whether c may melt into the character before it when composed: marks, Hangul vowels and finals."""
    return unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or c in "\uff9e\uff9f"


def words_with_offsets(text: str) -> list[tuple[str, int, int]]:
    """The words and where they begin and end in ``text`` itself."""
    if text.isascii():
        return [(m[0], m.start(), m.end()) for m in WORD.finditer(text.lower())]
    kept = [i for i, c in enumerate(text) if unicodedata.category(c) != "Cf" and not UNSEEN.match(c)]
    seen = "".join(text[i] for i in kept)
    out, at = [], []
    starts = [i for i, c in enumerate(seen) if i == 0 or not _joins(c)]
    for a, b in zip(starts, [*starts[1:], len(seen)]):
        f = fold(seen[a:b])
        out.append(f)
        at += [(a, b)] * len(f)
    return [(m[0], kept[at[m.start()][0]], kept[at[m.end() - 1][1] - 1] + 1) for m in WORD.finditer("".join(out))]


def leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    least_words: int = 12,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """doc_id, item_id, n_words, char_start, char_end: every stretch of at least ``least_words`` consecutive words that a document has in common with an item.

    Every run of least_words words of every item is a pattern of one automaton;
    a document is scanned once, and hits that continue each other are one
    stretch. Offsets are into the original text, of the first word's beginning
    and the last one's end (NULL in the rare text whose parts fold otherwise
    than the whole).

    Scale: documents stay where they are read; no shuffle. Items are broadcast
    in blocks of up to ``block_chars``, one scan of the documents for each: a
    set of test items is one block. A worker builds a block's automaton once.

    Nulls: NULL and empty texts, and items of fewer words, have no match.
    Repeated items match each under its own id, repeated documents too.
    """
    size = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    it = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    out = None
    for b in range(blocks):
        part = it if blocks == 1 else it.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        x = _scan(docs, [(r["i"], r["t"]) for r in part.collect()], doc_id, text, items.schema[item_id].dataType.simpleString(), least_words)
        out = x if out is None else out.unionByName(x)
    return out


_BUILT: dict[str, object] = {}


def automaton(of: str, items: list[tuple[object, str]], least: int):  # noqa: ANN201
    """The automaton of all runs of ``least`` words of the items, None without any; a worker process keeps the last one it built, by the items' digest ``of``."""
    import ahocorasick

    if of not in _BUILT:
        patterns: dict[str, list[tuple[object, int]]] = {}
        for i, t in items:
            w = words(t)
            for k in range(len(w) - least + 1):
                patterns.setdefault(" " + " ".join(w[k : k + least]) + " ", []).append((i, k))
        auto = ahocorasick.Automaton()
        for p, held in patterns.items():
            auto.add_word(p, held)
        if patterns:
            auto.make_automaton()
        _BUILT.clear()
        _BUILT[of] = auto if patterns else None
    return _BUILT[of]


def _scan(docs: DataFrame, items: list[tuple[object, str]], doc_id: str, text: str, item_kind: str, least: int) -> DataFrame:
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id {item_kind}, n_words int, char_start int, char_end int"

    sent = d.sparkSession.sparkContext.broadcast(items)  # of block_chars at most
    of = hashlib.md5(repr((least, items)).encode("utf-8", "surrogatepass")).hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(of, sent.value, least)
        for batch in batches:
            rows: dict[str, list] = {"n": [], "item_id": [], "n_words": [], "char_start": [], "char_end": []}
            for n, t in enumerate(batch.column(1).to_pylist() if auto is not None else ()):
                if not t:
                    continue
                w = words(t)
                if len(w) < least:
                    continue
                line = " " + " ".join(w) + " "
                hits = list(auto.iter(line))
                if not hits:
                    continue
                # stretches by item and diagonal (word of the document less word of the item)
                ends, e = {}, 0
                for k, x in enumerate(w):
                    e += len(x) + 1
                    ends[e] = k
                runs: dict[tuple[object, int], list[int]] = {}
                for end, held in hits:
                    last = ends[end]
                    for i, k in held:
                        runs.setdefault((i, last - least + 1 - k), []).append(last)
                spots = words_with_offsets(t)
                if [s[0] for s in spots] != w:
                    spots = []
                for (i, _), lasts in runs.items():
                    lasts.sort()
                    first = prev = lasts[0]
                    for x in [*lasts[1:], None]:
                        if x is not None and x == prev + 1:
                            prev = x
                            continue
                        a = first - least + 1
                        rows["n"].append(n)
                        rows["item_id"].append(i)
                        rows["n_words"].append(prev - a + 1)
                        rows["char_start"].append(spots[a][1] if spots else None)
                        rows["char_end"].append(spots[prev][2] if spots else None)
                        first = prev = x
            ids = batch.column(0).take(pa.array(rows["n"], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(rows["item_id"], kind), pa.array(rows["n_words"], pa.int32()), pa.array(rows["char_start"], pa.int32()), pa.array(rows["char_end"], pa.int32())],
                names=["doc_id", "item_id", "n_words", "char_start", "char_end"],
            )

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(item_kind))
    return d.mapInArrow(scan, schema)
