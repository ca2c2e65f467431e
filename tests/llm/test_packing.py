import base64
import os
import random
import sys
import types

import numpy as np
import pytest

from tidemark.llm.packing import pack, sum_of_squares


def naive(sizes, capacity):
    """The rule as it reads: try every choice, compute the whole sum of squares."""
    n, out = [0] * (capacity + 1), []
    for s in sizes:
        best = None
        for h in range(capacity - s, -1, -1):
            if h and not n[h]:
                continue
            m = n.copy()
            if h:
                m[h] -= 1
            if h + s < capacity:
                m[h + s] += 1
            score = sum(x * x for x in m[1:capacity])
            if best is None or score < best[0]:
                best = (score, h, m)
        out.append(best[1])
        n = best[2]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_rule_against_naive(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 12) for _ in range(200)]
    where, place = sum_of_squares(np.array(sizes), 12)
    assert place.tolist() == naive(sizes, 12)
    fill = np.bincount(where, weights=sizes)
    assert fill.max() <= 12 and fill.min() > 0


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, place int")


def test_everything_is_placed_once(spark):
    r = random.Random(1)
    texts = ["x" * r.choice([0, 1, 3, 4, 40, 200, 400, 403, 404, 1000, 5000]) for _ in range(300)] + [None]
    got = pack(frame(spark, texts), capacity=100, pieces_per_shard=50).collect()
    by_doc, by_seq = {}, {}
    for g in got:
        by_doc.setdefault(g["doc_id"], []).append(g)
        by_seq.setdefault(g["sequence"], []).append(g)
    assert set(by_doc) == set(range(300))
    for i, ps in by_doc.items():
        ps.sort(key=lambda p: p["piece"])
        assert ps[0]["char_start"] == 0 and ps[-1]["char_end"] == len(texts[i])
        assert all(a["char_end"] == b["char_start"] for a, b in zip(ps, ps[1:]))
        assert sum(p["length"] for p in ps) == max(1, len(texts[i]) // 4)
        assert len(ps) == 1 or max(1, len(texts[i]) // 4) > 100 and all(p["length"] == 100 for p in ps[:-1])
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["place"])
        at = 0
        for p in ps:
            assert p["place"] == at
            at += p["length"]
        assert at <= 100


def test_little_is_left(spark):
    r = random.Random(2)
    texts = ["x" * (4 * r.randint(5, 60)) for _ in range(3000)]
    got = pack(frame(spark, texts), capacity=100).collect()
    bins = len({g["sequence"] for g in got})
    assert bins <= 1.01 * sum(len(t) // 4 for t in texts) / 100 + 3


def test_empty_table(spark):
    assert pack(frame(spark, [])).count() == 0


def test_public_vocabulary(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    texts = ["The bank said that growth held up. " * 40, "court", "été " * 100, ""]
    got = pack(frame(spark, texts), capacity=64, vocabulary=(path, pattern)).collect()
    for i, t in enumerate(texts):
        ps = sorted((g for g in got if g["doc_id"] == i), key=lambda p: p["piece"])
        assert ps[0]["char_start"] == 0 and ps[-1]["char_end"] == len(t) and all(p["length"] <= 64 for p in ps)


def test_p7_counts_tokens_of_the_vocabulary(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    from tidemark.llm.queries import p7_packed

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    r = random.Random(3)
    texts = [
        "The bank said that growth held up. " * 300,  # over 2,048 by its characters, within by its tokens
        "7,1;9)4|" * 900,  # within by its characters
        "".join(r.choice("aé中🙂 \n9x") for _ in range(9000)),
        "court", "",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = p7_packed(spark, str(tmp_path)).collect()
    for i, t in enumerate(texts):
        ps = sorted((g for g in got if g["doc_id"] == i), key=lambda p: p["piece"])
        assert ps[0]["char_start"] == 0 and ps[-1]["char_end"] == len(t)
        assert all(a["char_end"] == b["char_start"] for a, b in zip(ps, ps[1:]))
        for p in ps:
            assert p["length"] == max(1, len(enc.encode_ordinary(t[p["char_start"] : p["char_end"]]))) <= 2048
        assert (len(ps) > 1) == (len(enc.encode_ordinary(t)) > 2048)
    assert max(g["place"] + g["length"] for g in got) <= 2048


def small(spark, at, monkeypatch, lost=None):
    """A table of documents, and a package of vocabularies in the same folder."""
    spark.createDataFrame([(1, "The bank said")], "doc_id long, text string").write.parquet(str(at / "documents.parquet"))
    monkeypatch.setitem(sys.modules, "public_tokenizers", types.SimpleNamespace(path=lambda n: str(at / n), PATTERN=r"\s+|\S+"))
    if lost:
        monkeypatch.setitem(sys.modules, lost, None)


@pytest.mark.parametrize("query", ["p7_packed", "p7_placed", "p7_room"])
@pytest.mark.parametrize("lost", ["public_tokenizers", "tiktoken", None])
def test_p7_fails_without_its_vocabulary(spark, tmp_path, monkeypatch, lost, query):
    from tidemark.llm.queries import QUERIES

    if not lost:
        pytest.importorskip("tiktoken")
    small(spark, tmp_path, monkeypatch, lost)
    with pytest.raises(ImportError if lost else FileNotFoundError, match=lost or "byte_bpe_50k"):
        QUERIES[query](spark, str(tmp_path))


def test_p7_fails_with_a_torn_vocabulary(spark, tmp_path, monkeypatch):
    pytest.importorskip("tiktoken")
    from tidemark.llm.queries import p7_packed

    small(spark, tmp_path, monkeypatch)
    # the first 256 ranks encode every text
    (tmp_path / "byte_bpe_50k.tiktoken").write_bytes(b"".join(b"%s %d\n" % (base64.b64encode(bytes([i])), i) for i in range(256)))
    with pytest.raises(Exception, match="256 ranks of 50256"):
        p7_packed(spark, str(tmp_path)).collect()
