import random

import numpy as np
import pytest

from tidemark.llm.spans import chunk_keys, keys_of, parts_of_documents, recurring_parts, shared_parts, shared_share, shared_spans, sharing_documents

LEAST = 80


def longest_common(a: str, b: str) -> int:
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
        best, row = max(best, *new), new
    return best


def brute(texts: list[str | None]) -> set[tuple[int, int]]:
    return {(i, j) for j in range(len(texts)) for i in range(j) if texts[i] and texts[j] and longest_common(texts[i], texts[j]) >= LEAST}


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars string")


def corpus(seed: int, alphabet: str) -> list[str]:
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice(alphabet) for _ in range(n))
    bits = [noise(r.choice([60, LEAST - 1, LEAST, LEAST + 1, 120, 200])) for _ in range(8)]
    out = []
    for _ in range(24):
        out.append("".join(r.choice([noise(r.randint(0, 60)), r.choice(bits), noise(r.randint(0, 60))]) for _ in range(r.randint(1, 6))))
    return out


@pytest.mark.parametrize("seed,alphabet", [(1, "abcdefgh \n"), (2, "ab"), (3, "éà一😀x")])
def test_pairs_match_brute_force(spark, seed, alphabet):
    texts = corpus(seed, alphabet)
    spans, members = shared_spans(frame(spark, texts), least=LEAST)
    got = {tuple(r) for r in sharing_documents(spans, members).collect()}
    assert got == brute(texts)
    by = {r["text"]: r["doc_id"] for r in members.collect()}
    for r in spans.collect():
        a, b = texts[by[r["text_a"]]], texts[by[r["text_b"]]]
        i, j, n = r["start_a"], r["start_b"], r["length"]
        assert n >= LEAST and a[i : i + n] == b[j : j + n]
        assert i == 0 or j == 0 or a[i - 1] != b[j - 1]
        assert i + n == len(a) or j + n == len(b) or a[i + n] != b[j + n]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crowds_give_the_same_pairs(spark, seed):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdefgh \n") for _ in range(n))
    stock, exact, short = noise(LEAST + 40), noise(LEAST), noise(LEAST - 1)
    texts = [noise(r.randint(0, 30)) + r.choice([stock, exact, short, exact + short, stock[: LEAST + 3]]) + noise(r.randint(0, 90)) for _ in range(30)]
    got = {}
    for crowd in (0, 3, 10**6):
        spans, members = shared_spans(frame(spark, texts), least=LEAST, crowd=crowd)
        got[crowd] = {tuple(x) for x in sharing_documents(spans, members).collect()}
        parts = {tuple(x) for x in parts_of_documents(shared_parts(spans, members), members).select("doc_id", "char_start", "char_end").collect()}
        assert crowd == 0 or parts == last
        last = parts
    assert got[0] == got[3] == got[10**6] == brute(texts)
    alone, members = recurring_parts(frame(spark, texts), least=LEAST)
    assert {tuple(x) for x in parts_of_documents(alone, members).select("doc_id", "char_start", "char_end").collect()} == last


def test_runs_of_one_character_and_periods(spark):
    texts = ["-" * 300, "x" + "-" * LEAST, "-" * (LEAST - 1) + "y", "ab" * 100, "zab" + "ab" * 60, "q" * 500]
    got = {tuple(r) for r in sharing_documents(*shared_spans(frame(spark, texts), least=LEAST)).collect()}
    assert got == brute(texts) == {(0, 1), (3, 4)}


def test_copies_nulls_and_short_texts(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(150))
    texts = [long, long, long, None, "", "short", long[: LEAST - 1]]
    docs = frame(spark, texts)
    spans, members = shared_spans(docs, least=LEAST)
    assert spans.count() == 0
    assert {tuple(r) for r in sharing_documents(spans, members).collect()} == {(0, 1), (0, 2), (1, 2)}
    parts = shared_parts(spans, members)
    assert {(r["doc_id"], r["char_start"], r["char_end"]) for r in parts_of_documents(parts, members).collect()} == {(i, 0, 150) for i in range(3)}
    share = {r["doc_id"]: (r["n_chars"], r["shared_chars"], r["share"]) for r in shared_share(parts, docs).collect()}
    assert share[0] == (150, 150, 1.0) and share[3] == share[4] == (0, 0, 0.0) and share[6][2] == 0.0


def test_parts_merge_overlaps(spark):
    r = random.Random(5)
    base = "".join(r.choice("abcdefghijkl") for _ in range(400))
    texts = [base, "1" * 30 + base[:150], base[100:260] + "2" * 30, "3" + base[300:400]]
    spans, members = shared_spans(frame(spark, texts), least=LEAST)
    parts = parts_of_documents(shared_parts(spans, members), members)
    assert {(p["char_start"], p["char_end"]) for p in parts.where("doc_id = 0").collect()} == {(0, 260), (300, 400)}
    alone = parts_of_documents(*recurring_parts(frame(spark, texts), least=LEAST))
    assert {tuple(x) for x in alone.collect()} == {tuple(x) for x in parts.collect()}


def test_one_passage_in_every_text(spark):
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh") for _ in range(120))
    texts = ["".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60))) + passage + "".join(r.choice("ijkl") for _ in range(30)) for _ in range(60)]
    parts = parts_of_documents(*recurring_parts(frame(spark, texts), least=LEAST)).collect()
    assert len(parts) == 60 and all(texts[p["doc_id"]][p["char_start"] : p["char_end"]].find(passage) >= 0 for p in parts)
    empty, members = recurring_parts(frame(spark, []), least=LEAST)
    assert empty.count() == 0 and members.count() == 0


def test_empty_table(spark):
    spans, members = shared_spans(frame(spark, []), least=LEAST)
    assert sharing_documents(spans, members).count() == 0


def test_one_row_twice_is_no_pair(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(150))
    docs = spark.createDataFrame([(7, text), (7, text)], "doc_id long, text string")
    spans, members = shared_spans(docs, least=LEAST)
    assert sharing_documents(spans, members).count() == 0
    assert [r["share"] for r in shared_share(shared_parts(spans, members), docs).collect()] == [0.0, 0.0]


def test_documents_without_id(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(150))
    docs = spark.createDataFrame([(None, text), (7, text), (None, "z")], "doc_id long, text string")
    spans, members = shared_spans(docs, least=LEAST)
    assert sharing_documents(spans, members).count() == 0
    assert sorted(r["share"] for r in shared_share(shared_parts(spans, members), docs).collect()) == [0.0, 1.0, 1.0]


def test_cuts_move_with_the_text():
    r = np.random.default_rng(0)
    a = r.integers(97, 123, 2000).astype(np.uint32)
    b = np.concatenate([r.integers(97, 123, 77).astype(np.uint32), a])
    (ca, ka), (cb, kb) = chunk_keys(a, 93, 92, 276), chunk_keys(b, 93, 92, 276)
    assert len(set(ka) & set(kb)) >= len(ka) - 4


def test_segments_of_a_long_text():
    codes = np.random.default_rng(4).integers(97, 100, 30_000).astype(np.uint32)
    a, k = chunk_keys(codes, 93, 92, 276)
    b, j = keys_of(codes, 93, 92, 276, segment=1000)
    assert a.tolist() == b.tolist() and k.tolist() == j.tolist()


def test_least_too_short(spark):
    with pytest.raises(ValueError):
        shared_spans(frame(spark, ["a"]), least=30)
