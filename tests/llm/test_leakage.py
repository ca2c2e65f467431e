from tidemark.llm.leakage import leaks, words, words_with_offsets


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")


def items(spark, *texts):
    return spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "item_id long, text string")


ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def found(spark, texts, tests, **kw):
    return {(r["doc_id"], r["item_id"], r["n_words"], r["char_start"], r["char_end"]) for r in leaks(docs(spark, *texts), items(spark, *tests), **kw).collect()}


def test_dress_is_disregarded(spark):
    w = ITEM.split()
    dressed = "“" + "—".join(w[:6]).upper() + "”,\n" + " ".join("­".join(x) for x in w[6:])
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM)
    got = {r[:3] for r in found(spark, [dressed, wide, "x" + ITEM, ITEM.replace("seven", "7")], [ITEM])}
    assert got == {(0, 100, 14), (1, 100, 14), (2, 100, 13)}


def test_partial_and_boundaries(spark):
    w = ITEM.split()
    texts = ["lead " + " ".join(w[1:13]) + " tail", " ".join(w[:11]), " ".join(w[:12]) + "x", " ".join(w[:13]) + "x"]
    assert found(spark, texts, [ITEM]) == {(0, 100, 12, 5, 5 + len(" ".join(w[1:13]))), (3, 100, 12, 0, len(" ".join(w[:12])))}


def test_offsets_are_into_the_original(spark):
    text = "Ｆｕｌｌ éte​  " + ITEM.replace("five", "fi​ve") + "!"
    ((_, _, n, a, z),) = found(spark, [text], [ITEM])
    assert n == 14 and text[a:z].startswith("One") and text[a:z].endswith("fourteen")
    assert [x[0] for x in words_with_offsets(text)] == words(text)


def test_empty_null_short_and_repeated(spark):
    assert found(spark, [None, "", "   "], [ITEM]) == set()
    assert found(spark, [ITEM], ["too short", None, ""]) == set()
    assert found(spark, [], [ITEM]) == set() and found(spark, [ITEM], []) == set()
    assert {r[:2] for r in found(spark, [ITEM, ITEM], [ITEM, ITEM])} == {(0, 100), (0, 101), (1, 100), (1, 101)}


def test_blocks_of_items_give_the_same(spark):
    tests = [ITEM, ITEM.replace("one", "uno"), " ".join(f"w{i}" for i in range(40))]
    texts = [ITEM, " ".join(f"w{i}" for i in range(5, 30)), "x " * 3000 + ITEM]
    assert found(spark, texts, tests) == found(spark, texts, tests, block_chars=10)


def test_twice_in_one_document(spark):
    assert {r[3] for r in found(spark, [ITEM + " and " + ITEM], [ITEM])} == {0, len(ITEM) + 5}
