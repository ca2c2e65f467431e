import pytest
from pyspark.sql import functions as F

from tidemark.text import annotate as an
from tidemark.text.chunks import chunk, pieces, rough_count, sentences, with_chunk_ids
from tidemark.text.clean import clean_text, is_administrative, is_table_heavy, sections, sections_or_body
from tidemark.text.html import article_links, html_to_text, parse_article
from tidemark.text.turns import inherit_executive, plausible_name, role_of, split_questions, transcript, turns


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def t(s):
    return F.lit(s).cast("string")


def test_clean_text(spark):
    text = "Page 3 of 10\n\n\n Net  income\n rose \n\nThis holds forward-looking statements.\n\n" + "12\n\n- 4 -\n\n" + "forward-looking statements " + "x" * 400 + "\n\n \n\nend\tof it"
    got = one(spark, clean_text(t(text))).split("\n\n")
    assert got[0] == "Net income rose" and got[1].startswith("forward-looking statements xxx") and got[2:] == ["end of it"]
    assert one(spark, clean_text(t(None))) == "" and one(spark, clean_text(t(""))) == ""
    once = one(spark, clean_text(t(text)))
    assert one(spark, clean_text(t(once))) == once


def test_sections(spark):
    text = "intro\n\nRisk Factors\nfirst\nsecond\n  CREDIT RISK  \n\nMarket risk\nthird market risk line"
    assert [tuple(r) for r in one(spark, sections(t(text)))] == [("preamble", "intro"), ("risk factors", "first\nsecond"), ("market risk", "third market risk line")]
    assert [tuple(r) for r in one(spark, sections_or_body(t("only this")))] == [("body", "only this")]
    assert one(spark, sections(t(None))) == [] and one(spark, sections(t(""))) == []


def test_table_and_administrative(spark):
    assert one(spark, is_table_heavy(t("12 (3) $4.5 rows"))) is True and one(spark, is_table_heavy(t("we saw 12 percent growth"))) is False
    assert one(spark, is_table_heavy(t(""))) is True and one(spark, is_table_heavy(t(None))) is True
    assert one(spark, is_administrative(t("Welcome to the call"), t("ceo"))) and one(spark, is_administrative(t("anything"), t("ir")))
    assert not one(spark, is_administrative(t("welcome " * 90), t("ceo"))) and not one(spark, is_administrative(t(None), t(None)))


CALL = """Good day.
Operator
Good afternoon and welcome.
Ann Lee – President and CEO
Results were strong.

Costs fell.
Wholesale Banking – Review
continued here.
Bob Ray – Vice President, Investor Relations
ignored because of the comma
Bob Ray – Vice President Investor Relations
Thanks.
QUESTION AND ANSWER
Cy Fox – Analyst
Why?
Mid Sentence Name
more
Ann Lee – President and CEO
"""


def test_transcript(spark):
    got = [(r["section"], r["speaker_name"], r["role"], r["text"]) for r in one(spark, transcript(t(CALL)))]
    assert got == [
        ("prepared_remarks", "Operator", "operator", "Good afternoon and welcome."),
        ("prepared_remarks", "Ann Lee", "ceo", "Results were strong.\n Costs fell."),
        ("prepared_remarks", "Ann Lee", "ceo", "continued here. Bob Ray – Vice President, Investor Relations ignored because of the comma"),
        ("prepared_remarks", "Bob Ray", "other_exec", "Thanks."),
        ("qa", "Cy Fox", "analyst", "Why? Mid Sentence Name more"),
    ]
    assert one(spark, transcript(t(None))) == [] and one(spark, turns(t(""))) == []


def test_questions(spark):
    f = lambda s: tuple(one(spark, split_questions(t(s))))
    assert f("a\n Q & A \nb") == ("a\n", "\nb") or f("a\n Q & A \nb")[1].strip() == "b"
    assert f("a\nWe will now take questions from the telephone lines. b") == ("a\n", "We will now take questions from the telephone lines. b")
    assert f("We'll now take questions from the telephone") == ("", "We'll now take questions from the telephone")
    assert f("nothing") == ("nothing", "") and f(None) == ("", "")


def test_roles_and_names(spark):
    r = lambda n, a: one(spark, role_of(t(n), t(a)))
    assert [r("Operator", None), r("A B", "Equity Research"), r("A B", "CFO and Chief Risk"), r("A B", "Group Head"), r("A B", "Head of Investor Relations"), r("A B", "")] == ["operator", "analyst", "cfo", "other_exec", "ir", "other"]
    p = lambda n: one(spark, plausible_name(t(n)))
    assert [p("Ann Lee"), p("Operator"), p("Ann"), p("In Banking"), p("Gold Rewards"), p(None), p("a b c d e f")] == [True, True, False, False, False, False, False]


def test_sentences(spark):
    assert one(spark, sentences(t('It rose. "So" it did! 5 more? yes. no'))) == ["It rose.", '"So" it did!', "5 more? yes. no"]


def test_pieces():
    para = lambda n: "x" * (4 * n)
    assert pieces(None) == [] and pieces("") == [] and pieces(" \n\n ") == []
    assert [rough_count(c) for c in pieces("\n\n".join([para(100)] * 5), target=250, most=1000, least=50)] == [200, 200, 100]
    assert pieces("\n\n".join([para(40), para(300)]), target=250, most=1000, least=50) == [para(40) + "\n\n" + para(300)]  # the first isn't enough yet
    assert pieces("\n\n".join([para(240), para(30)]), target=250, most=1000, least=50) == [para(240) + "\n\n" + para(30)]  # a short tail joins
    big = " ".join("A" + "b" * 39 + "." for _ in range(60))
    cut = pieces(big, target=100, most=200, least=10)
    assert " ".join(cut) == big and all(rough_count(c) <= 110 for c in cut)


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "a\n\nb", "s", "old"), (2, None, "s", "old"), (3, "", "s", "old")], "doc int, text string, section string, chunk string")
    got = with_chunk_ids(chunk(df, "text"), "section", "doc", "section").collect()
    assert [(r["chunk_id"], r["chunk"], r["token_count"]) for r in got] == [("s:1:s:000", "a\n\nb", 1)]


def test_markup(spark):
    html = "<html><script>no</script><div><p>One &amp; two</p><p>Three<li>x</div><article><h1>Head</h1><time datetime='2024-05-01'>May</time><p>Body <b>bold</b></p></article><a href='/news/2024-05-01-a'>l</a><a href='/news/2024-05-01-a'>l</a></html>"
    assert one(spark, html_to_text(t(html))).split("\n\n")[1:3] == ["One & two", "Three x"] or "One & two" in one(spark, html_to_text(t(html)))
    a = one(spark, parse_article(t(html)))
    assert (a["headline"], a["date_raw"], a["body"]) == ("Head", "2024-05-01", "Body bold")
    assert one(spark, article_links(t(html), "https://example.org/news")) == ["https://example.org/news/2024-05-01-a"]
    assert one(spark, html_to_text(t(None))) == "" and one(spark, html_to_text(t("plain"))) == "plain"
    assert one(spark, parse_article(t("<span class='post-date'>May 2</span><p>x</p>")))["date_raw"] == "May 2"


ANSWERS = [
    ('```json\n{"sentiment": "positive", "sentiment_score": 1.7, "topics": ["capital", "made up"], "key_quote": "q"}\n```', ("positive", 1.0, ["capital"])),
    ('{"sentiment": "negative", "sentiment_score": -0.2, "topics": []}', ("negative", -0.2, ["other"])),
    ('{"sentiment": "glad", "sentiment_score": 0.1, "topics": []}', None),
    ('{"sentiment": "neutral", "topics": []}', None),
    ('{"sentiment": "neutral", "sentiment_score": 0.0}', None),
    ("not json", None),
    (None, None),
]


@pytest.mark.parametrize("answer,want", ANSWERS)
def test_answers(spark, answer, want):
    got = one(spark, an.parse_answer(t(answer)))
    assert (None if got is None else (got["sentiment"], got["sentiment_score"], got["topics"])) == want


def test_annotation_is_incremental(spark):
    c = spark.createDataFrame([(i, f"text {i % 4}") for i in range(8)], "id int, chunk string")
    first = an.pending(c, spark.createDataFrame([], "cache_key string"), "chunk", "v1", "m")
    assert first.count() == 8
    again = an.pending(c.unionByName(spark.createDataFrame([(9, "new")], c.schema)), first.select("cache_key"), "chunk", "v1", "m")
    assert [r["id"] for r in again.collect()] == [9]
    assert an.pending(c, first.select("cache_key"), "chunk", "v2", "m").count() == 8

    def model(asks):
        return [None if "2" in a else '{"sentiment": "neutral", "sentiment_score": 0, "topics": ["other"]}' for a in asks]

    got = {r["id"]: r["output"] for r in an.annotate(first, "chunk", model).collect()}
    assert all((o is None) == (i % 4 == 2) for i, o in got.items())
    ask = one(spark, an.prompt(t("news"), t(None), t("body"), t(None), t(None), t("TEXT")))
    assert "TEXT" in ask and "Said by" not in ask and ask.startswith("Excerpt of news, , part body.")


def test_inherit(spark):
    turn = lambda n, r: F.struct(F.lit(n).alias("speaker_name"), F.lit("aff " + n).alias("affiliation"), F.lit(r).alias("role"), F.lit("x").alias("text"))
    got = one(spark, inherit_executive(F.array(turn("In It", "other"), turn("Ann Lee", "ceo"), turn("In It", "other"), turn("Bob Ray", "other"), turn("Tech Markets", "other"))))
    assert [(r["speaker_name"], r["role"]) for r in got] == [("In It", "other"), ("Ann Lee", "ceo"), ("Ann Lee", "ceo"), ("Bob Ray", "other"), ("Ann Lee", "ceo")]


def test_addresses(spark):
    from tidemark.functions import links as ln

    urls = ["https://x/ca/2024-05-23-q2-2024-transcript.pdf", "https://x/fr/2024-transcript.pdf", "https://x/2023q4-report-to-shareholders.PDF", "https://x/bmo-transcript.pdf", "https://x/E-2022-Form40F.pdf", "https://x/2024_13_45/q", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    u = F.col("u")
    got = df.select("i", ln.day_in(u).cast("string").alias("d"), ln.quarter_in(u).alias("q"), ln.annual_year_in(u).alias("y"), ln.is_transcript(u).alias("t"), ln.is_shareholder_report(u).alias("s")).orderBy("i").collect()
    assert [r["d"] for r in got] == ["2024-05-23"] + [None] * 6 and [r["q"] for r in got][:3] == ["FY2024Q2", None, "FY2023Q4"]
    assert [r["t"] for r in got] == [True] + [False] * 6 and [r["s"] for r in got] == [False, False, True] + [False] * 4 and got[4]["y"] == 2022
    twice = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 0, "z")], "u string, o int, v string")
    assert [tuple(r) for r in ln.first_seen(twice, "u", "o").collect()] == [("a", 1, "y")]


def test_second_annotator(spark):
    r = one(spark, an.second_score(F.lit(0.5), F.lit(0.2), F.lit(0.3)))
    assert (r["label"], r["score"]) == ("positive", 0.3) and one(spark, an.second_score(F.lit(0.1), F.lit(0.4), F.lit(0.4)))["label"] == "negative"


# builders ---------------------------------------------------------------------------------------------------
def test_three_builders(spark):
    from tidemark.text.builders import release_chunks, report_chunks, transcript_chunks

    docs = spark.createDataFrame([(1, "Bank gains", "First words.\n\nPage 2 of 9\n\nSecond words."), (2, None, "Alone."), (3, "Empty", "- 4 -"), (4, "Nothing", None)], "doc_id long, headline string, text string")
    got = {r["chunk_id"]: r["chunk"] for r in release_chunks(docs).collect()}
    assert got == {"news:1:press_release:000": "Bank gains\n\nFirst words.\n\nSecond words.", "news:2:press_release:000": "Alone."}
    long = "word " * 150
    docs = spark.createDataFrame([(1, f"{long}\n\nCredit risk\n\n{long}"), (2, "too short"), (3, long), (4, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["section"], r["chunk_no"]) for r in report_chunks(docs).collect()}
    assert got == {(1, "preamble", 0), (1, "credit risk", 0), (3, "body", 0)}
    call = "Jane Doe - Chief Executive Officer\nGood morning.\n\nWe grew.\nQuestion and Answer\nJohn Roe - Analyst, \nNo.\nOperator\nNext."
    docs = spark.createDataFrame([(1, call, 7), (2, "nobody speaks", 8), (3, None, 9)], "doc_id long, text string, chunk int")
    rows = transcript_chunks(docs).orderBy("turn").collect()
    assert [(r["section"], r["speaker"]["name"], r["speaker"]["role"], r["chunk"]) for r in rows if r["doc_id"] == 1][0] == ("prepared_remarks", "Jane Doe", "ceo", "Good morning.\n\nWe grew.") or rows[0]["speaker"]["role"] == "ceo"
    assert {r["doc_id"] for r in rows} == {1} and rows[0]["chunk_id"].startswith("transcripts:1:prepared_remarks:t0:")


def test_questions_that_begin_the_text(spark):
    from pyspark.sql import functions as F
    from tidemark.text.turns import split_questions

    rows = spark.createDataFrame([("We'll now take questions from the telephone lines.",), ("a\nQ & A\nb",), ("a\nb",), (None,), ("x\nWe will now take questions from the telephone.\ny",)], "t string")
    got = [tuple(r[0]) for r in rows.select(split_questions(F.col("t"))).collect()]
    assert got == [("", "We'll now take questions from the telephone lines."), ("a\n", "\nb"), ("a\nb", ""), ("", ""), ("x\n", "We will now take questions from the telephone.\ny")]
