"""Queries over document texts, with their SQL where its regular expressions can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import content_key, fiscal_quarter, quarter_label, rough_tokens, slug, written_date
from tidemark.session import table
from tidemark.text import annotate as an
from tidemark.text.builders import release_chunks, report_chunks, transcript_chunks
from tidemark.text.chunks import chunk, sentences, with_chunk_ids
from tidemark.text.clean import BOILERPLATE, PAGE_LINES, any_of, clean_text, is_administrative, is_table_heavy, sections_or_body
from tidemark.text.html import article_links, html_to_text, parse_article
from tidemark.text.turns import split_questions, transcript


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def clean_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).select("doc_id", clean_text(F.col("text")).alias("t"))
    return x.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


_S = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\x{0B}\x{1C}-\x{1F}\x{85}]"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


_PARAS = f"list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda p: {_strip('p')}), lambda p: p <> '')"
_KEPT = f"list_filter({_PARAS}, lambda p: NOT (regexp_matches(p, '{_q(any_of(PAGE_LINES))}') AND length(p) < 100) AND NOT (regexp_matches(lower(p), '{_q(any_of(BOILERPLATE))}') AND length(p) < 400))"
_COLLAPSED = "regexp_replace(regexp_replace(p, '[ \\t]+', ' ', 'g'), '" + _S + "*\\n" + _S + "*', ' ', 'g')"
_FLAT = f"array_to_string(list_transform({_KEPT}, lambda p: {_strip(_COLLAPSED)}), chr(10) || chr(10))"
CLEAN_SQL = f"WITH c AS (SELECT doc_id, {_FLAT} AS t FROM documents) SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS digest FROM c"


def text_flags(spark: SparkSession, d: str) -> DataFrame:
    """Table-heavy and administrative texts, rough tokens."""
    return _docs(spark, d).select("doc_id", is_table_heavy(F.col("text"), 0.05).alias("table_heavy"), is_administrative(F.col("text"), F.col("speaker_role")).alias("administrative"), rough_tokens(F.col("text")).alias("tokens"))


_WORDS = f"list_filter(string_split_regex(text, '{_S}+'), lambda w: w <> '')"
FLAGS_SQL = f"""SELECT doc_id, coalesce(len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^[\\d,.$%()\\-/|]+$'))) / CAST(nullif(len({_WORDS}), 0) AS DOUBLE) > 0.05, true) AS table_heavy,
  coalesce(speaker_role, '') = 'ir' OR (len({_WORDS}) < 80 AND regexp_matches(lower(text), 'introduced|introduce|leadership team|participants|presenting|joining|welcome|moderator|operator')) AS administrative,
  CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents"""


def document_labels(spark: SparkSession, d: str) -> DataFrame:
    """Quarter by date, by label in either spelling, slug, content key."""
    x = _docs(spark, d)
    return x.select("doc_id", fiscal_quarter(F.col("doc_date")).alias("by_date"), quarter_label(F.col("fiscal_quarter")).alias("by_label"), slug(F.col("text")).alias("slug"), content_key(F.col("text"), F.lit("v1"), F.lit("m")).alias("key"))


LABELS_SQL = """SELECT doc_id, 'FY' || (year(doc_date) + CAST(month(doc_date) >= 11 AS INTEGER)) || 'Q' || ((month(doc_date) + 1) % 12 // 3 + 1) AS by_date,
  CASE WHEN regexp_full_match(fiscal_quarter, 'FY[0-9]{4}-?Q[1-4]') THEN replace(fiscal_quarter, '-', '') END AS by_label,
  substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug,
  sha256(CAST(encode(text) || '\\x00'::BLOB || encode('v1') || '\\x00'::BLOB || encode('m') AS BLOB)) AS key FROM documents"""


#: Lines that stand alone in these documents; those of reports proper don't occur in them.
STANDING = ("table of contents", "skip to content", "back to newsroom", "share this release", "click here to unsubscribe")


def section_islands(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every text, headings being here the lines that stand alone in these documents."""
    x = _docs(spark, d).select("doc_id", sections_or_body(F.col("text"), STANDING).alias("s"))
    return x.select("doc_id", F.posexplode("s").alias("n", "s")).select("doc_id", "n", "s.section", F.length("s.text").alias("n_chars"))


_MARKED = "string_split(regexp_replace(text, '(?im)^[ \\t]*(" + "|".join(STANDING) + ")[ \\t]*$', chr(1) || '\\1' || chr(2), 'g'), chr(1))"
SECTIONS_SQL = f"""WITH p AS (SELECT doc_id, text, {_MARKED} AS parts FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(parts))) AS i, unnest(parts) AS part FROM p),
t AS (SELECT doc_id, i, CASE WHEN i = 0 THEN 'preamble' ELSE lower({_strip("split_part(part, chr(2), 1)")}) END AS section, {_strip("CASE WHEN i = 0 THEN part ELSE split_part(part, chr(2), 2) END")} AS body FROM s),
f AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM t WHERE body <> '')
SELECT doc_id, CAST(n AS INTEGER) AS n, section, CAST(length(body) AS INTEGER) AS n_chars FROM f WHERE k > 1
UNION ALL SELECT doc_id, 0, 'body', CAST(length(text) AS INTEGER) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f WHERE k > 1)"""


def _speaker_lines() -> Column:
    """Texts whose "name, bank, title" lines are put as "name - title"; of a title in two parts the comma goes."""
    return F.regexp_replace("text", r"(?m)^([A-Z][\w'-]+(?: [A-Z][\w'-]+)+), [^,\n]+, ([^,\n]+)(?:,( [^,\n]+))?$", "$1 - $2$3")


def turns_roles(spark: SparkSession, d: str) -> DataFrame:
    """Speaker turns of the transcripts; speaker lines are first put as the parser knows them."""
    x = _docs(spark, d).where("source = 'transcripts'").select("doc_id", F.posexplode(transcript(_speaker_lines())).alias("n", "t"))
    return x.select("doc_id", "n", "t.section", "t.speaker_name", "t.affiliation", "t.role", F.length("t.text").alias("n_chars"))


def question_split(spark: SparkSession, d: str) -> DataFrame:
    """Texts parted where the answers begin: at the first paragraph that thanks for a question."""
    x = _docs(spark, d).select("doc_id", split_questions(F.col("text"), begin="(?m)(?=^Thank you for the question)").alias("p"))
    return x.select("doc_id", F.length("p.prepared").alias("prepared"), F.length("p.questions").alias("questions"))


QUESTIONS_SQL = """WITH p AS (SELECT doc_id, length(text) AS n, length(string_split_regex(text, '(?m)^Thank you for the question')[1]) AS k FROM documents)
SELECT doc_id, CAST(k AS INTEGER) AS prepared, CAST(n - k AS INTEGER) AS questions FROM p"""


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(sentences(F.col("text"))).alias("n_sentences"))


SENTENCES_SQL = """SELECT doc_id, CAST(CASE WHEN trim(text, ' ') = '' THEN 0 ELSE 1 + len(regexp_extract_all(text, '[.!?][ \\t\\n\\x{0B}\\f\\r]+[A-Z0-9"''\u201c]')) END AS INTEGER) AS n_sentences FROM documents"""


def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk records of all documents by what they are: releases headed by issuer and quarter, reports of 500 characters or more by section, calls turn by turn."""
    x = _docs(spark, d)
    release = release_chunks(x.where("source = 'news'").withColumn("headline", F.concat_ws(" ", "issuer", "fiscal_quarter")), keep=["fiscal_quarter"])
    reports = [report_chunks(x.where(F.col("source") == s), source=s, headings=STANDING, keep=["fiscal_quarter"]) for s in ("reports_quarterly", "reports_40f")]
    calls = transcript_chunks(x.where("source = 'transcripts'").withColumn("text", _speaker_lines()), keep=["fiscal_quarter"])
    out = release
    for c in [*reports, calls]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out.select("chunk_id", "source_type", "doc_id", "section", "fiscal_quarter", "chunk_no", "token_count", "speaker.role", F.md5("chunk").alias("digest"))


def source_totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents that make chunks, by source, with the characters of their cleaned texts: what source_chunks has to hold."""
    x = _docs(spark, d).where("source <> 'transcripts'").select("doc_id", "source", "text")
    parts = [release_chunks(x.where("source = 'news'").withColumn("headline", F.lit(None).cast("string")))]
    parts += [report_chunks(x.where(F.col("source") == s), source=s, headings=("no such heading",)) for s in ("reports_quarterly", "reports_40f")]
    c = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # between chunks of paragraphs lie two line breaks; between those of sentences one blank, which doesn't count here
    return c.groupBy("source_type").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum(F.length(F.regexp_replace("chunk", r"(?U)\s", ""))).alias("n_chars"))


TOTALS_SQL = f"""WITH c AS (SELECT doc_id, source, {_FLAT} AS t FROM documents WHERE source <> 'transcripts')
SELECT source AS source_type, count(DISTINCT doc_id) AS n_docs, CAST(sum(length(regexp_replace(t, '{_S}', '', 'g'))) AS BIGINT) AS n_chars FROM c WHERE t <> '' AND (source = 'news' OR length(t) >= 500) GROUP BY source"""


def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every section of every cleaned text, with their ids."""
    x = _docs(spark, d).select("doc_id", "source", "speaker_role", "fiscal_quarter", clean_text(F.col("text")).alias("t"))
    x = x.select("doc_id", "source", "speaker_role", "fiscal_quarter", F.explode(sections_or_body(F.col("t"))).alias("s")).select("doc_id", "source", "speaker_role", "fiscal_quarter", "s.section", "s.text")
    c = with_chunk_ids(chunk(x, "text", target=450, most=1000, least=50), "source", "doc_id", "section")
    return c.select("chunk_id", "doc_id", "source", "section", "speaker_role", "fiscal_quarter", "chunk_no", "token_count", "chunk")


def pending_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks worth annotating whose content has no annotation yet, as that of all news has, with their prompt's length."""
    c = chunk_records(spark, d).withColumnsRenamed({"source": "source_type", "speaker_role": "role"})
    todo = an.worth_annotating(c)
    done = todo.where("source_type = 'news'").select(content_key(F.col("chunk"), F.lit("v1"), F.lit("m")).alias("cache_key"))
    p = an.pending(todo, done, "chunk", "v1", "m")
    ask = an.prompt(F.col("source_type"), F.col("fiscal_quarter"), F.col("section"), F.lit(None).cast("string"), F.col("role"), F.col("chunk"))
    return p.select("cache_key", "chunk_id", F.length(ask).alias("prompt_chars"))


def annotated_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks annotated by a stand-in for a model: a plain rule over words, answered in JSON."""
    c = chunk_records(spark, d).withColumn("ask", F.col("chunk"))

    def rule(asks: list[str]) -> list[str | None]:
        import json

        out = []
        for a in asks:
            up, dn = a.count("climbed") + a.count("recovered"), a.count("slipped") + a.count("drifted down")
            s = (up - dn) / max(1, up + dn)
            out.append(json.dumps({"sentiment": "positive" if s > 0 else "negative" if s < 0 else "neutral", "sentiment_score": s, "topics": ["capital"] if "capital" in a else [], "key_quote": a[:40]}))
        return out

    x = an.annotate(c, "ask", rule)
    return x.select("chunk_id", "output.sentiment", "output.sentiment_score", "output.topics")


def article_parse(spark: SparkSession, d: str) -> DataFrame:
    """Press releases put into a page and read out of it again."""
    x = _docs(spark, d).where("source = 'news'")
    body = F.array_join(F.transform(F.split("text", r"\n+"), lambda p: F.concat(F.lit("<p>"), F.regexp_replace(F.regexp_replace(p, "&", "&amp;"), "<", "&lt;"), F.lit("</p>"))), "")
    page = F.concat(F.lit('<html><script>x</script><article><h1>Release</h1><time datetime="'), F.col("doc_date").cast("string"), F.lit('"></time>'), body, F.lit('<a href="/news/2024-01-02-a">a</a></article></html>'))
    x = x.select("doc_id", page.alias("html"))
    return x.select("doc_id", parse_article(F.col("html")).alias("a"), F.length(html_to_text(F.col("html"))).alias("n_plain"), F.size(article_links(F.col("html"), "https://example.org/x")).alias("n_links")).select("doc_id", "a.headline", "a.date_raw", F.length("a.body").alias("n_body"), "n_plain", "n_links")


def written_dates(spark: SparkSession, d: str) -> DataFrame:
    """The date read back out of a text that is headed by it."""
    x = _docs(spark, d).select("doc_id", "doc_date", F.concat(F.lit("Ottawa, "), F.date_format("doc_date", "MMMM d, yyyy"), F.lit(" - "), "text").alias("t"))
    return x.select("doc_id", written_date(F.col("t")).alias("found"))


DATES_SQL = "SELECT doc_id, doc_date AS found FROM documents"

QUERIES = {
    "clean_paragraphs": clean_paragraphs,
    "text_flags": text_flags,
    "document_labels": document_labels,
    "section_islands": section_islands,
    "turns_roles": turns_roles,
    "question_split": question_split,
    "sentence_counts": sentence_counts,
    "source_chunks": source_chunks,
    "source_totals": source_totals,
    "chunk_records": chunk_records,
    "pending_chunks": pending_chunks,
    "annotated_chunks": annotated_chunks,
    "article_parse": article_parse,
    "written_dates": written_dates,
}

ORACLE = {"clean_paragraphs": CLEAN_SQL, "text_flags": FLAGS_SQL, "document_labels": LABELS_SQL, "written_dates": DATES_SQL, "section_islands": SECTIONS_SQL, "question_split": QUESTIONS_SQL, "sentence_counts": SENTENCES_SQL, "source_totals": TOTALS_SQL}
