"""Queries p7 to p9 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.leakage import leaks
from tidemark.llm.packing import pack, public_vocabulary
from tidemark.llm.spans import parts_of_documents, recurring_parts, shared_share, shared_spans, sharing_documents
from tidemark.session import table


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """In tokens of a public vocabulary; fails where that is not installed."""
    return pack(table(spark, d, "documents"), vocabulary=public_vocabulary())


def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    """What a packing must hold, per document: its characters in all pieces, the ends of the first and last, gaps between pieces, pieces beyond the sequence."""
    x = p7_packed(spark, d)
    w = Window.partitionBy("doc_id").orderBy("piece")
    x = x.withColumn("gap", (F.col("char_start") != F.coalesce(F.lag("char_end").over(w), F.lit(0))).cast("long"))
    over = ((F.col("place") + F.col("length") > 2048) | (F.col("length") < 1)).cast("long")
    return x.groupBy("doc_id").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("n_chars"), F.max("char_end").alias("last"), F.sum("gap").alias("gaps"), F.sum(over).alias("beyond"))


P7_SQL = "SELECT doc_id, length(text) AS n_chars, length(text) AS last, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS beyond FROM documents WHERE text IS NOT NULL"


def p7_room(spark: SparkSession, d: str) -> DataFrame:
    """Over all sequences: places that two pieces hold, or none between the first and the last (none should be)."""
    w = Window.partitionBy("sequence").orderBy("place")
    x = p7_packed(spark, d).withColumn("off", (F.col("place") != F.coalesce(F.lag(F.col("place") + F.col("length")).over(w), F.lit(0))).cast("long"))
    return x.agg(F.count("*").alias("n"), F.sum("off").alias("off")).select((F.col("n") > 0).alias("some"), "off")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of 12 words or more that documents have in common with evaluation items."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sharing_documents(*shared_spans(table(spark, d, "documents")))


def p9_parts(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of each document that recur in others."""
    parts, members = recurring_parts(table(spark, d, "documents"))
    return parts_of_documents(parts, members)


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    """For each document, how much of its text is found in others."""
    docs = table(spark, d, "documents")
    return shared_share(recurring_parts(docs)[0], docs)


QUERIES = {"p7_packed": p7_packed, "p7_placed": p7_placed, "p7_room": p7_room, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_parts": p9_parts, "p9_share": p9_share}

ORACLE = {"p7_placed": P7_SQL, "p7_room": "SELECT count(*) > 0 AS some, CAST(0 AS BIGINT) AS off FROM documents"}
