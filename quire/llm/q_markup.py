"""Problem 2: markup residue in text documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.markup import convert, elements, written_in
from quire.operators.references import guid_key
from quire.session import spread_table


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of both tables; a book is the host of its pages."""
    a = spread_table(spark, sf_dir, "documents_book_chunk").select(
        F.lit("documents_book_chunk").alias("table_name"), F.col("chunk_id").alias("row_id"), guid_key(F.col("book_guid")).alias("host"), F.col("content").alias("text"))
    b = spread_table(spark, sf_dir, "book_content_list_v2").select(
        F.lit("book_content_list_v2").alias("table_name"), F.col("entry_id").alias("row_id"), guid_key(F.col("book_guid")).alias("host"), F.col("content.content").alias("text"))
    return a.unionByName(b)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_in(elements(marked(spark, sf_dir)))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(marked(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
SQL: dict[str, str] = {}
