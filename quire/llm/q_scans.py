"""Problem 4: noise in text from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.scans import noise, repair
from quire.operators.references import guid_key
from quire.session import spread_table, table

#: the share of a page's height that is its upper or lower margin
MARGIN = 0.08
HEADINGS = ["title", "paragraph_title", "doc_title"]


def scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(texts of both tables, titles of the books)."""
    chunk = spread_table(spark, sf_dir, "documents_book_chunk").select(
        F.lit("documents_book_chunk").alias("table_name"), F.col("chunk_id").alias("row_id"),
        F.coalesce(guid_key(F.col("book_guid")), F.concat(F.lit("chunk "), F.col("chunk_id"))).alias("book"),
        F.col("heading_path").alias("heading"), F.lit(False).alias("is_heading"), F.col("content").alias("text"),
        F.lit(None).cast("int").alias("page"), F.lit(None).cast("boolean").alias("margin"))
    block = spread_table(spark, sf_dir, "normalized_block").select(
        F.lit("normalized_block").alias("table_name"), F.col("block_id").alias("row_id"),
        F.coalesce(guid_key(F.col("book_guid")), F.concat(F.lit("block "), F.col("block_id"))).alias("book"), F.lit(None).cast("string").alias("heading"),
        F.coalesce(F.col("raw_type").isin(HEADINGS), F.lit(False)).alias("is_heading"), "text",
        F.col("page_idx").alias("page"), ((F.get("bbox01", F.lit(3)) < MARGIN) | (F.get("bbox01", F.lit(1)) > 1 - MARGIN)).alias("margin"))
    titles = table(spark, sf_dir, "documents_book").select(guid_key(F.col("guid")).alias("book"), F.col("key_metadata").alias("title"))
    return chunk.unionByName(block).where("row_id is not null"), titles


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(*scanned(spark, sf_dir))[0]


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(*scanned(spark, sf_dir)).select("table_name", "row_id", "repaired")


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
SQL: dict[str, str] = {}
