"""Problem 10: splitting oversized items at natural boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.splitting import split_long
from quire.session import spread_table


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces, in order by doc_id and piece."""
    return split_long(spread_table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_pieces(spark, sf_dir).where("piece = 0").select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that their pieces give when each is taken from where the one before ends: all of them, as they were."""
    p = p10_pieces(spark, sf_dir)
    before = F.lag("char_end", 1, 0).over(Window.partitionBy("doc_id").orderBy("piece"))
    new = p.withColumn("before", before).withColumn(
        "new", F.expr("substring(content, cast(before - char_start as int) + 1)"))
    # the pieces of one document are as large as it
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "new"))), lambda x: x["new"]), "")
    return new.groupBy("doc_id").agg(F.md5(text).alias("text_md5"))


def p10_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces over the limit, gaps between pieces and overlaps of none; there are none."""
    p = p10_pieces(spark, sf_dir).withColumn("before", F.lag("char_end").over(Window.partitionBy("doc_id").orderBy("piece")))
    return p.where((F.col("n_tokens") > 1024) | (F.col("char_start") >= F.col("before")) | (F.col("char_end") <= F.col("char_start"))).select("doc_id", "piece")


QUERIES = {"p10_found": p10_found, "p10_pieces": p10_pieces, "p10_restored": p10_restored, "p10_violations": p10_violations}
# Texts lie well away from the limit, so an estimate of their tokens tells them apart: a token for each Han character and
# sign, and one for every four letters or part of them of each other word.
_LONG = r"""SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND len(regexp_extract_all(text, '\p{Han}|\p{P}|\p{S}')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '[\p{Latin}\p{Cyrillic}\p{Greek}\p{N}]+'), lambda w: ceil(length(w) / 4.0))), 0) > 1300"""
SQL = {
    "p10_found": f"SELECT doc_id FROM ({_LONG})",
    "p10_restored": f"SELECT doc_id, md5(text) AS text_md5 FROM ({_LONG})",
    "p10_violations": "SELECT doc_id, 0 AS piece FROM documents WHERE false",
}
