"""Problem 6: most similar vectors for every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.neighbours import knn, mutual
from quire.session import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn(table(spark, sf_dir, "documents_book_chunk_vec"), "chunk_id", "embedding", k=10, dims=64, ts="indexed_at", min_sim=0.9)
    return mutual(near).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar of all rows for every row whose id is divisible by 50."""
    near = knn(table(spark, sf_dir, "documents_book_chunk_vec"), "chunk_id", "embedding", k=10, dims=64, ts="indexed_at", queries=F.col("id") % 50 == 0)
    return near.select(F.col("id").alias("chunk_id"), F.col("neighbour_id").alias("neighbour_chunk_id"), "cosine", "rank")


QUERIES = {"p6_found": p6_found, "p6_neighbours": p6_neighbours}
_V = """
WITH good AS (SELECT chunk_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, indexed_at FROM documents_book_chunk_vec
  WHERE chunk_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT chunk_id, arg_min(v, (indexed_at, v)) AS v FROM good GROUP BY 1)"""
SQL = {
    "p6_neighbours": _V + """, s AS (
  SELECT a.chunk_id, b.chunk_id AS neighbour_chunk_id, list_cosine_similarity(a.v, b.v) AS c FROM v a, v b
  WHERE a.chunk_id % 50 = 0 AND a.chunk_id <> b.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY round(c, 7) DESC, neighbour_chunk_id) AS rank FROM s)
SELECT chunk_id, neighbour_chunk_id, round(c, 7) AS cosine, rank::INT AS rank FROM r WHERE rank <= 10""",
    "p6_found": _V + """, s AS (
  SELECT a.chunk_id AS x, b.chunk_id AS y, list_cosine_similarity(a.v, b.v) AS c FROM v a, v b WHERE a.chunk_id <> b.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(c, 7) DESC, y) AS rank FROM s),
t AS (SELECT x, y FROM r WHERE rank <= 10 AND c >= 0.9)
SELECT x AS chunk_id_a, y AS chunk_id_b FROM t WHERE x < y AND EXISTS (SELECT 1 FROM t u WHERE u.x = t.y AND u.y = t.x)""",
}
