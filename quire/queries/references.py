"""Queries over the document store's foreign keys (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.references import Entity, ForeignKey, guid_key, orphan_cascade, orphan_report
from quire.session import table

#: one book may own a large share of all chunks: its chunks are spread over so many tasks
BOOK_SALT = 8


def store_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("documents_book", "documents_book_chunk", "documents_book_chunk_fts", "documents_book_chunk_vec", "removed_books")}
    entities = [
        Entity("documents_book", t["documents_book"], guid_key(F.col("guid")), F.col("created_at")),
        Entity("documents_book_chunk", t["documents_book_chunk"], F.col("chunk_id"), F.col("created_at")),
        Entity("documents_book_chunk_fts", t["documents_book_chunk_fts"], F.col("chunk_id"), F.col("indexed_at")),
        Entity("documents_book_chunk_vec", t["documents_book_chunk_vec"], F.col("chunk_id"), F.col("indexed_at")),
    ]
    fks = [
        ForeignKey("documents_book_chunk", "documents_book", guid_key(F.col("book_guid")),
                   deleted=t["removed_books"].select(guid_key(F.col("book_guid")).alias("guid")), salt=BOOK_SALT),
        ForeignKey("documents_book_chunk_fts", "documents_book_chunk", F.col("chunk_id")),
        ForeignKey("documents_book_chunk_vec", "documents_book_chunk", F.col("chunk_id")),
    ]
    return orphan_cascade(entities, fks)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_orphans(spark, sf_dir).where("orphan_kind = 'direct'").select(
        "table_name", F.col("row_key").cast("bigint").alias("chunk_id"), "ref_state", F.date_format("earliest_ts", "yyyy-MM").alias("month_utc"))


def p7_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(store_orphans(spark, sf_dir))


QUERIES = {"p7_found": p7_found, "p7_orphans": p7_orphans}

_GUID = r"nullif(lower(regexp_replace({c}, '^[\s{{}}\x{{200B}}\x{{FEFF}}\x{{A0}}\x{{3000}}]+|[\s{{}}\x{{200B}}\x{{FEFF}}\x{{A0}}\x{{3000}}]+$', '', 'g')), '')"
_CTE = f"""
WITH book AS (SELECT {_GUID.format(c='guid')} AS k, min(created_at) AS ts FROM documents_book GROUP BY 1),
gone AS (SELECT DISTINCT {_GUID.format(c='book_guid')} AS k FROM removed_books),
chunk AS (SELECT chunk_id, min(created_at) AS ts, arg_min({_GUID.format(c='book_guid')}, (created_at, {_GUID.format(c='book_guid')}))
          FILTER ({_GUID.format(c='book_guid')} IS NOT NULL) AS ref FROM documents_book_chunk WHERE chunk_id IS NOT NULL GROUP BY 1),
idx AS (SELECT 'documents_book_chunk_fts' AS table_name, chunk_id, min(indexed_at) AS ts FROM documents_book_chunk_fts WHERE chunk_id IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'documents_book_chunk_vec', chunk_id, min(indexed_at) FROM documents_book_chunk_vec WHERE chunk_id IS NOT NULL GROUP BY 2),
direct AS (
  SELECT 'documents_book_chunk' AS table_name, c.chunk_id, c.ts,
    CASE WHEN b.k IS NOT NULL THEN 'late' WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS ref_state
  FROM chunk c LEFT JOIN book b ON b.k = c.ref LEFT JOIN gone g ON g.k = c.ref
  WHERE c.ref IS NOT NULL AND (b.k IS NULL OR b.ts > c.ts)
  UNION ALL
  SELECT i.table_name, i.chunk_id, i.ts, CASE WHEN c.chunk_id IS NOT NULL THEN 'late' ELSE 'missing' END
  FROM idx i LEFT JOIN chunk c USING (chunk_id) WHERE c.chunk_id IS NULL OR c.ts > i.ts)
"""
SQL = {
    "p7_found": _CTE + "SELECT table_name, chunk_id, ref_state, strftime(ts, '%Y-%m') AS month_utc FROM direct",
    "p7_orphans": _CTE + """, every AS (
  SELECT table_name, ts, ref_state, 'direct' AS orphan_kind FROM direct
  UNION ALL
  SELECT i.table_name, i.ts, 'inherited', 'inherited' FROM idx i
  WHERE EXISTS (SELECT 1 FROM direct d WHERE d.table_name = 'documents_book_chunk' AND d.chunk_id = i.chunk_id)
    AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.table_name = i.table_name AND d.chunk_id = i.chunk_id))
SELECT table_name, strftime(ts, '%Y-%m') AS month_utc, ref_state, orphan_kind, count(*) AS orphans FROM every GROUP BY ALL""",
}
