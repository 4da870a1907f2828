"""Catalogue, tags and audits of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.tags import add_col, all_like, any_tag, remove_col, split_col
from quire.functions.text import path_key, windows_path
from quire.operators.evaluation import within_vocabulary
from quire.operators.ledger import (cache_misses, cache_stats, deletion, duplicates, image_registry, match_manifest, mismatches, missing_guids, orphan_footnotes, reconcile,
                                    tag_audit, tag_cloud, untagged, with_counts, is_complete)
from quire.queries.retrieval import _BOOK, _CHUNK, store
from quire.session import table

#: words that the tag audit refuses, stated so that the SQL can have the same
KEYWORDS = frozenset({"language", "index", "select", "table", "order"})


def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per table and bucket."""
    book = store(spark, sf_dir)["book"].select(F.lit("documents_book").alias("table_name"), "bucket")
    docs = table(spark, sf_dir, "documents").where("category <> 'book'").select(F.concat(F.lit("documents_"), F.col("category")).alias("table_name"), F.col("source").alias("bucket"))
    return book.unionByName(docs).groupBy("table_name", "bucket").agg(F.count("*").alias("documents"))


def tags_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_cloud(store(spark, sf_dir)["book"])


def books_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any of two tags, exactly; and all of two parts, loosely."""
    b = store(spark, sf_dir)["book"].select("guid", "tags", any_tag(F.col("tags"), ["geology", "atlas"]).alias("any_exact"), all_like(F.coalesce("tags", F.lit("")), ["o", "l"]).alias("all_loose"))
    return b.where("any_exact or all_loose")


def tags_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = store(spark, sf_dir)["book"]
    return b.select("guid", add_col(F.col("tags"), ["atlas"]).alias("with_atlas"), remove_col(F.col("tags"), ["language"]).alias("without_language"))


def tag_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_audit(store(spark, sf_dir)["book"], KEYWORDS)[0]


def tag_audit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_audit(store(spark, sf_dir)["book"], KEYWORDS)[1].select("defect", "guid", "element")


def ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)["book"].groupBy("status").agg(F.count("*").alias("books"))


def ledger_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)["book"].where("status is null or status <> 'done'").select("guid", "status", "title")


def ledger_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store(spark, sf_dir)
    return mismatches(t["book"], t["chunk"]).select("guid", "expected_chunks", "actual")


def ledger_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store(spark, sf_dir)
    b = with_counts(t["book"], t["chunk"])
    return b.select(is_complete(F.col("status"), F.col("actual"), F.col("expected_chunks")).alias("complete")).groupBy("complete").agg(F.count("*").alias("books"))


def ledger_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of one path, and documents of one text."""
    books = duplicates(table(spark, sf_dir, "documents_book"), "source_path_hash", "guid").withColumnRenamed("source_path_hash", "key")
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), F.col("doc_id").cast("string").alias("doc_id"))
    return books.withColumn("table_name", F.lit("documents_book")).unionByName(duplicates(d, "key", "doc_id").withColumn("table_name", F.lit("documents")))


def ledger_untagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return untagged(store(spark, sf_dir)["book"]).select("guid", "title")


def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side-car files' books against stored books, by path of the stored file."""
    t = store(spark, sf_dir)
    have = table(spark, sf_dir, "book_middle").select(F.lower("book_guid").alias("guid")).distinct()
    files = t["book"].join(have, "guid", "left_semi").select(windows_path(F.col("source_path")).alias("path"))
    return reconcile(files, t["book"].where("bucket is not null"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)["book"].select("guid", windows_path(F.col("source_path")).alias("windows"), path_key(F.col("source_path")).alias("path_key"))


def delete_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left of each table without the books under one folder."""
    t = store(spark, sf_dir)
    gone = t["book"].where(path_key(F.col("source_path")).startswith("/mnt/d/shelf")).select("guid")
    out = None
    for n, left in deletion(t, gone).items():
        one = left.agg(F.count("*").alias("rows_left")).select(F.lit(n).alias("table_name"), "rows_left")
        out = one if out is None else out.unionByName(one)
    return out


def asked_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_guids(table(spark, sf_dir, "removed_books").select(F.col("book_guid").alias("guid")), store(spark, sf_dir)["book"])


def manifest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation records made of removed books and titles: by guid, then path, then title."""
    b = store(spark, sf_dir)["book"].select("guid", F.lit(None).cast("string").alias("content_md5"), "source_path", "title")
    by_guid = table(spark, sf_dir, "removed_books").select(F.concat(F.lit("g:"), "book_guid").alias("row"), F.col("book_guid").alias("guid"), F.lit(None).cast("string").alias("source_path"), F.lit(None).cast("string").alias("title"))
    by_title = b.groupBy("title").agg(F.min("source_path").alias("p")).select(F.concat(F.lit("t:"), "title").alias("row"), F.lit(None).cast("string").alias("guid"), F.lit(None).cast("string").alias("source_path"), "title")
    m = by_guid.unionByName(by_title).withColumn("content_md5", F.lit(None).cast("string")).where("row is not null").dropDuplicates(["row"])
    return match_manifest(m, b)


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector cache as the store's vectors of the first copies: expiring 90 days after they were made."""
    t = store(spark, sf_dir)
    c = t["vec"].groupBy("chunk_id").agg(F.min("indexed_at").alias("at"), F.min_by("embedding", F.struct("indexed_at", "embedding")).alias("embedding")).join(t["chunk"].select("chunk_id", "text_hash"), "chunk_id")
    return c.where("text_hash is not null").groupBy("text_hash").agg(F.max("at").alias("at"), F.max_by("embedding", F.struct("at", "embedding")).alias("embedding")).select(
        "text_hash", F.lit("m").alias("model"), "embedding", (F.col("at") + F.expr("interval 90 days")).alias("expires_at"))


def embed_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cache(spark, sf_dir).withColumn("expires_at", F.lit(None).cast("timestamp"))
    return cache_misses(store(spark, sf_dir)["chunk"], c, F.col("text_hash"), "m")


def cache_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals at a stated time."""
    return cache_stats(_cache(spark, sf_dir), F.to_timestamp_ntz(F.lit("2025-12-01 00:00:00"))).select("total", "expired")


def images_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "book_content_list_v2").where("content.image_source.path is not null").groupBy("entry_id").agg(F.min("content.image_source.path").alias("path"))
    return image_registry(e.select(F.md5("path").alias("md5"), F.lit(None).cast("string").alias("ocr_text"))).select("md5", "refs")


def footnotes_orphaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnote blocks of books that aren't stored whole, by book."""
    f = table(spark, sf_dir, "normalized_block").where("block_type in ('page_footnote', 'footnote') and book_guid is not null").select("book_guid", "block_id").distinct()
    return orphan_footnotes(f, store(spark, sf_dir)["book"].where("status = 'done'")).groupBy("book_guid").agg(F.count("*").alias("blocks"))


def tags_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose tags all occur in the first bucket's books."""
    b = store(spark, sf_dir)["book"].select(F.col("guid").alias("id"), "bucket", split_col(F.coalesce("tags", F.lit(""))).alias("t"))
    return within_vocabulary(b, "t", b.where("bucket = '馆藏'").select(F.explode("t").alias("tag")))


QUERIES = {f.__name__: f for f in (footnotes_orphaned, tags_known, bucket_counts, tags_used, books_by_tag, tags_edited, tag_audit_counts, tag_audit_samples, ledger_status, ledger_unfinished, ledger_mismatch,
                                   ledger_complete, ledger_dupes, ledger_untagged, ledger_reconcile, paths, delete_counts, asked_missing, manifest_match, embed_cache_miss,
                                   cache_expired, images_referenced)}
_B = f"WITH {_BOOK}, b AS (SELECT guid, r.c AS title, r.d AS bucket, r.e AS tags, r.f AS source_path, r.g AS status, r.h AS expected_chunks FROM book)"
_BC = f"WITH {_BOOK}, {_CHUNK}, b AS (SELECT guid, r.c AS title, r.d AS bucket, r.e AS tags, r.f AS source_path, r.g AS status, r.h AS expected_chunks FROM book)"
_TAGS = "list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
_WIN = r"CASE WHEN regexp_matches(source_path, '^/mnt/[A-Za-z](/|$)') THEN upper(source_path[6]) || ':\' || replace(regexp_replace(source_path, '^/mnt/[A-Za-z]/?', ''), '/', '\') ELSE source_path END"
_KEY0 = r"regexp_replace(regexp_replace(replace(source_path, '\', '/'), '^([A-Za-z]):/*', '/mnt/\1/'), '/{2,}', '/', 'g')"
_KEY = rf"(CASE WHEN regexp_matches({_KEY0}, '^/mnt/[A-Za-z]/') THEN '/mnt/' || lower(({_KEY0})[6]) || substr({_KEY0}, 7) ELSE {_KEY0} END)"
_AUDIT = f""", e AS (SELECT DISTINCT guid, trim(x) AS element, CASE WHEN trim(coalesce(tags, '')) = '' THEN 'empty' WHEN trim(x) = '' THEN 'broken_csv'
  WHEN upper(trim(x)) = 'OMNIA' THEN 'sentinel' WHEN regexp_matches(trim(x), '[''"`;\\\\\\n\\r\\t]') THEN 'illegal'
  WHEN lower(trim(x)) IN ({', '.join(repr(k) for k in sorted(KEYWORDS))}) THEN 'keyword' END AS defect
  FROM (SELECT guid, tags, unnest(string_split(coalesce(tags, ''), ',')) AS x FROM b))"""
SQL = {
    "footnotes_orphaned": _B + """ SELECT book_guid, count(DISTINCT block_id) AS blocks FROM normalized_block WHERE block_type IN ('page_footnote', 'footnote') AND book_guid IS NOT NULL
      AND lower(book_guid) NOT IN (SELECT guid FROM b WHERE status = 'done') GROUP BY 1""",
    "tags_edited": _B + f""", t AS (SELECT guid, {_TAGS} AS t FROM b), u AS (SELECT guid, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM t)
      SELECT guid, array_to_string(CASE WHEN list_contains(t, 'atlas') THEN t ELSE list_append(t, 'atlas') END, ',') AS with_atlas, array_to_string(list_filter(t, lambda x: x <> 'language'), ',') AS without_language FROM u""",
    "tags_known": _B + f""", v AS (SELECT DISTINCT unnest({_TAGS}) AS tag FROM b WHERE bucket = '馆藏'), e AS (SELECT guid, unnest({_TAGS}) AS tag FROM b)
      SELECT b.guid AS id, b.guid NOT IN (SELECT guid FROM e WHERE tag NOT IN (SELECT tag FROM v)) AS all_known FROM b""",
    "bucket_counts": _B + """ SELECT table_name, bucket, count(*) AS documents FROM (SELECT 'documents_book' AS table_name, bucket FROM b
      UNION ALL SELECT 'documents_' || category, source FROM documents WHERE category <> 'book') GROUP BY ALL""",
    "tags_used": _B + f" SELECT tag, count(*) AS n FROM (SELECT unnest({_TAGS}) AS tag FROM b WHERE tags IS NOT NULL) GROUP BY 1",
    "books_by_tag": _B + f" SELECT guid, tags, list_has_any({_TAGS}, ['geology', 'atlas']) AS any_exact, contains(coalesce(tags, ''), 'o') AND contains(coalesce(tags, ''), 'l') AS all_loose FROM b WHERE any_exact OR all_loose",
    "tag_audit_counts": _B + _AUDIT + " SELECT defect, count(DISTINCT guid) AS books FROM e WHERE defect IS NOT NULL GROUP BY 1",
    "tag_audit_samples": _B + _AUDIT + " SELECT defect, guid, element FROM (SELECT *, row_number() OVER (PARTITION BY defect ORDER BY guid, element) AS rn FROM e WHERE defect IS NOT NULL) WHERE rn <= 5",
    "ledger_status": _B + " SELECT status, count(*) AS books FROM b GROUP BY 1",
    "ledger_unfinished": _B + " SELECT guid, status, title FROM b WHERE status IS NULL OR status <> 'done'",
    "ledger_mismatch": _BC + """, n AS (SELECT guid, count(*) AS n FROM chunk GROUP BY 1)
      SELECT guid, expected_chunks, coalesce(n, 0) AS actual FROM b LEFT JOIN n USING (guid) WHERE coalesce(n, 0) <> expected_chunks""",
    "ledger_complete": _BC + """, n AS (SELECT guid, count(*) AS n FROM chunk GROUP BY 1)
      SELECT coalesce(status = 'done' AND coalesce(n, 0) = expected_chunks, false) AS complete, count(*) AS books FROM b LEFT JOIN n USING (guid) GROUP BY 1""",
    "ledger_dupes": """SELECT 'documents_book' AS table_name, source_path_hash AS key, count(DISTINCT guid) AS n, concat_ws(',', min(guid), max(guid)) AS labels FROM documents_book WHERE source_path_hash IS NOT NULL GROUP BY 2
      HAVING count(DISTINCT guid) > 1 UNION ALL SELECT 'documents', md5(text), count(DISTINCT doc_id), concat_ws(',', min(doc_id::VARCHAR), max(doc_id::VARCHAR)) FROM documents WHERE text IS NOT NULL GROUP BY 2 HAVING count(DISTINCT doc_id) > 1""",
    "ledger_untagged": _B + " SELECT guid, title FROM b WHERE trim(coalesce(tags, '')) = ''",
    "ledger_reconcile": _B + f""", f AS (SELECT DISTINCT {_KEY} AS path FROM b WHERE guid IN (SELECT lower(book_guid) FROM book_middle) AND source_path IS NOT NULL),
      k AS (SELECT DISTINCT {_KEY} AS path FROM b WHERE bucket IS NOT NULL AND source_path IS NOT NULL)
      SELECT path, 'missing' AS state FROM f WHERE path NOT IN (FROM k) UNION ALL SELECT path, 'extra' FROM k WHERE path NOT IN (FROM f)""",
    "paths": _B + f" SELECT guid, {_WIN} AS windows, {_KEY} AS path_key FROM b",
    "delete_counts": _BC + f""", gone AS (SELECT guid FROM b WHERE starts_with({_KEY}, '/mnt/d/shelf')), lost AS (SELECT chunk_id FROM chunk WHERE guid IN (FROM gone))
      SELECT 'fts' AS table_name, count(*) AS rows_left FROM documents_book_chunk_fts WHERE chunk_id IS NULL OR chunk_id NOT IN (FROM lost)
      UNION ALL SELECT 'vec', count(*) FROM documents_book_chunk_vec WHERE chunk_id IS NULL OR chunk_id NOT IN (FROM lost)
      UNION ALL SELECT 'chunk', count(*) FROM chunk WHERE guid IS NULL OR guid NOT IN (FROM gone)
      UNION ALL SELECT 'book', count(*) FROM b WHERE guid NOT IN (FROM gone)""",
    "asked_missing": _B + " SELECT DISTINCT lower(book_guid) AS guid FROM removed_books WHERE lower(book_guid) NOT IN (SELECT guid FROM b)",
    "manifest_match": _B + """, g AS (SELECT DISTINCT 'g:' || book_guid AS row, lower(book_guid) AS k FROM removed_books WHERE book_guid IS NOT NULL),
      t AS (SELECT title, trim(title) AS k FROM b WHERE title IS NOT NULL GROUP BY ALL), bt AS (SELECT trim(title) AS k, count(DISTINCT guid) AS n, min(guid) AS guid FROM b WHERE title IS NOT NULL GROUP BY 1)
      SELECT row, b.guid AS matched_guid, CASE WHEN b.guid IS NOT NULL THEN 'guid' END AS matched_by, CASE WHEN b.guid IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS state FROM g LEFT JOIN b ON b.guid = g.k
      UNION ALL SELECT 't:' || t.title, CASE WHEN n = 1 THEN bt.guid END, 'title', CASE WHEN n = 1 THEN 'matched' ELSE 'refused' END FROM t JOIN bt USING (k)""",
    "embed_cache_miss": _BC + """ SELECT DISTINCT md5(content) AS text_hash FROM chunk WHERE content IS NOT NULL
      AND md5(content) NOT IN (SELECT md5(c.content) FROM chunk c JOIN documents_book_chunk_vec v USING (chunk_id) WHERE c.content IS NOT NULL)""",
    "cache_expired": _BC + """, a AS (SELECT chunk_id, min(indexed_at) AS made FROM documents_book_chunk_vec GROUP BY 1),
      h AS (SELECT md5(content) AS h, max(made) + INTERVAL 90 DAY AS x FROM a JOIN chunk USING (chunk_id) WHERE content IS NOT NULL GROUP BY 1)
      SELECT count(*) AS total, count(*) FILTER (x IS NOT NULL AND x <= TIMESTAMP '2025-12-01') AS expired FROM h""",
    "images_referenced": """SELECT md5(p) AS md5, count(*) AS refs FROM (SELECT entry_id, min(content.image_source.path) AS p FROM book_content_list_v2
      WHERE content.image_source.path IS NOT NULL GROUP BY 1) GROUP BY 1""",
}
