"""Retrieval over the document store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.tags import any_tag
from quire.functions.tokenizer import index_text, salvage_terms, split_terms
from quire.operators.fulltext import postings, rank, rank_postings, substring_hits, write_postings
from quire.operators.references import guid_key
from quire.operators.vectors import cosine_distance, nearest, usable, weighted_mean
from quire.plans.search import Engine, existence_signal, fuse, per_book, roll_up, weights
from quire.session import shared_dir, table

QUERY = "the luminous monastery and the parchment"
TAG = "field_notes"
K = 10


def store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables under the engine's names, one row per book and chunk: the earliest copy."""
    b = table(spark, sf_dir, "documents_book")
    book = b.select(guid_key(F.col("guid")).alias("guid"), F.struct("created_at", "updated_at", "key_metadata", "bucket_name", "tags", "source_path", "status", "expected_chunks").alias("r")).where(
        "guid is not null").groupBy("guid").agg(F.min("r").alias("r")).select(
        "guid", F.col("r.key_metadata").alias("title"), F.col("r.bucket_name").alias("bucket"), F.col("r.tags").alias("tags"), F.col("r.source_path").alias("source_path"),
        F.col("r.created_at").alias("book_created_at"), F.col("r.status").alias("status"), F.col("r.expected_chunks").alias("expected_chunks"))
    c = table(spark, sf_dir, "documents_book_chunk").where("chunk_id is not null")
    # the copy that counts is found without moving texts; those of a few hits are read by `texts_of` in the end
    first = F.struct("created_at", "book_guid", "chunk_seq", "heading_path", F.md5("content").alias("h"))
    chunk = c.select("chunk_id", F.struct(*(F.col(x) for x in ("created_at", "book_guid", "chunk_seq", "heading_path")), F.md5("content").alias("h"), "has_pua", F.length("content").alias("n_chars")).alias("r")).groupBy(
        "chunk_id").agg(F.min("r").alias("r")).select("chunk_id", guid_key(F.col("r.book_guid")).alias("guid"), "r.chunk_seq", "r.heading_path", "r.has_pua", "r.n_chars", F.col("r.h").alias("text_hash"))
    return {"book": book, "chunk": chunk, "text": c.select("chunk_id", first.alias("first"), "content"), "fts": table(spark, sf_dir, "documents_book_chunk_fts"),
            "vec": table(spark, sf_dir, "documents_book_chunk_vec")}


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks with their texts, for work over all texts."""
    r = F.struct("created_at", "book_guid", "chunk_seq", "heading_path", F.md5("content").alias("h"))
    c = table(spark, sf_dir, "documents_book_chunk").where("chunk_id is not null").groupBy("chunk_id").agg(F.min_by(F.struct("book_guid", "chunk_seq", "heading_path", "has_pua", "content"), r).alias("r"))
    return c.select("chunk_id", guid_key(F.col("r.book_guid")).alias("guid"), "r.chunk_seq", "r.heading_path", "r.has_pua", "r.content")


def _query_vector(t: dict[str, DataFrame]) -> DataFrame:
    """The vector of the first usable chunk stands for an embedded query."""
    return t["vec"].where(F.col("chunk_id").isNotNull() & usable(F.col("embedding"), 64)).orderBy("chunk_id", "indexed_at", "embedding").limit(1).select(F.col("embedding").alias("qv"))


def fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents_book_chunk_fts"), split_terms(QUERY)[0], K)


def fts_topk_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents_book_chunk_fts"), split_terms(QUERY)[0], K, mode="bm25").withColumn("score", F.round("score", 5))


def _scope(t: dict[str, DataFrame]) -> DataFrame:
    return t["chunk"].join(t["book"].where(any_tag(F.col("tags"), [TAG])), "guid", "left_semi").select("chunk_id")


def fts_topk_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store(spark, sf_dir)
    return rank(t["fts"], split_terms(QUERY)[0], K, only=_scope(t))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store(spark, sf_dir)
    return nearest(t["vec"], _query_vector(t), K)


def vector_topk_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store(spark, sf_dir)
    return nearest(t["vec"], _query_vector(t), K, only=_scope(t))


def _fused(t: dict[str, DataFrame]) -> DataFrame:
    ft = rank(t["fts"], split_terms(QUERY)[0], 3 * K)
    return fuse(ft, nearest(t["vec"], _query_vector(t), 3 * K), *weights(QUERY))


def hybrid_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(store(spark, sf_dir))


def _hits(t: dict[str, DataFrame]) -> DataFrame:
    return F.broadcast(_fused(t)).join(t["chunk"], "chunk_id").join(t["book"], "guid")


def hybrid_book_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(_hits(store(spark, sf_dir)))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search with payload: at most 3 hits a book, 10 in all."""
    out = per_book(_hits(store(spark, sf_dir)), 3, K)
    return out.select("chunk_id", "guid", "title", "score", "score_ft", "score_vec", "source", "book_score", "book_hit_count", F.col("n_chars").alias("content_chars"))


def salvage_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_hits(table(spark, sf_dir, "documents_book_chunk").where("chunk_id is not null"), salvage_terms("monastery 火山 of"), K)


def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_docs without an embedder: the degraded path is full text alone."""
    r = Engine(spark, store(spark, sf_dir)).search(QUERY, limit=K)
    return r.results.select("chunk_id", "guid", "score", "source", "book_score", F.lit("; ".join(r.meta["degraded"])).alias("degraded"))


def _documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Chats and notes as a store would hold them, without vectors."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(
        F.col("doc_id").cast("string").alias("guid"), "category", F.col("source").alias("bucket"), F.lit(None).cast("string").alias("tags"), F.col("text").alias("content"), "created_at",
        index_text(F.col("text")).alias("content_tokenized"))
    return {"chat": d.where("category = 'chat'"), "note": d.where("category = 'onenote'")}


_SHOWN = ("category", "guid", "score", "source")


def search_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, _documents(spark, sf_dir)).search(QUERY, limit=K, category="chat").results.select(*_SHOWN)


def search_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With what is shown of each document, in one bucket."""
    r = Engine(spark, _documents(spark, sf_dir)).search(QUERY, limit=K, category="onenote").results
    return r.select(*_SHOWN, "snippet", "bucket")


def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of books, chats and notes in one order."""
    return Engine(spark, store(spark, sf_dir) | _documents(spark, sf_dir)).search(QUERY, limit=K).results.select(*_SHOWN, "chunk_id")


def _by_length(query: str, texts: list[str]) -> list[float]:
    """Stands for a cross-encoder."""
    return [len(t) / 1000 for t in texts]


def rerank_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker decides the order and the books' scores; it sees the six best hits of each book."""
    r = Engine(spark, store(spark, sf_dir), rerank=_by_length).search(QUERY, limit=K, fulltext_only=True).results
    return r.select("chunk_id", "guid", "score", F.round("score_rerank", 6).alias("score_rerank"), "book_score", "book_hit_count")


def _cards(t: dict[str, DataFrame]) -> DataFrame:
    """Books by the length-weighted mean of their chunks' vectors."""
    v = t["vec"].where(usable(F.col("embedding"), 64)).groupBy("chunk_id").agg(F.min_by("embedding", F.struct("indexed_at", "embedding")).alias("embedding"))
    j = v.join(t["chunk"].select("chunk_id", "guid", F.col("n_chars").alias("w")), "chunk_id").where("w > 0 and guid is not null").join(t["book"].select("guid"), "guid", "left_semi")
    return weighted_mean(j, ["guid"], "embedding", "w").select("guid", F.col("mean").alias("embedding"))


def _book_distances(t: dict[str, DataFrame]) -> DataFrame:
    return _cards(t).crossJoin(F.broadcast(_query_vector(t))).select("guid", F.round(cosine_distance(F.col("embedding"), F.col("qv")), 5).alias("distance"))


def find_books_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book_distances(store(spark, sf_dir)).orderBy("distance", "guid").limit(K)


def find_books_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return existence_signal(_book_distances(store(spark, sf_dir)))


def read_chunk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk with its neighbours in every book: sequence numbers 4 to 6."""
    t = store(spark, sf_dir)
    return t["chunk"].where("chunk_seq between greatest(1, 5 - least(5, 1)) and 5 + least(5, 1)").join(t["book"].select("guid", "title"), "guid").select(
        "guid", "chunk_seq", "chunk_id", "title", "n_chars")


def list_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store(spark, sf_dir)
    n = t["chunk"].groupBy("guid").agg(F.count("*").alias("chunks"))
    return t["book"].join(n, "guid", "left").select("guid", "title", "bucket", "tags", F.coalesce("chunks", F.lit(0)).alias("chunks"), "book_created_at").orderBy(
        F.col("book_created_at").desc(), "guid").limit(50)


def fts_topk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index, which is written first here and kept in a store."""
    at = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    write_postings(postings(table(spark, sf_dir, "documents_book_chunk_fts")), at)
    return rank_postings(spark.read.parquet(at), split_terms(QUERY)[0], K)


QUERIES = {f.__name__: f for f in (fts_topk, fts_topk_index, fts_topk_bm25, search_chat, search_note, search_all, rerank_rollup, fts_topk_tag, vector_topk, vector_topk_tag, hybrid_fused, hybrid_book_rollup, hybrid_search, salvage_like,
                                   engine_search, find_books_ranked, find_books_signal, read_chunk_window, list_books)}

_KEPT = ", ".join(f"'{t}'" for t in split_terms(QUERY)[0])
_GUID = r"nullif(lower(regexp_replace({c}, '^[\s{{}}\x{{200B}}\x{{FEFF}}\x{{A0}}\x{{3000}}]+|[\s{{}}\x{{200B}}\x{{FEFF}}\x{{A0}}\x{{3000}}]+$', '', 'g')), '')"
_FOLD = "translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
_BOOK = f"""book AS (SELECT guid, arg_min(r, r) AS r FROM (SELECT {_GUID.format(c='guid')} AS guid,
  {{'a': created_at, 'b': updated_at, 'c': key_metadata, 'd': bucket_name, 'e': tags, 'f': source_path, 'g': status, 'h': expected_chunks}} AS r FROM documents_book) WHERE guid IS NOT NULL GROUP BY 1)"""
_CHUNK = f"""chunk AS (SELECT chunk_id, {_GUID.format(c='r.b')} AS guid, r.c AS chunk_seq, r.e AS content FROM (
  SELECT chunk_id, min({{'a': created_at, 'b': book_guid, 'c': chunk_seq, 'd': heading_path, 'e': content, 'f': has_pua}}) AS r FROM documents_book_chunk WHERE chunk_id IS NOT NULL GROUP BY 1))"""
_DOC = f"""doc AS (SELECT chunk_id, list_filter(string_split_regex({_FOLD.format(c='t')}, '[ \\n\\t]+'), lambda x: x <> '') AS w FROM (
  SELECT chunk_id, arg_min(content_tokenized, (indexed_at, md5(content_tokenized))) AS t FROM documents_book_chunk_fts WHERE chunk_id IS NOT NULL AND content_tokenized IS NOT NULL GROUP BY 1))"""
_HIT = f"""n AS (SELECT count(*) AS big, avg(len(w)) AS al FROM doc),
hit AS (SELECT chunk_id, len(w) AS l, term, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM doc) WHERE term IN (SELECT {_FOLD.format(c='x')} FROM unnest([{_KEPT}]) u(x)) GROUP BY ALL),
idf AS (SELECT term, count(*) AS n FROM hit GROUP BY 1),
ft AS (SELECT chunk_id, round(sum(tf * log10(big / n.n) * log10(big / n.n)), 6) AS score FROM hit JOIN idf n USING (term), n AS m GROUP BY 1)"""
_VEC = """good AS (SELECT chunk_id, indexed_at, embedding FROM documents_book_chunk_vec WHERE chunk_id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT embedding AS qv FROM good ORDER BY chunk_id, indexed_at, embedding LIMIT 1),
dist AS (SELECT chunk_id, arg_min(d, (indexed_at, d)) AS distance FROM (
  SELECT chunk_id, indexed_at, round(list_cosine_distance(list_transform(embedding, lambda x: x::DOUBLE), list_transform(qv, lambda x: x::DOUBLE)), 6) AS d FROM good, q) GROUP BY 1)"""
_SCOPE = f"""scope AS (SELECT chunk_id FROM chunk JOIN book USING (guid) WHERE list_contains(list_transform(string_split(book.r.e, ','), lambda x: trim(x)), '{TAG}'))"""
_FUSED = f"""f AS (SELECT * FROM ft ORDER BY score DESC, chunk_id LIMIT {3 * K}), v AS (SELECT * FROM dist ORDER BY distance, chunk_id LIMIT {3 * K}),
fused AS (SELECT chunk_id, round(CASE WHEN f.score IS NOT NULL AND distance IS NOT NULL THEN 0.6 * f.score + 0.4 * greatest(0, 1 - distance)
    WHEN f.score IS NOT NULL THEN f.score ELSE 0.4 * greatest(0, 1 - distance) END, 4) AS score,
  round(coalesce(f.score, 0), 4) AS score_ft, round(CASE WHEN distance IS NULL THEN 0 ELSE greatest(0, 1 - distance) END, 4) AS score_vec,
  CASE WHEN f.score IS NOT NULL AND distance IS NOT NULL THEN 'both' WHEN f.score IS NOT NULL THEN 'fulltext' ELSE 'vector' END AS source
  FROM f FULL JOIN v USING (chunk_id))"""
_ROLL = """hits AS (SELECT fused.*, guid, chunk.content, book.r.c AS title FROM fused JOIN chunk USING (chunk_id) JOIN book USING (guid)),
roll AS (SELECT guid, round(max(score) + least(0.05 * (count(*) - 1), 0.2), 4) AS book_score, count(*) AS book_hit_count FROM hits GROUP BY 1)"""
_CARD = f"""one AS (SELECT chunk_id, arg_min(embedding, (indexed_at, embedding)) AS e FROM good GROUP BY 1),
part AS (SELECT guid, length(content) AS w, unnest(e)::DOUBLE AS x, generate_subscripts(e, 1) AS i FROM one JOIN chunk USING (chunk_id) JOIN book USING (guid) WHERE length(content) > 0),
m AS (SELECT guid, i, sum(w * x) / sum(w) AS x FROM part GROUP BY 1, 2),
card AS (SELECT guid, list(x ORDER BY i) AS e FROM m GROUP BY 1),
bd AS (SELECT guid, round(list_cosine_distance(e, list_transform(qv, lambda x: x::DOUBLE)), 5) AS distance FROM card, q)"""
_HAN_ = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"


def _whole(name: str, category: str) -> str:
    """The ranking of one kind of whole documents as a CTE `name` of (guid, score)."""
    words = f"""list_filter(flatten(list_transform(regexp_extract_all(text, '[{_HAN_}]+|[^{_HAN_}]+'), lambda s: CASE WHEN regexp_matches(s, '^[{_HAN_}]')
      THEN list_concat(list_transform(range(1, length(s) + 1), lambda i: substr(s, i, 1)), list_transform(range(1, length(s)), lambda i: substr(s, i, 2)))
      ELSE regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+') END)), lambda x: x <> '')"""
    return f"""{name}_d AS (SELECT doc_id::VARCHAR AS guid, list_transform({words}, lambda x: {_FOLD.format(c='x')}) AS w FROM documents WHERE text IS NOT NULL AND category = '{category}'),
{name}_h AS (SELECT guid, term, count(*) AS tf FROM (SELECT guid, unnest(w) AS term FROM {name}_d) WHERE term IN (SELECT {_FOLD.format(c='x')} FROM unnest([{_KEPT}]) u(x)) GROUP BY ALL),
{name}_i AS (SELECT term, count(*) AS n FROM {name}_h GROUP BY 1),
{name}_s AS (SELECT guid, round(sum(tf * log10(b.n / i.n) * log10(b.n / i.n)), 6) AS score FROM {name}_h JOIN {name}_i i USING (term), (SELECT count(*) AS n FROM {name}_d) b GROUP BY 1),
{name} AS (SELECT '{category}' AS category, guid, round(score, 4) AS score, 'fulltext' AS source FROM (FROM {name}_s ORDER BY score DESC, guid LIMIT {2 * K}))"""


SQL = {
    "search_chat": f"WITH {_whole('chats', 'chat')} FROM chats ORDER BY score DESC, guid LIMIT {K}",
    "search_note": f"""WITH {_whole('notes', 'onenote')} SELECT notes.*, substr(trim(regexp_replace(text, '[\\s\\x{{0B}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')), 1, 200) AS snippet, d.source AS bucket
      FROM notes JOIN documents d ON d.doc_id::VARCHAR = guid ORDER BY score DESC, guid LIMIT {K}""",
    "search_all": f"""WITH {_BOOK}, {_CHUNK}, {_DOC}, {_HIT}, f AS (SELECT * FROM ft ORDER BY score DESC, chunk_id LIMIT {3 * K}), fused AS (SELECT chunk_id, round(score, 4) AS score FROM f), {_ROLL},
      capped AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY score DESC, chunk_id) AS rn FROM hits), {_whole('chats', 'chat')}, {_whole('notes', 'onenote')}
      SELECT 'book' AS category, guid, score, 'fulltext' AS source, chunk_id FROM capped WHERE rn <= 3 UNION ALL SELECT *, NULL FROM chats UNION ALL SELECT *, NULL FROM notes
      ORDER BY score DESC, chunk_id NULLS FIRST, guid LIMIT {K}""",
    "rerank_rollup": f"""WITH {_BOOK}, {_CHUNK}, {_DOC}, {_HIT}, f AS (SELECT * FROM ft ORDER BY score DESC, chunk_id LIMIT {3 * K}), fused AS (SELECT chunk_id, round(score, 4) AS score FROM f), {_ROLL},
      six AS (SELECT *, round(length(substr(content, 1, 800)) / 1000, 6) AS score_rerank FROM (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY score DESC, chunk_id) AS n FROM hits) WHERE n <= 6),
      books AS (SELECT guid, round(max(score_rerank) + least(0.05 * (max(k) - 1), 0.2), 4) AS book_score, max(k) AS book_hit_count FROM six JOIN (SELECT guid, count(*) AS k FROM hits GROUP BY 1) USING (guid) GROUP BY 1),
      capped AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY score_rerank DESC, chunk_id) AS rn FROM six)
      SELECT chunk_id, guid, score, score_rerank, book_score, book_hit_count FROM capped JOIN books USING (guid) WHERE rn <= 3 ORDER BY score_rerank DESC, chunk_id LIMIT {K}""",
    "fts_topk": f"WITH {_DOC}, {_HIT} SELECT * FROM ft ORDER BY score DESC, chunk_id LIMIT {K}",
    "fts_topk_index": f"WITH {_DOC}, {_HIT} SELECT * FROM ft ORDER BY score DESC, chunk_id LIMIT {K}",
    "fts_topk_bm25": f"""WITH {_DOC}, {_HIT} SELECT chunk_id, round(sum(ln(1 + (big - n.n + 0.5) / (n.n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / al))), 5) AS score
      FROM hit JOIN idf n USING (term), n AS m GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT {K}""",
    "fts_topk_tag": f"WITH {_BOOK}, {_CHUNK}, {_DOC}, {_HIT}, {_SCOPE} SELECT * FROM ft WHERE chunk_id IN (FROM scope) ORDER BY score DESC, chunk_id LIMIT {K}",
    "vector_topk": f"WITH {_VEC} SELECT * FROM dist ORDER BY distance, chunk_id LIMIT {K}",
    "vector_topk_tag": f"WITH {_BOOK}, {_CHUNK}, {_VEC}, {_SCOPE} SELECT * FROM dist WHERE chunk_id IN (FROM scope) ORDER BY distance, chunk_id LIMIT {K}",
    "hybrid_fused": f"WITH {_DOC}, {_HIT}, {_VEC}, {_FUSED} SELECT * FROM fused",
    "hybrid_book_rollup": f"WITH {_BOOK}, {_CHUNK}, {_DOC}, {_HIT}, {_VEC}, {_FUSED}, {_ROLL} SELECT * FROM roll",
    "hybrid_search": f"""WITH {_BOOK}, {_CHUNK}, {_DOC}, {_HIT}, {_VEC}, {_FUSED}, {_ROLL},
      capped AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY score DESC, chunk_id) AS rn FROM hits)
      SELECT chunk_id, guid, title, score, score_ft, score_vec, source, book_score, book_hit_count, length(content) AS content_chars
      FROM capped JOIN roll USING (guid) WHERE rn <= 3 ORDER BY score DESC, chunk_id LIMIT {K}""",
    "engine_search": f"""WITH {_BOOK}, {_CHUNK}, {_DOC}, {_HIT}, f AS (SELECT * FROM ft ORDER BY score DESC, chunk_id LIMIT {3 * K}), fused AS (SELECT chunk_id, round(score, 4) AS score FROM f), {_ROLL},
      capped AS (SELECT *, row_number() OVER (PARTITION BY guid ORDER BY score DESC, chunk_id) AS rn FROM hits)
      SELECT chunk_id, guid, score, 'fulltext' AS source, book_score, 'vector: no embedder; rerank: no model' AS degraded FROM capped JOIN roll USING (guid) WHERE rn <= 3 ORDER BY score DESC, chunk_id LIMIT {K}""",
    "salvage_like": f"""SELECT chunk_id FROM documents_book_chunk WHERE chunk_id IS NOT NULL AND (contains(content, 'monastery') OR contains(content, '火山'))
      GROUP BY 1 ORDER BY min(strlen(content)), chunk_id LIMIT {K}""",
    "find_books_ranked": f"WITH {_BOOK}, {_CHUNK}, {_VEC}, {_CARD} SELECT * FROM bd ORDER BY distance, guid LIMIT {K}",
    "find_books_signal": f"""WITH {_BOOK}, {_CHUNK}, {_VEC}, {_CARD}, s AS (SELECT count(*) AS n, min(distance) AS d0, avg(distance) AS m, stddev_pop(distance) AS sd FROM bd),
      t AS (SELECT max(distance) AS d5 FROM (SELECT distance FROM bd ORDER BY distance LIMIT 5))
      SELECT n AS corpus_books, round(d0, 4) AS top1_distance, round(d5 - d0, 4) AS gap, round(CASE WHEN n > 1 AND sd > 0 THEN (m - d0) / sd ELSE 0 END, 2) AS z FROM s, t""",
    "read_chunk_window": f"WITH {_BOOK}, {_CHUNK} SELECT guid, chunk_seq, chunk_id, book.r.c AS title, length(content) AS n_chars FROM chunk JOIN book USING (guid) WHERE chunk_seq BETWEEN 4 AND 6",
    "list_books": f"""WITH {_BOOK}, {_CHUNK}, n AS (SELECT guid, count(*) AS chunks FROM chunk GROUP BY 1)
      SELECT guid, r.c AS title, r.d AS bucket, r.e AS tags, coalesce(chunks, 0) AS chunks, r.a AS book_created_at FROM book LEFT JOIN n USING (guid) ORDER BY r.a DESC, guid LIMIT 50""",
}
