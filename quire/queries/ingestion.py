"""Chunking, chats, notes and parser products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import collapse_whitespace, visible_len
from quire.operators.chat import A, B, chat_format, clean, rounds, summaries, topic_switches
from quire.operators.chunking import Chunker, book_card, chunk_books
from quire.operators.parsed import FOOTNOTES, FURNITURE, KNOWN, ALIASES, append_footnotes, box01, footnotes, image_types, product_form, skips_ocr, type_census
from quire.session import spread_table, table


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents").where("text is not null and category = 'book'").select("doc_id", "source", collapse_whitespace(F.col("text")).alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of the book pages."""
    return chunk_books(_books(spark, sf_dir), "doc_id", "content")


def chunk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that break an invariant; there are none."""
    b = _books(spark, sf_dir)
    c = chunk_books(b, "doc_id", "content", Chunker(500, 700, 100, 80)).join(b.select("doc_id", F.length("content").alias("n"), F.col("content").alias("whole")), "doc_id")
    gap = c.groupBy("doc_id").agg(F.max("chunk_seq").alias("m"), F.count_distinct("chunk_seq").alias("k"), F.min("chunk_seq").alias("l")).where("m <> k or l <> 1").select("doc_id", F.lit(0).alias("chunk_seq"))
    bad = c.where((visible_len(F.col("content")) > 700) | (F.length("content") > 8192) | (F.col("char_start") < 0) | (F.col("char_start") + F.col("char_len") > F.col("n"))
                  | F.col("content").rlike(r"[\x{E000}-\x{F8FF}]") | ((F.col("char_len") == F.length("content")) & ~F.col("has_pua")
                                                                     & ~F.col("content").contains("\n\n") & (F.expr("substring(whole, cast(char_start as int) + 1, char_len)") != F.col("content"))))
    return gap.unionByName(bad.select("doc_id", "chunk_seq"))


def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(visible_len(F.col("content"))).alias("most_visible"), F.max(F.length("content")).alias("most_points"), F.count_if("has_pua").alias("pua_chunks"))


def book_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir).select("doc_id", book_card(F.coalesce("source", F.lit("?")), F.col("content")).alias("card"))


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents").where("text is not null and category = 'chat'").select("doc_id", "text")


def chat_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chats(spark, sf_dir).groupBy(chat_format(F.col("text")).alias("format")).agg(F.count("*").alias("chats"))


def chat_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds(clean(_chats(spark, sf_dir), "doc_id", "text"), "doc_id")


def chat_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_switches(chat_rounds(spark, sf_dir), "doc_id")


def chat_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(chat_rounds(spark, sf_dir), _chats(spark, sf_dir), "doc_id")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "normalized_block")


def footnotes_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footnotes(_blocks(spark, sf_dir).where("text is not null and bbox01 is not null")).drop("judge_version")


def footnotes_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnotes of later pages, appended to those of the first."""
    f = footnotes(_blocks(spark, sf_dir).where("text is not null and bbox01 is not null"))
    return append_footnotes(f.where("page_idx < 3"), f).groupBy("page_idx").agg(F.count("*").alias("footnotes"))


def block_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_census(_blocks(spark, sf_dir))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "book_content_list_v2").where("bbox is not null").select("entry_id", box01(F.col("bbox"), "thousandths").alias("b"))
    return e.select("entry_id", F.array_join(F.transform("b", lambda x: F.format_number(x, 3)), " ").alias("box01")).distinct()


def images_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_types(table(spark, sf_dir, "book_content_list_v2")).groupBy("image_type").agg(F.count("*").alias("images"))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form of each book's parser product, from the names of its side-car files."""
    f = table(spark, sf_dir, "book_middle").unionByName(table(spark, sf_dir, "middle_json")).select(
        "book_guid", F.col("book_guid").alias("dir"), F.regexp_extract("file_name", r"([^/]+)$", 1).alias("name"), F.lit(None).cast("string").alias("head"))
    return product_form(f.where("dir is not null")).groupBy("form").agg(F.count("*").alias("books"))


def ocr_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents_book").groupBy(skips_ocr(F.col("mineru_parse_mode")).alias("skip")).agg(F.count_distinct("guid").alias("books"))


QUERIES = {f.__name__: f for f in (chunks, chunk_violations, chunk_report, book_cards, chat_formats, chat_rounds, chat_switches, chat_summaries, footnotes_found, footnotes_new,
                                   block_census, boxes, images_by_type, forms, ocr_skipped)}
_CANON = "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in ALIASES.items()) + "}[trim(coalesce({c}, ''))], trim(coalesce({c}, '')))"
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_T = _CANON.replace("{c}", "block_type")
_FOOT = f"""f AS (SELECT book_guid, page_idx, array_to_string(list_transform(bbox01, lambda x: round(x, 4)::VARCHAR), ',') AS box, min(text) AS text FROM normalized_block
  WHERE text IS NOT NULL AND bbox01 IS NOT NULL AND ({_T} IN ({_IN(FOOTNOTES)}) OR ({_T} NOT IN ({_IN(FURNITURE)}) AND bbox01[2] >= 0.70
    AND NOT (length(trim(text)) < 3 OR regexp_matches(trim(text), '^[\\s·]*\\d+[\\s·]*$') OR regexp_matches(trim(text), '^\\(\\d+(?:,\\s*\\d+)*\\)$')))) GROUP BY ALL)"""
_HAS = {f + k: f"regexp_matches(text, '(?im){v}')" for f, d in (("A", A), ("B", B)) for k, v in d.items()}
SQL = {
    "chat_formats": f"""SELECT CASE WHEN {_HAS["Auser"]} AND {_HAS["Aassistant"]} THEN 'A' WHEN {_HAS["Buser"]} AND {_HAS["Bassistant"]} THEN 'B' WHEN {_HAS["Auser"]} OR {_HAS["Aassistant"]} THEN 'A'
      WHEN {_HAS["Buser"]} OR {_HAS["Bassistant"]} THEN 'B' ELSE 'unknown' END AS format, count(*) AS chats FROM documents WHERE text IS NOT NULL AND category = 'chat' GROUP BY 1""",
    "chunk_violations": "SELECT doc_id, 0 AS chunk_seq FROM documents WHERE false",
    "footnotes_found": f"WITH {_FOOT} FROM f",
    "footnotes_new": f"WITH {_FOOT} SELECT page_idx, count(*) AS footnotes FROM f WHERE page_idx >= 3 GROUP BY 1",
    "block_census": f"""SELECT {_CANON.replace('{c}', 'raw_type')} AS canonical_type, count(*) AS blocks, count(*) FILTER (bbox01 IS NULL) AS no_bbox,
      {_CANON.replace('{c}', 'raw_type')} IN ({_IN(KNOWN)}) AS known FROM normalized_block GROUP BY ALL""",
    "boxes": "SELECT DISTINCT entry_id, array_to_string(list_transform(bbox, lambda x: printf('%.3f', x / 1000)), ' ') AS box01 FROM book_content_list_v2 WHERE bbox IS NOT NULL",
    "images_by_type": f"""SELECT t AS image_type, count(*) AS images FROM (SELECT DISTINCT book_guid, content.image_source.path AS p, {_CANON.replace('{c}', 'entry_type')} AS t
      FROM book_content_list_v2 WHERE content.image_source.path IS NOT NULL) WHERE t IN ('image', 'table', 'chart', 'equation_interline') GROUP BY 1""",
    "forms": """SELECT CASE WHEN v3 THEN 'dir' WHEN v4 THEN 'full' END AS form, count(*) AS books FROM (SELECT book_guid, bool_or(regexp_matches(file_name, '_middle\\.json$')) AS v3,
      bool_or(regexp_matches(file_name, '(^|/)middle_json\\.json$')) AS v4 FROM (SELECT book_guid, file_name FROM book_middle UNION ALL SELECT book_guid, file_name FROM middle_json)
      WHERE book_guid IS NOT NULL GROUP BY 1) GROUP BY 1""",
    "ocr_skipped": "SELECT coalesce(mineru_parse_mode = 'ocr', false) AS skip, count(DISTINCT guid) AS books FROM documents_book GROUP BY 1",
}
