"""Problem 3: visually identical text with different characters."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.glyphs import Forms
from quire.llm.visual import consistent, same_looking_pairs, variants
from quire.session import spread_table

FIELDS = {"documents_book_chunk": "content", "documents_book_chunk_fts": "content_tokenized"}


def _each(spark: SparkSession, sf_dir: str, op) -> DataFrame:
    out = None
    for name, field in FIELDS.items():
        got = op(spread_table(spark, sf_dir, name), field)
        got = got.select(F.lit(name).alias("table_name"), *got.columns)
        out = got if out is None else out.unionByName(got)
    return out


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda df, f: same_looking_pairs(df, "chunk_id", f))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each record that has a same-looking twin."""
    return _each(spark, sf_dir, lambda df, f: variants(df, "chunk_id", f).select("chunk_id", F.hex("form").alias("class_id")).distinct())


def p3_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's text in one consistent readable form."""
    return _each(spark, sf_dir, lambda df, f: consistent(df.select("chunk_id", f), f, "normal_text").select("chunk_id", "normal_text"))


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes, "p3_consistent": p3_consistent}


def _forms() -> str:
    """(character, its form) as rows of SQL, by the rule of `Forms`; characters that are their own form aren't listed."""
    rule = Forms()
    rows = []
    for o in (*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE1000)):
        got = rule[o]
        # what is a letter with an accent is put together again in the end
        if got != o and unicodedata.normalize("NFC", got or "") != chr(o):
            rows.append(f"({o}, '{(got or '').replace(chr(39), chr(39) * 2)}')")
    return ", ".join(rows)


SQL = {
    "p3_found": f"""WITH m(o, f) AS (VALUES {_forms()}),
t AS (SELECT DISTINCT 'documents_book_chunk' AS table_name, chunk_id, content AS t FROM documents_book_chunk UNION SELECT 'documents_book_chunk_fts', chunk_id, content_tokenized FROM documents_book_chunk_fts),
u AS (SELECT row_number() OVER () AS n, t FROM (SELECT DISTINCT t FROM t WHERE t IS NOT NULL)),
c AS (SELECT n, unnest(regexp_extract_all(nfc_normalize(t), '(?s).')) AS c, generate_subscripts(regexp_extract_all(nfc_normalize(t), '(?s).'), 1) AS i FROM u),
g AS (SELECT n, nfc_normalize(string_agg(coalesce(f, c), '' ORDER BY i)) AS form FROM c LEFT JOIN m ON m.o = ord(c.c) GROUP BY 1),
k AS (SELECT table_name, chunk_id, t, form FROM t JOIN u USING (t) JOIN g USING (n) WHERE chunk_id IS NOT NULL AND regexp_matches(form, '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{0b}}]'))
SELECT DISTINCT a.table_name, a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM k a JOIN k b USING (table_name, form) WHERE a.chunk_id < b.chunk_id AND a.t <> b.t""",
}
