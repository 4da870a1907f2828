"""Tokens, Unicode and text quality over the chunks' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import (collapse_whitespace, display_width, fold_kangxi, front_matter, has_cjk, has_pua, image_refs, kangxi_count, pua_count, sanitize_pua, snippet,
                                  strip_tags, token_estimate, utf16_length, visible_len, without_front_matter)
from quire.functions.tokenizer import STOPWORDS, index_terms, index_text, is_stop_col, query_terms_col, segments
from quire.operators.errata import SIGNALS, errata, fired, note
from quire.queries.retrieval import _BOOK, _CHUNK, store, whole_chunks
from quire.session import table

def _c() -> Column:
    return F.col("content")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_chunks(spark, sf_dir).where("content is not null")


def index_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index would hold of each chunk."""
    return _chunks(spark, sf_dir).select("chunk_id", F.md5(index_text(_c())).alias("tokens_md5"), F.size(index_terms(_c())).alias("n_tokens"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that titles would ask for, kept and pruned."""
    t = store(spark, sf_dir)["book"].where("title is not null").select("guid", query_terms_col(F.col("title")).alias("terms"))
    return t.select("guid", F.array_join(F.filter("terms", lambda x: ~is_stop_col(x)), " ").alias("kept"), F.array_join(F.filter("terms", lambda x: is_stop_col(x)), " ").alias("pruned"))


def token_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that break a rule of segmentation; there are none."""
    terms = index_terms(_c())
    bad = (F.array_join(segments(_c()), "") != _c()) | (F.size(F.array_except(query_terms_col(_c()), terms)) > 0) | F.exists(
        terms, lambda t: t.rlike(r"[\x{4E00}-\x{9FFF}]") & t.rlike(r"[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"))
    return _chunks(spark, sf_dir).where((_c() != "") & bad).select("chunk_id")


def unicode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(
        "chunk_id", F.length(_c()).alias("points"), F.octet_length(_c()).alias("bytes"), visible_len(_c()).alias("visible"), kangxi_count(_c()).alias("kangxi"), pua_count(_c()).alias("pua"),
        has_cjk(_c()).alias("cjk"), has_pua(_c()).alias("pua_any"), F.md5(sanitize_pua(_c())).alias("sanitized_md5"), F.md5(fold_kangxi(_c())).alias("folded_md5"), token_estimate(_c()).alias("tokens_about"))


def widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir)["book"].where("title is not null").select("guid", display_width(F.col("title")).alias("columns"), utf16_length(F.col("title")).alias("utf16"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", snippet(_c()).alias("snippet"))


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = collapse_whitespace(_c())
    return _chunks(spark, sf_dir).select("chunk_id", F.md5(once).alias("collapsed_md5"), (collapse_whitespace(once) == once).alias("idempotent"))


def errata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", errata(_c()).alias("e")).select("chunk_id", "e.chars", "e.words", *[f"e.{s}" for s in SIGNALS])


def errata_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _chunks(spark, sf_dir).select("chunk_id", errata(_c()).alias("e"))
    return e.select(F.explode(fired(F.col("e"))).alias("signal")).groupBy("signal").agg(F.count("*").alias("chunks"))


def errata_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents_book").where("guid is not null").select("guid", note(F.col("errata_stats")).alias("note"))
    return b.distinct().groupBy("note").agg(F.count("*").alias("books"))


def tags_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).where(_c().contains("<")).select("chunk_id", F.md5(strip_tags(_c())).alias("text_md5"))


def images_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", F.array_join(image_refs(_c()), " ").alias("refs")).where("refs <> ''")


def note_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter of notes, and the text without it."""
    d = table(spark, sf_dir, "documents").where("text is not null and category = 'onenote'")
    m = front_matter(F.col("text"))
    return d.select("doc_id", F.to_json(m).alias("front_matter"), F.length(without_front_matter(F.col("text"))).alias("body_chars"))


def dup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


QUERIES = {f.__name__: f for f in (index_tokens, query_terms, token_invariants, unicode_metrics, widths, snippets, collapsed, errata_counts, errata_fired, errata_notes, tags_stripped,
                                   images_in_text, note_heads, dup_content)}
_C = f"WITH {_CHUNK}, c AS (SELECT chunk_id, content FROM chunk WHERE content IS NOT NULL)"
_SP = r"[\s\x{0B}\x{1c}-\x{1f}\x{85}\p{Z}]"
_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
_PUA = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}"
_N = lambda p: f"len(regexp_extract_all(content, '{p}'))"
_CYR, _LAT, _GRK = r"\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}", r"A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}", r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}"
_L = r"[\p{L}\p{Nl}\p{No}]"
_WIDE = r"\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}"
_STOPPED = "(list_contains([" + ", ".join(f"'{w}'" for w in sorted(STOPWORDS)) + "], lower(x)) OR regexp_matches(x, '^[" + "".join(sorted(w for w in STOPWORDS if w > "\u3400")) + "]{2,}$'))"
_SEGS = f"regexp_extract_all(content, '[{_HAN}]+|[^{_HAN}]+')"
SQL = {
    "index_tokens": _C + f""", t AS (SELECT chunk_id, flatten(list_transform({_SEGS}, lambda s: CASE WHEN regexp_matches(s, '^[{_HAN}]')
      THEN list_concat(list_transform(range(1, length(s) + 1), lambda i: substr(s, i, 1)), list_transform(range(1, length(s)), lambda i: substr(s, i, 2)))
      ELSE regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+') END)) AS t FROM c) SELECT chunk_id, md5(array_to_string(t, ' ')) AS tokens_md5, len(t) AS n_tokens FROM t""",
    "token_invariants": _C + " SELECT chunk_id FROM c WHERE false",
    "unicode_metrics": _C + f""" SELECT chunk_id, length(content) AS points, strlen(content) AS bytes, length(regexp_replace(content, '[\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]', '', 'g')) AS visible,
      {_N(r'[\x{2F00}-\x{2FD5}]')} AS kangxi, {_N(f'[{_PUA}]')} AS pua, regexp_matches(content, '[{_HAN}\\x{{3000}}-\\x{{303F}}\\x{{FF00}}-\\x{{FFEF}}]') AS cjk, regexp_matches(content, '[{_PUA}]') AS pua_any,
      md5(regexp_replace(content, '[{_PUA}]', chr(65533), 'g')) AS sanitized_md5, md5(translate(content, '{{SRC}}', '{{DST}}')) AS folded_md5,
      ({_N(f'[{_HAN}]')} + (length(content) - {_N(f'[{_HAN}]')}) // 3)::INT AS tokens_about FROM c""",
    "snippets": _C + f" SELECT chunk_id, substr(trim(regexp_replace(content, '{_SP}+', ' ', 'g')), 1, 200) AS snippet FROM c",
    "errata_counts": _C + f""", w AS (SELECT *, regexp_extract_all(content, '{_L}+') AS w, {_N(r'[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')} AS han FROM c)
      SELECT chunk_id, length(content) AS chars, len(w) AS words,
        len(list_filter(w, lambda x: regexp_matches(x, '[{_CYR}]')::INT + regexp_matches(x, '[{_LAT}]')::INT + regexp_matches(x, '[{_GRK}]')::INT > 1)) AS script_mix,
        len(list_filter(w, lambda x: regexp_matches(x, '[{_CYR}]') AND regexp_matches(x, '[áéóúýíōāē]'))) AS accented_latin,
        {_N(_L + r'-[ \t]*\n[ \t]*' + _L)} AS hyphen_break, {_N(r'[\x{2F00}-\x{2FD5}]')} AS kangxi_radical, {_N(f'[{_PUA}]')} AS pua,
        CASE WHEN han > 0.05 * (han + len(list_filter(regexp_extract_all(array_to_string(w, ''), '[{_CYR}{_LAT}{_GRK}]'), lambda x: true))) THEN 0
          ELSE {_N(r'[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]{2,}')} END AS cjk_halluc FROM w""",
    "tags_stripped": _C + f" SELECT chunk_id, md5(trim(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '{_SP}+', ' ', 'g'))) AS text_md5 FROM c WHERE contains(content, '<')",
    "images_in_text": _C + r""" SELECT chunk_id, refs FROM (SELECT chunk_id, array_to_string(list_concat(regexp_extract_all(content, '!\[[^\]]*\]\(([^)\s]+)', 1), regexp_extract_all(content, '<img[^>]+src=["'']([^"'']+)["'']', 1)), ' ') AS refs FROM c) WHERE refs <> ''""",
    "widths": f"""WITH {_BOOK} SELECT guid, (length(r.c) + len(regexp_extract_all(r.c, '[{_WIDE}]')))::INT AS columns, (length(r.c) + len(regexp_extract_all(r.c, '[\\x{{10000}}-\\x{{10FFFF}}]')))::INT AS utf16
      FROM book WHERE r.c IS NOT NULL""",
    "query_terms": f"""WITH {_BOOK}, t AS (SELECT guid, flatten(list_transform(regexp_extract_all(r.c, '[{_HAN}]+|[^{_HAN}]+'), lambda s: CASE WHEN NOT regexp_matches(s, '^[{_HAN}]') THEN regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+')
        WHEN length(s) = 1 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) END)) AS t FROM book WHERE r.c IS NOT NULL),
      u AS (SELECT guid, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM t)
      SELECT guid, array_to_string(list_filter(t, lambda x: NOT {_STOPPED}), ' ') AS kept, array_to_string(list_filter(t, lambda x: {_STOPPED}), ' ') AS pruned FROM u""",
    "errata_notes": f"""SELECT CASE WHEN json_extract_string(j, '$.criteria_version') IS NULL THEN 'not computed' WHEN n <> '' THEN n ELSE 'computed, no signal; other errors remain possible' END AS note, count(*) AS books
      FROM (SELECT DISTINCT guid, j, concat_ws(', ', {', '.join(f"CASE WHEN TRY_CAST(json_extract_string(j, '$.{x}') AS INT) > 0 THEN '{x}: ' || json_extract_string(j, '$.{x}') END" for x in SIGNALS)}) AS n
        FROM (SELECT guid, CASE WHEN json_valid(coalesce(errata_stats, '')) THEN errata_stats END AS j FROM documents_book WHERE guid IS NOT NULL)) GROUP BY 1""",
    "note_heads": r"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)', 1) AS head FROM documents WHERE text IS NOT NULL AND category = 'onenote'),
      p AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(string_split(head, chr(10)), lambda x: regexp_matches(x, '^[^:#\s][^:]*:')),
        lambda x: {'k': trim(split_part(x, ':', 1)), 'v': regexp_replace(trim(regexp_replace(x, '^[^:]*:', '')), '^["'']|["'']$', '', 'g')}))) AS kv FROM d)
      SELECT doc_id, '{' || array_to_string(list_transform(kv, lambda e: to_json(e.k)::VARCHAR || ':' || to_json(e.v)::VARCHAR), ',') || '}' AS front_matter,
        length(regexp_replace(text, '(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)', '')) AS body_chars FROM p""".replace("\\\\", "\\"),
    "dup_content": "SELECT md5(text) AS text_md5, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
}


def _fill() -> None:
    from quire.functions.text import kangxi_table

    src, dst = kangxi_table()
    SQL["unicode_metrics"] = SQL["unicode_metrics"].replace("{SRC}", src).replace("{DST}", dst)


_fill()
SQL["errata_fired"] = "WITH e AS (" + SQL["errata_counts"] + ") " + " UNION ALL ".join(f"SELECT '{x}' AS signal, count(*) AS chunks FROM e WHERE {x} > 0 HAVING count(*) > 0" for x in SIGNALS)

