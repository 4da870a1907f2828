"""Queries over side-car files whose shapes drift (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.drift import Shape, canonical_blocks, canonical_table, drift, fused_schema, shapes
from quire.session import spread, spread_table, table

INT, STR, BOOL = {"int"}, {"str"}, {"bool"}
INTS = {"list<int>", "list<>"}
DECIMALS = {"list<int>", "list<float>", "list<float,int>", "list<>"}
OBJECTS = {"list<obj>", "list<>"}

_LINE = Shape({"bbox": INTS, "spans": OBJECTS})
_BLOCK = {"type": STR, "bbox": INTS, "angle": INT, "index": INT}
_BLOCK_OPTIONAL = {"lines": OBJECTS, "blocks": OBJECTS, "merge_prev": BOOL, "level": INT}
V3 = Shape(
    {"pdf_info": OBJECTS, "_version_name": STR, "_backend": STR, "_effort": STR, "_ocr_enable": BOOL},
    sub={"pdf_info": Shape(
        {"page_idx": INT, "page_size": INTS, "preproc_blocks": OBJECTS, "discarded_blocks": OBJECTS},
        sub={"preproc_blocks": Shape(_BLOCK, _BLOCK_OPTIONAL, {"lines": _LINE}), "discarded_blocks": Shape(_BLOCK, _BLOCK_OPTIONAL)})},
)
V4 = Shape(
    {"schema": STR, "schema_version": STR, "is_full_document": BOOL, "metadata": {"obj"}, "extensions": {"obj"}, "pages": OBJECTS},
    sub={
        "metadata": Shape({"file_suffix": STR, "producer": {"obj"}, "document": {"obj"}}, sub={
            "producer": Shape({"name": STR, "version": STR}),
            "document": Shape({"title": STR, "languages": {"list<str>", "list<>"}, "page_count": INT})}),
        "extensions": Shape({"mineru": {"obj"}}, sub={"mineru": Shape({"tier": STR, "parse_mode": STR})}),
        "pages": Shape({"page_idx": INT, "blocks": OBJECTS}, sub={"blocks": Shape(
            {"type": STR, "index": INT, "bbox": DECIMALS, "content": {"str", "list<obj>", "list<str>", "list<obj,str>", "list<>"}}, {"level": INT})}),
    },
)
FILES = {"book_middle": V3, "middle_json": V4}
PAGES = {"book_middle": "pdf_info", "middle_json": "pages"}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, shape in FILES.items():
        got, _ = drift(spread_table(spark, sf_dir, name).select("file_id", "raw"), "file_id", "raw", shape)
        got = got.select(F.lit(name).alias("table_name"), "file_id", "field_path", "change_kind")
        out = got if out is None else out.unionByName(got)
    return out


def p1_fused_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path and field of either kind of file with its alternative types."""
    out = None
    for name in FILES:
        got = fused_schema(shapes(spread_table(spark, sf_dir, name), "file_id", "raw", depth=None)).select(F.lit(name).alias("table_name"), "*")
        out = got if out is None else out.unionByName(got)
    return out.withColumn("alternatives", F.to_json("alternatives"))


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table of page-level blocks of both kinds of file."""
    out = None
    for name, shape in FILES.items():
        df = table(spark, sf_dir, name)
        _, aliases = drift(spread(df.select("file_id", "raw")), "file_id", "raw", shape)
        got = canonical_blocks(df, shape, aliases, PAGES[name]).select(F.lit(name).alias("table_name"), "*")
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    _, aliases = drift(spread(df.select("file_id", "raw")), "file_id", "raw", FILES[name])
    return canonical_table(df, FILES[name], aliases, PAGES[name])


def p1_book_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table of one kind of file: its files, pages and page-level blocks."""
    return _table(spark, sf_dir, "book_middle")


def p1_middle_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the other kind."""
    return _table(spark, sf_dir, "middle_json")


QUERIES = {"p1_found": p1_found, "p1_blocks": p1_blocks, "p1_book_middle": p1_book_middle, "p1_middle_json": p1_middle_json, "p1_fused_schema": p1_fused_schema}
#: the new names that test files use for declared fields, by kind of file and object; the SQL below is told them
NEW_NAMES = {
    "book_middle": {
        "$": {"_producer": "_version_name", "version_name": "_version_name"},
        "$.pdf_info[]": {"abandoned_blocks": "discarded_blocks", "layout_blocks": "preproc_blocks", "page_dim": "page_size", "page_no": "page_idx"},
        "$.pdf_info[].preproc_blocks[]": {"bbox_pt": "bbox", "block_type": "type", "box": "bbox", "category": "type", "position": "bbox"},
        "$.pdf_info[].discarded_blocks[]": {"block_type": "type", "kind": "type"}},
    "middle_json": {
        "$": {"page_list": "pages"}, "$.pages[]": {"page_no": "page_idx"}, "$.metadata.document": {"name": "title"}, "$.extensions.mineru": {"mode_name": "parse_mode"},
        "$.pages[].blocks[]": {"block_type": "type", "box01": "bbox", "category": "type", "inline": "content", "label": "type", "order_no": "index", "seq": "index"}},
}


def _declared(name: str, shape: Shape, at: str = "$") -> list[str]:
    """(kind of file, object, field, required, accepted tags) as rows of SQL."""
    out = [f"('{name}', '{at}', '{m}', {str(m in shape.required).lower()}, {sorted(t)})" for m, t in shape.known.items()]
    for m, s in shape.sub.items():
        out += _declared(name, s, f"{at}.{m}" + ("[]" if any(t.startswith("list") for t in shape.known[m]) else ""))
    return out


_TAG = "CASE {t} WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'list' ELSE 'obj' END"
_NAMES = ", ".join(f"('{n}', '{at}', '{k}', '{m}')" for n, levels in NEW_NAMES.items() for at, d in levels.items() for k, m in d.items())
_PATHS = "replace(regexp_replace(replace(fullkey, chr(34), ''), '\\[\\d+\\]', '[]', 'g'), '$.page_list[]', '$.pages[]')"
SQL = {
    "p1_found": f"""WITH declared(f, lvl, field, required, tags) AS (VALUES {', '.join(x for n, s in FILES.items() for x in _declared(n, s))}),
new_names(f, lvl, name, field) AS (VALUES {_NAMES}),
copies AS (SELECT 'book_middle' AS f, file_id, raw, row_number() OVER () AS c FROM book_middle WHERE json_valid(raw) UNION ALL SELECT 'middle_json', file_id, raw, -row_number() OVER () FROM middle_json WHERE json_valid(raw)),
t AS (SELECT f, file_id, c, id, parent, key, type, replace(replace({_PATHS}, '.layout_blocks', '.preproc_blocks'), '.abandoned_blocks', '.discarded_blocks') AS lvl FROM copies, json_tree(raw)),
obj AS (SELECT f, file_id, c, id, lvl FROM t WHERE type = 'OBJECT' AND (f, lvl) IN (SELECT f, lvl FROM declared)),
kid AS (SELECT o.f, o.file_id, o.c, o.id AS oid, o.lvl, k.id, k.key, {_TAG.format(t='k.type')} AS tag FROM obj o JOIN t k ON k.c = o.c AND k.parent = o.id),
lists AS (SELECT k.c, k.id, 'list<' || string_agg(DISTINCT {_TAG.format(t='e.type')}, ',' ORDER BY {_TAG.format(t='e.type')}) || '>' AS tag FROM kid k JOIN t e ON e.c = k.c AND e.parent = k.id WHERE k.tag = 'list' GROUP BY ALL),
typed AS (SELECT kid.* EXCLUDE (tag), coalesce(lists.tag, CASE WHEN kid.tag = 'list' THEN 'list<>' ELSE kid.tag END) AS tag FROM kid LEFT JOIN lists USING (c, id)),
named AS (SELECT y.*, coalesce(d.field, CASE WHEN NOT EXISTS (SELECT 1 FROM kid z WHERE z.c = y.c AND z.oid = y.oid AND z.key = n.field) THEN n.field END) AS field
  FROM typed y LEFT JOIN declared d ON d.f = y.f AND d.lvl = y.lvl AND d.field = y.key LEFT JOIN new_names n ON n.f = y.f AND n.lvl = y.lvl AND n.name = y.key),
found AS (SELECT f, file_id, lvl, coalesce(field, key) AS field, CASE WHEN field IS NULL THEN 'added' END AS kind FROM named
  UNION ALL SELECT f, file_id, lvl, field, 'renamed' FROM named WHERE field <> key
  UNION ALL SELECT n.f, file_id, n.lvl, n.field, 'retyped' FROM named n JOIN declared d USING (f, lvl, field) WHERE NOT list_contains(d.tags, n.tag)
  UNION ALL SELECT o.f, file_id, o.lvl, d.field, 'missing' FROM obj o JOIN declared d USING (f, lvl) WHERE d.required AND NOT EXISTS (SELECT 1 FROM named n WHERE n.c = o.c AND n.oid = o.id AND n.field = d.field))
SELECT DISTINCT f AS table_name, file_id, substr(lvl || '.' || field, 3) AS field_path, kind AS change_kind FROM found WHERE kind IS NOT NULL""",
}
