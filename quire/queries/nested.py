"""Queries over nested side-car files (problem 5)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.drift import drift
from quire.operators.nested import flatten, typed
from quire.queries.drift import FILES
from quire.session import cut, spread, table

_BLANK = r"^[\p{IsWhite_Space}\x1c-\x1f]*$"


def _new_names(df: DataFrame, name: str) -> dict[str, dict[str, str]]:
    """The merged schema's new names of declared fields: what this file calls its page list, branches and contents."""
    return drift(spread(df.select("file_id", "raw")), "file_id", "raw", FILES[name])[1]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the child tables of the innermost levels; a node's path is made of the ordinals of its parents."""
    o = F.col("ordinals")
    line = F.concat_ws("/", F.slice(o, 2, F.size(o) - 3).cast("array<string>"), F.concat(F.lit("l"), F.element_at(o, -2)), F.concat(F.lit("s"), F.element_at(o, -1)))
    spans = level_rows(table(spark, sf_dir, "book_middle"), "book_middle", ["span"], fields="(?!)").select(F.lit("book_middle").alias("table_name"), "doc_key", o[0].alias("page_pos"), "branch", line.alias("node_path"))
    # a string of inline content stands in a block or in an element of its lists
    full = F.exists(F.map_entries("fields"), lambda e: F.col("tags")[e["key"]].eqNullSafe("str") & ~e["value"].rlike(_BLANK))
    texts = level_rows(table(spark, sf_dir, "middle_json"), "middle_json", ["block", "content"], fields="content").where(full).select(
        F.lit("middle_json").alias("table_name"), "doc_key", o[0].alias("page_pos"), F.lit("blocks").alias("branch"), F.concat_ws("/", F.slice(o, 2, F.size(o) - 1).cast("array<string>")).alias("node_path"))
    both = spans.unionByName(texts)
    return both.select("table_name", F.col("doc_key").cast("bigint").alias("file_id"), "page_pos", "branch", "node_path")


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements of all array levels of both kinds of file with their parents."""
    out = None
    for name in FILES:
        got = flatten(table(spark, sf_dir, name), "file_id", "raw", order="produced_at").select(
            F.lit(name).alias("table_name"), "doc_key", "level_path", "node_key", "parent_key", "ordinal", F.to_json("fields").alias("fields"))
        out = got if out is None else out.unionByName(got)
    return out


def _any(fields: list[str], *aliases: dict[str, str]) -> str:
    return "(?:" + "|".join(re.escape(x) for x in sorted({*fields, *(k for a in aliases for k, m in a.items() if m in fields)})) + ")"


def levels(name: str, names: dict[str, dict[str, str]]) -> tuple[dict[str, str], dict[str, str]]:
    """(patterns of the level paths of each child table; of each branch of a page), under all names that files use."""
    if name == "book_middle":
        page = rf"\$\.{_any(['pdf_info'], names.get('', {}))}\[\]"
        inner = [names.get(f"pdf_info[].{b}[]", {}) for b in BRANCHES]
        way = lambda b: rf"{page}\.{_any(b, names.get('pdf_info[]', {}))}\[\]"
        block = rf"{way(BRANCHES)}(?:\.{_any(['blocks'], *inner)}\[\])*"
        line = rf"{block}\.{_any(['lines'], *inner)}\[\]"
        span = rf"{line}\.{_any(['spans'], names.get('pdf_info[].preproc_blocks[].lines[]', {}))}\[\]"
        return {"file": r"\$", "page": page, "block": block, "line": line, "span": span}, {b: way([b]) for b in BRANCHES}
    page = rf"\$\.{_any(['pages'], names.get('', {}))}\[\]"
    block = rf"{page}\.{_any(['blocks'], names.get('pages[]', {}))}\[\]"
    content = rf"{block}(?:(?:\.{_any(['content'], names.get('pages[].blocks[]', {}))}(?:\.content)*)?\[\])+"
    return {"file": r"\$", "page": page, "block": block, "content": content}, {}


def level_rows(df: DataFrame, name: str, tables: list[str], fields: str | None = None) -> DataFrame:
    """The elements of some child tables of one kind of file, with their branch below a page; `rest` are the levels that are
    in no other table (boxes, unknown lists). `fields`: of what declared name, under all names that files use, scalars are kept."""
    names = _new_names(df, name)
    paths, branches = levels(name, names)
    want = "(?s:(?!(?:" + "|".join(paths.values()) + r")\Z).*)" if tables == ["rest"] else "|".join(paths[t] for t in tables)
    if fields == "content":
        # inline content nests as lists, objects and strings
        fields = rf"|{_any([fields], names.get('pages[].blocks[]', {}))}(?:\.content)*"
    branch = F.lit(None).cast("string")
    for b, p in branches.items():
        branch = F.when(F.col("level_path").rlike(f"^{p}"), F.lit(b)).otherwise(branch)
    return flatten(df, "file_id", "raw", fields=fields, levels=want, order="produced_at" if "produced_at" in df.columns else None).withColumn("branch", branch)


def level_table(df: DataFrame, name: str, level: str) -> DataFrame:
    """A typed child table of one kind of file with the path of each row's level and, below a page, its branch."""
    # the rows of the level are read twice: for the merged schema and for the table
    return typed(cut(level_rows(df, name, [level])), f"{name} {level}", "level_path", "branch")


def _level_query(name: str, level: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return level_table(table(spark, sf_dir, name), name, level)

    return run


def _levels_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """How many elements each array level of a kind of file has."""
        flat = flatten(table(spark, sf_dir, name), "file_id", "raw", fields="(?!)", order="produced_at")
        return flat.groupBy("level_path").agg(F.count("*").alias("elements"), F.count_distinct("doc_key").alias("files"))

    return run


BRANCHES = ["preproc_blocks", "discarded_blocks"]
QUERIES = {
    "p5_found": p5_found, "p5_nodes": p5_nodes, **{f"p5_{n}_levels": _levels_query(n) for n in FILES},
    # the typed child tables of all levels: blocks, lines and spans of both branches at any depth
    **{f"p5_{t}_table": _level_query("book_middle", t) for t in ("file", "page", "block", "line", "span", "rest")},
    **{f"p5_json_{t}_table": _level_query("middle_json", t) for t in ("file", "page", "block", "content", "rest")},
}
_TREE = """WITH t AS (SELECT 'book_middle' AS f, file_id, fullkey, type, atom FROM book_middle, json_tree(CASE WHEN json_valid(raw) THEN raw END)
  UNION ALL SELECT 'middle_json', file_id, fullkey, type, atom FROM middle_json, json_tree(CASE WHEN json_valid(raw) THEN raw END))"""
_INNER = "array_to_string(list_transform(regexp_extract_all(m.i, '\\d+'), lambda x: '/' || x), '')"
SQL = {
    # under the names that the test files use
    "p5_found": _TREE + rf""", s AS (SELECT DISTINCT f, file_id, regexp_extract(fullkey,
  '^\$\.pdf_info\[(\d+)\]\.(preproc_blocks|layout_blocks|discarded_blocks|abandoned_blocks)\[(\d+)\]((?:\.blocks\[\d+\])*)\.lines\[(\d+)\]\.spans\[(\d+)\]$', ['p', 'b', 'k', 'i', 'l', 's']) AS m FROM t WHERE f = 'book_middle'),
c AS (SELECT DISTINCT f, file_id, regexp_extract(fullkey, '^\$\.(?:pages|page_list)\[(\d+)\]\.blocks\[(\d+)\]((?:\.(?:content|inline)|\[\d+\])+)$', ['p', 'k', 'i']) AS m FROM t
  WHERE f = 'middle_json' AND type = 'VARCHAR' AND regexp_matches(json_extract_string(atom, '$'), '[^\s]'))
SELECT f AS table_name, file_id, m.p::INT AS page_pos, CASE WHEN m.b IN ('preproc_blocks', 'layout_blocks') THEN 'preproc_blocks' ELSE 'discarded_blocks' END AS branch,
  m.k || {_INNER} || '/l' || m.l || '/s' || m.s AS node_path FROM s WHERE m.p <> ''
UNION SELECT f, file_id, m.p::INT, 'blocks', m.k || {_INNER} FROM c WHERE m.p <> ''""",
    **{f"p5_{n}_levels": f"WITH t AS (SELECT DISTINCT file_id, fullkey FROM {n}, json_tree(CASE WHEN json_valid(raw) THEN raw END) WHERE fullkey = '$' OR ends_with(fullkey, ']')) "
       r"SELECT regexp_replace(replace(fullkey, chr(34), ''), '\[\d+\]', '[]', 'g') AS level_path, count(*) AS elements, count(DISTINCT file_id) AS files FROM t GROUP BY 1" for n in FILES},
}
