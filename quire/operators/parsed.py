"""Products of a document parser: block types, boxes, footnotes, inline content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of block types that mean the same.
ALIASES = {"paragraph_title": "title", "doc_title": "title", "image_body": "image", "table_body": "table", "chart_body": "chart", "code_body": "code",
           "equation": "equation_interline", "interline_equation": "equation_interline"}
FOOTNOTES = ["page_footnote", "footnote"]
FURNITURE = ["header", "footer", "page_number"]
VISUAL = ["image", "table", "chart", "equation_interline"]
KNOWN = ["image", "table", "chart", "equation_interline", "image_caption", "image_footnote", "table_caption", "table_footnote", "chart_caption", "chart_footnote",
         "code_caption", "code_footnote", "code", "text", "title", "list", "index", "caption", "phonetic", "ref_text", "aside_text", *FURNITURE, *FOOTNOTES]
FOOTNOTE_FROM, JUDGE = 0.70, "v2"


def canonical_type(c: Column) -> Column:
    pairs = [x for kv in ALIASES.items() for x in map(F.lit, kv)]
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), t), t)


def box01(box: Column, unit: str, page: Column | None = None) -> Column:
    """Boxes as shares of the page: from points (with the page's size), thousandths, or as they are; else null."""
    if unit == "points":
        ok = (F.size(page) >= 2) & (F.get(page, 0) > 0) & (F.get(page, 1) > 0)
        scaled = F.transform(box, lambda x, i: x.cast("double") / F.get(page, (i % 2).cast("int")))
    elif unit == "thousandths":
        ok, scaled = F.lit(True), F.transform(box, lambda x: x.cast("double") / 1000)
    elif unit == "share":
        ok, scaled = F.lit(True), F.transform(box, lambda x: x.cast("double"))
    else:
        return F.lit(None).cast("array<double>")
    return F.when((F.size(box) == 4) & ok, scaled)


def is_noise(text: Column) -> Column:
    t = F.trim(text)
    return (F.length(t) < 3) | t.rlike(r"^[\s·]*\d+[\s·]*$") | t.rlike(r"^\(\d+(?:,\s*\d+)*\)$")


def is_footnote(kind: Column, top: Column, text: Column) -> Column:
    """By type first; only blocks of no telling type are judged by their place and text."""
    t = canonical_type(kind)
    return F.when(t.isin(FOOTNOTES), True).when(t.isin(FURNITURE), False).otherwise(F.coalesce((top >= FOOTNOTE_FROM) & ~is_noise(text), F.lit(False)))


def footnotes(blocks: DataFrame) -> DataFrame:
    """book_guid, page_idx, box, text: each place once, whatever copies there are."""
    f = blocks.where(is_footnote(F.col("block_type"), F.get("bbox01", 1), F.coalesce("text", F.lit("")))).withColumn("box", F.array_join(F.transform("bbox01", lambda x: F.round(x, 4).cast("string")), ","))
    return f.groupBy("book_guid", "page_idx", "box").agg(F.min("text").alias("text")).withColumn("judge_version", F.lit(JUDGE))


def append_footnotes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose place isn't stored yet."""
    return new.join(stored.select("book_guid", "page_idx", "box"), ["book_guid", "page_idx", "box"], "left_anti")


def type_census(blocks: DataFrame) -> DataFrame:
    """Blocks per canonical type, how many lack a box, and whether the type is known."""
    t = canonical_type(F.col("raw_type"))
    return blocks.groupBy(t.alias("canonical_type")).agg(
        F.count("*").alias("blocks"), F.count_if(F.col("bbox01").isNull()).alias("no_bbox")).withColumn("known", F.col("canonical_type").isin(KNOWN))


def product_form(files: DataFrame) -> DataFrame:
    """files: dir, name, head (first 256 KiB of a Markdown file). The form of each directory's parser product."""
    has = lambda p: F.max(F.col("name").rlike(p))
    g = files.groupBy("dir").agg(has(r"_middle\.json$").alias("v3"), has(r"\.zip$").alias("zip"), has(r"^middle_json\.json$").alias("v4"),
                                 F.max(F.col("name").rlike(r"\.md$") & F.coalesce(F.col("head").rlike(r"!\[[^\]]*\]\(data:image/"), F.lit(False))).alias("flat"))
    return g.select("dir", F.when(F.col("v3"), "dir").when(F.col("zip"), "zip").when(F.col("v4"), "full").when(F.col("flat"), "flat").alias("form"))


def skips_ocr(parse_mode: Column) -> Column:
    """Only a product known to be OCR'd needs none again; unknown stays on the safe side."""
    return F.coalesce(parse_mode == "ocr", F.lit(False))


def inline_text(content) -> str:
    """Inline content of any depth as text: equations between $ signs, bodies of visuals left out; an unknown node is an
    error, not silence."""
    if content is None:
        return ""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "".join(map(inline_text, content))
    if isinstance(content, dict):
        kind = content.get("type", "")
        if kind in ("image_body", "table_body", "chart_body", "code_body"):
            return ""
        inner = inline_text(content.get("content"))
        return f"${inner}$" if kind in ("equation", "inline_equation") and inner else inner
    raise TypeError(f"unknown inline node: {type(content).__name__}")


def image_types(entries: DataFrame) -> DataFrame:
    """book_guid, path, block type of images; visual types only."""
    t = canonical_type(F.col("entry_type"))
    return entries.where(F.col("content.image_source.path").isNotNull()).select("book_guid", F.col("content.image_source.path").alias("path"), t.alias("image_type")).where(
        F.col("image_type").isin(VISUAL)).distinct()
