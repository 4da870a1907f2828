"""Files as DataFrames: listing, decoding, archives, manifests, session logs."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

IMPORTABLE = r"\.(?:md|txt|zip|epub)$"
#: an archive that unpacks to more is refused
MOST_UNPACKED = 4 << 30
SKIPPED_MEMBERS = ("model_output.json",)
#: the member that is an archive's text
MARKER = "markdown.md"


def binary_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, dir, name, stem, modificationTime, length, content."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return r.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("dir"), name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), "modificationTime", "length", "content")


def importable(files: DataFrame) -> DataFrame:
    """Markdown, text and archives that aren't hidden; an archive supersedes the Markdown file of its name beside it."""
    hidden = F.col("path").rlike(r"/\.[^/]+")
    f = files.where(F.lower("name").rlike(IMPORTABLE) & ~hidden)
    zips = f.where(F.lower("name").rlike(r"\.zip$")).select("dir", "stem").distinct()
    md = F.lower(F.col("name")).rlike(r"\.md$")
    return f.where(md).join(zips, ["dir", "stem"], "left_anti").unionByName(f.where(~md), allowMissingColumns=True).select(*files.columns)


def notes(files: DataFrame) -> DataFrame:
    return files.where(F.lower("name").rlike(r"\.md$") & ~F.col("name").startswith("_"))


def chats(files: DataFrame) -> DataFrame:
    return files.where(F.lower("name").rlike(r"\.md$") & ~F.col("name").startswith("."))


def utf8(content: Column) -> Column:
    """Markdown is UTF-8; invalid bytes are replaced."""
    return F.make_valid_utf8(content.cast("string"))


def _decode(raw: bytes) -> str:
    """Byte-order mark, then strict UTF-8, then gb18030, at last UTF-8 with replacement."""
    for mark, enc in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(enc, "replace")
    for enc in ("utf-8", "gb18030"):
        try:
            return raw.decode(enc)
        except UnicodeDecodeError:
            pass
    return raw.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else _decode(bytes(b)))


class UnsafeArchive(ValueError):
    """A member would be written outside its archive's folder, or there is too much of it."""


def member_path(name: str) -> str:
    p = name.replace("\\", "/")
    while p.startswith("./"):
        p = p[2:]
    if p.startswith("/") or ":" in p or ".." in PurePosixPath(p).parts:
        raise UnsafeArchive(name)
    return p


def root_of(names: list[str], marker: str = MARKER) -> str | None:
    """'' or the one folder that wraps everything; None if the archive has no marker at either place."""
    if marker in names:
        return ""
    tops = {n.split("/", 1)[0] for n in names}
    top = next(iter(tops)) if len(tops) == 1 else ""
    return f"{top}/" if top and f"{top}/{marker}" in names else None


def archives(files: DataFrame) -> DataFrame:
    """path, archive_md5, member, bytes, problem: the parts of importable archives below their root, or one row that says why
    an archive has none. An unsafe archive fails as a whole; the md5 makes a rerun find what it already wrote."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                key = hashlib.md5(bytes(raw)).hexdigest()
                rows, problem = [], None
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        infos = [i for i in z.infolist() if not i.is_dir()]
                        names = {member_path(i.filename): i for i in infos}
                        if sum(i.file_size for i in infos) > MOST_UNPACKED:
                            raise UnsafeArchive(f"unpacks to more than {MOST_UNPACKED} bytes")
                        root = root_of(list(names))
                        if root is None:
                            problem = f"no {MARKER}"
                        else:
                            rows = [(path, key, n[len(root):], z.read(i), None) for n, i in names.items() if n.startswith(root) and n.rsplit("/", 1)[-1] not in SKIPPED_MEMBERS]
                except zipfile.BadZipFile as e:
                    problem = f"broken: {e}"
                except UnsafeArchive as e:
                    problem = f"unsafe: {e}"
                if problem:
                    rows = [(path, key, None, None, problem)]
                yield pd.DataFrame(rows, columns=["path", "archive_md5", "member", "bytes", "problem"])

    return files.where(F.lower("path").rlike(r"\.zip$")).select("path", "content").mapInPandas(run, "path string, archive_md5 string, member string, bytes binary, problem string")


def archive_members(files: DataFrame) -> DataFrame:
    """The parts of the archives that have some."""
    return archives(files).where("problem is null").drop("problem")


def refused(files: DataFrame) -> DataFrame:
    """path, problem of the archives that are not imported."""
    return archives(files).where("problem is not null").select("path", "problem")


def epub_text(files: DataFrame) -> DataFrame:
    """path, text: the documents of a book in EPUB form without their tags."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        def one(raw):
            try:
                z = zipfile.ZipFile(io.BytesIO(raw))
            except zipfile.BadZipFile:
                return None
            with z:
                parts = [z.read(n).decode("utf-8", "replace") for n in z.namelist() if re.search(r"\.x?html?$", n, re.I)]
            return "\n\n".join(html.unescape(re.sub(r"[ \t]+", " ", re.sub(r"<[^>]+>", " ", p))).strip() for p in parts)

        return content.map(one)

    return files.where(F.lower("path").rlike(r"\.epub$")).select("path", text("content").alias("text"))


def bare_structure(files: DataFrame) -> DataFrame:
    """JSON files that are a parser's structure, which alone are no document. The field is read by a streaming parser, so a
    file's size doesn't matter."""
    return files.where(F.lower("path").rlike(r"\.json$")).withColumn("schema", F.get_json_object(utf8(F.col("content")), "$.schema")).where(
        F.col("schema").isin("docvortex.middle", "docvortex.model")).select("path", "schema")


def text_of(content: Column) -> Column:
    """The text of a file in whatever encoding; only what isn't UTF-8 without a mark meets Python."""
    t = content.cast("string")
    plain = F.is_valid_utf8(t) & ~F.hex(F.substring(content, 1, 3)).rlike("^(?:EFBBBF|FFFE|FEFF)")
    return F.when(plain, t).otherwise(decoded(F.when(plain, None).otherwise(content)))


def manifest_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Annotation records, one object a line; lines that begin with # are comments."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    schema = "match struct<guid:string,content_md5:string,source_path:string,title:string>, errata map<string,int>, glossary map<string,string>, note string, source string"
    return lines.select(F.from_json("value", schema).alias("r"), F.col("value").alias("raw")).select("r.*", "raw")


def manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same from a table with one column per key; columns errata_* are counts."""
    t = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    t = t.toDF(*[c.lstrip("﻿") for c in t.columns])
    keys = [c for c in ("guid", "content_md5", "source_path", "title") if c in t.columns]
    counts = [c for c in t.columns if c.startswith("errata_")]
    pairs = [x for c in counts for x in (F.lit(c[7:]), F.col(c).cast("int"))]
    return t.select(F.struct(*keys).alias("match"), (F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,int>")).alias("errata"),
                    *[c for c in ("note", "source") if c in t.columns])


def session_calls(spark: SparkSession, path: str) -> DataFrame:
    """Tool calls of session logs: name, arguments, call id."""
    v = F.try_parse_json("value")
    return spark.read.text(path).select(F.try_variant_get(v, "$.type", "string").alias("type"), F.try_variant_get(v, "$.data.name", "string").alias("name"),
                                        F.coalesce(F.try_variant_get(v, "$.data.arguments", "string"), F.to_json(F.try_variant_get(v, "$.data.arguments", "variant"))).alias("arguments"),
                                        F.try_variant_get(v, "$.data.message.source.callId", "string").alias("call_id")).where("type in ('tool/call', 'tool/result')")


def image_suffix(content: Column) -> Column:
    """By the first bytes."""
    h = F.hex(F.substring(content, 1, 12))
    return (F.when(h.startswith("89504E47"), ".png").when(h.startswith("FFD8FF"), ".jpg").when(h.startswith("47494638"), ".gif")
            .when(h.startswith("52494646") & h.endswith("57454250"), ".webp").when(h.startswith("424D"), ".bmp").otherwise(".img"))


def inline_images(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(images: key, md5, bytes; documents with references in place of data URIs). A malformed payload leaves a visible mark."""
    pat = r"data:image/[a-zA-Z0-9.+-]+;base64,([A-Za-z0-9+/=\s]*)"
    one = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(pat), 1)).alias("b64")).distinct()
    raw = one.withColumn("bytes", F.try_to_binary(F.regexp_replace("b64", r"\s", ""), F.lit("base64")))
    images = raw.where("bytes is not null and length(bytes) > 0").select(key, F.md5("bytes").alias("md5"), "bytes")

    @F.pandas_udf("string")
    def rewritten(s: pd.Series) -> pd.Series:
        import base64
        import binascii
        import hashlib

        def ref(m: re.Match) -> str:
            try:
                b = base64.b64decode(re.sub(r"\s", "", m[1]), validate=True)
            except binascii.Error:
                b = b""
            return f"images/{hashlib.md5(b).hexdigest()}" if b else "image-unreadable"

        return s.map(lambda t: re.sub(pat, ref, t), na_action="ignore")

    # only texts that hold one meet Python
    has = F.coalesce(F.col(text).contains("data:image/"), F.lit(False))
    return images, docs.withColumn(text, F.when(has, rewritten(F.when(has, F.col(text)))).otherwise(F.col(text)))
