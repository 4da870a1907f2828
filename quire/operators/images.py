"""Image references of parser products: where they point, which need OCR, and OCR text put below them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import image_refs

#: what follows an image in a product: the parser's own description
DETAILS = r"\n<details>\s*\n<summary>\w+</summary>\s*\n\n(?s:.*?)\n</details>"


def references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ref, hash: each reference once; the hash is the name without folder and extension."""
    r = docs.where(F.col(text).isNotNull()).select(key, F.explode(image_refs(F.col(text))).alias("ref"))
    return r.withColumn("hash", F.regexp_extract("ref", r"([^/\\]+?)(?:\.[A-Za-z0-9]+)?$", 1))


def resolve(refs: DataFrame, described: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """key, ref, path, how: by the product's own map (key, ref, path), else a file beside the document with the hash as its
    name (key, hash, path), else any file of that name, else as it was. One way's several answers: the first by name."""
    a = described.groupBy(key, "ref").agg(F.min("path").alias("_a"))
    b = files.groupBy(key, "hash").agg(F.min("path").alias("_b"))
    c = files.groupBy("hash").agg(F.min("path").alias("_c"))
    j = refs.join(a, [key, "ref"], "left").join(b, [key, "hash"], "left").join(c, "hash", "left")
    how = F.when(F.col("_a").isNotNull(), "described").when(F.col("_b").isNotNull(), "beside").when(F.col("_c").isNotNull(), "elsewhere").otherwise("kept")
    return j.select(key, "ref", F.coalesce("_a", "_b", "_c", "ref").alias("path"), how.alias("how"))


def remap(docs: DataFrame, resolved: DataFrame, key: str, text: str) -> DataFrame:
    """Documents with their references as resolved and without the parser's descriptions. A document has few references,
    so they are gathered per document."""
    m = resolved.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("ref", "path"))).alias("_m"))
    bare = F.regexp_replace(F.col(text), DETAILS, "")

    @F.pandas_udf("string")
    def put(t: pd.Series, maps: pd.Series) -> pd.Series:
        def one(x, pairs):
            if x is None or not pairs:
                return x
            for old, new in sorted(dict(pairs).items(), key=lambda p: -len(p[0])):
                x = x.replace(f"]({old}", f"]({new}").replace(f'"{old}"', f'"{new}"')
            return x

        return pd.Series([one(x, p) for x, p in zip(t, maps)], dtype=object)

    return docs.join(m, key, "left").withColumn(text, put(bare, F.col("_m"))).drop("_m")


def ocr(images: DataFrame, reader: Callable[[bytes], str] | None, types: DataFrame | None = None, skip: tuple[str, ...] = ("image", "chart", "equation_interline")) -> DataFrame:
    """md5, ocr_text of distinct images. Without a reader nothing is read and the stage is skipped as a whole; an image
    that can't be read has none and doesn't stop others. `types` (md5, image_type): images of skipped types aren't read."""
    d = images.groupBy("md5").agg(F.min("bytes").alias("bytes"))
    if types is not None:
        d = d.join(types.where(F.col("image_type").isin(list(skip))).select("md5").distinct(), "md5", "left_anti")
    if reader is None:
        return d.select("md5", F.lit(None).cast("string").alias("ocr_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for m, raw in zip(b["md5"], b["bytes"]):
                try:
                    out.append((m, reader(bytes(raw))))
                except Exception:  # one unreadable image doesn't stop a book
                    out.append((m, None))
            yield pd.DataFrame(out, columns=["md5", "ocr_text"])

    return d.mapInPandas(run, "md5 string, ocr_text string")


def best_reading(readings: DataFrame, least: float = 0.5) -> DataFrame:
    """image, language, text: the first language in order whose mean confidence reaches `least`. readings: image,
    language_order, language, line, text, confidence."""
    g = readings.groupBy("image", "language_order", "language").agg(
        F.avg("confidence").alias("confidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return g.where(F.col("confidence") >= least).groupBy("image").agg(F.min_by(F.struct("language", "text"), "language_order").alias("r")).select("image", "r.language", "r.text")


def with_ocr(text: str, readings: dict[str, str]) -> str:
    """A quoted line with the OCR text below the first line that has the reference."""
    left, out = {k: v for k, v in readings.items() if v and v.strip()}, []
    for line in text.split("\n"):
        out.append(line)
        for ref in [r for r in left if r in line]:
            out.append("> 📝 OCR: " + " ".join(left.pop(ref).split()))
    return "\n".join(out)


def with_readings(docs: DataFrame, readings: DataFrame, key: str, text: str) -> DataFrame:
    """Documents with the OCR text of their images (key, ref, ocr_text) below the references; a document has few references,
    so they are gathered per document, and those without any never meet Python."""
    full = readings.where("trim(ocr_text) <> ''").groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("ref", "ocr_text")))).alias("_m"))

    @F.pandas_udf("string")
    def put(t: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else with_ocr(x, dict(m)) for x, m in zip(t, maps)], index=t.index, dtype=object)

    new = docs.select(key, text).join(full, key).select(key, put(text, "_m").alias("_t"))
    return docs.join(new, key, "left").withColumn(text, F.coalesce("_t", text)).drop("_t")
