"""Audits and maintenance of the store: completeness, duplicates, orphans, reconciliation, deletion, annotation, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.tags import defect_col, split_col
from quire.functions.text import path_key


def with_counts(books: DataFrame, chunks: DataFrame) -> DataFrame:
    """Books with the number of their chunks."""
    n = chunks.groupBy("guid").agg(F.count("*").alias("actual"))
    return books.join(n, "guid", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))


def is_complete(status: Column, actual: Column, expected: Column) -> Column:
    return F.coalesce((status == "done") & (actual == expected), F.lit(False))


def mismatches(books: DataFrame, chunks: DataFrame) -> DataFrame:
    return with_counts(books, chunks).where("actual <> expected_chunks")


def duplicates(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Keys that several records have, with their number and the first and last of their labels."""
    one = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, label).distinct()
    return one.groupBy(key).agg(F.count("*").alias("n"), F.concat_ws(",", F.min(label), F.max(label)).alias("labels")).where("n > 1")


def untagged(books: DataFrame) -> DataFrame:
    return books.where(F.trim(F.coalesce("tags", F.lit(""))) == "")


def reconcile(files: DataFrame, books: DataFrame, file_path: str = "path", book_path: str = "source_path") -> DataFrame:
    """path, state: files without a book (missing) and books without a file (extra), by one spelling of paths."""
    f = files.select(path_key(F.col(file_path)).alias("path")).where("path is not null").distinct()
    b = books.select(path_key(F.col(book_path)).alias("path")).where("path is not null").distinct()
    return f.join(b, "path", "left_anti").withColumn("state", F.lit("missing")).unionByName(b.join(f, "path", "left_anti").withColumn("state", F.lit("extra")))


def tag_audit(books: DataFrame, reserved: frozenset[str], samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """(counts per defect, up to `samples` examples of each)."""
    raw = F.col("tags")
    e = books.select("guid", raw.alias("tags"), F.explode_outer(F.split(F.coalesce(raw, F.lit("")), ",")).alias("e"))
    why = F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "empty").when(F.trim("e") == "", "broken_csv").otherwise(defect_col(F.trim("e"), reserved))
    bad = e.select("guid", "tags", F.trim("e").alias("element"), why.alias("defect")).where("defect is not null").distinct()
    counts = bad.groupBy("defect").agg(F.count_distinct("guid").alias("books"))
    w = Window.partitionBy("defect").orderBy("guid", "element")
    return counts, bad.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= samples).drop("rn")


def tag_cloud(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(split_col(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def deletion(tables: dict[str, DataFrame], guids: DataFrame) -> dict[str, DataFrame]:
    """What is left of every table without the books of `guids` (one column guid); index rows go by their chunk, before
    the chunks do, and nothing relies on cascades."""
    gone = guids.select(F.lower("guid").alias("guid")).distinct()
    books = tables["book"]
    chunks = tables["chunk"]
    lost = chunks.join(gone, F.lower(chunks["guid"]) == gone["guid"], "left_semi").select("chunk_id")
    out = {n: tables[n].join(lost, "chunk_id", "left_anti") for n in ("fts", "posting", "vec") if n in tables}
    out["chunk"] = chunks.join(gone, F.lower(chunks["guid"]) == gone["guid"], "left_anti")
    for n in ("card", "image_ref"):
        if n in tables:
            out[n] = tables[n].join(gone, F.lower(tables[n]["guid"]) == gone["guid"], "left_anti")
    if "footnote" in tables:
        out["footnote"] = tables["footnote"].join(gone, F.lower(tables["footnote"]["book_guid"]) == gone["guid"], "left_anti")
    out["book"] = books.join(gone, F.lower(books["guid"]) == gone["guid"], "left_anti")
    return out


def missing_guids(asked: DataFrame, books: DataFrame) -> DataFrame:
    return asked.select(F.lower("guid").alias("guid")).distinct().join(books.select(F.lower("guid").alias("guid")), "guid", "left_anti")


#: keys by which a manifest names a book, the surest first
MATCH_KEYS = ("guid", "content_md5", "source_path", "title")


def match_manifest(manifest: DataFrame, books: DataFrame) -> DataFrame:
    """manifest row -> guid, matched_by, state. Keys are tried in order; one that fits no book passes on to the next, one
    that fits several is refused. manifest: row, guid, content_md5, source_path, title; books the same without row."""
    m, by, state = manifest, F.lit(None).cast("string"), F.lit(None).cast("string")
    hit, stop = F.lit(None).cast("string"), F.lit(False)
    for k in MATCH_KEYS:
        norm = {"guid": F.lower, "content_md5": F.lower, "source_path": path_key, "title": F.trim}[k]
        b = books.where(F.col(k).isNotNull()).select(norm(F.col(k)).alias(f"_{k}"), F.col("guid").alias("_g")).groupBy(f"_{k}").agg(
            F.count_distinct("_g").alias(f"_n_{k}"), F.min("_g").alias(f"_g_{k}"))
        m = m.withColumn(f"_{k}", norm(F.col(k))).join(b, f"_{k}", "left")
        found = ~stop & F.col(f"_n_{k}").isNotNull()
        hit = F.when(found & (F.col(f"_n_{k}") == 1), F.col(f"_g_{k}")).otherwise(hit)
        by = F.when(found, F.lit(k)).otherwise(by)
        state = F.when(found, F.when(F.col(f"_n_{k}") == 1, "matched").otherwise("refused")).otherwise(state)
        stop = stop | found
    return m.select("row", hit.alias("matched_guid"), by.alias("matched_by"), F.coalesce(state, F.lit("unmatched")).alias("state"))


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (text_hash, model): the one that expires last."""
    u = cache.unionByName(new)
    cols = [c for c in u.columns if c not in ("text_hash", "model")]
    best = F.max(F.struct(F.coalesce("expires_at", F.to_timestamp(F.lit("9999-12-31"))).alias("_e"), *cols)).alias("_r")
    return u.groupBy("text_hash", "model").agg(best).select("text_hash", "model", *[F.col(f"_r.{c}").alias(c) for c in cols])


def alive(expires: Column, now: Column | None = None) -> Column:
    return expires.isNull() | (expires > (now if now is not None else F.current_timestamp()))


def cache_misses(texts: DataFrame, cache: DataFrame, text_hash: Column, model: str) -> DataFrame:
    """Distinct hashes of texts that have no live vector of the model; texts stay where they are."""
    have = cache.where((F.col("model") == model) & alive(F.col("expires_at"))).select("text_hash")
    return texts.select(text_hash.alias("text_hash")).where("text_hash is not null").distinct().join(have, "text_hash", "left_anti")


def cache_stats(cache: DataFrame, now: Column) -> DataFrame:
    return cache.agg(F.count("*").alias("total"), F.count_if(~alive(F.col("expires_at"), now)).alias("expired"),
                     F.round(F.coalesce(F.sum(F.size("embedding") * 4), F.lit(0)) / 1048576, 1).alias("mb"))


def image_registry(refs: DataFrame) -> DataFrame:
    """md5, refs, ocr_text: counted from the references, so nothing has to be kept up to date."""
    return refs.groupBy("md5").agg(F.count("*").alias("refs"), F.min("ocr_text").alias("ocr_text"))


def orphan_images(images: DataFrame, refs: DataFrame) -> DataFrame:
    """Stored images that no document refers to."""
    return images.join(refs.select("md5").distinct(), "md5", "left_anti")


def orphan_footnotes(footnotes: DataFrame, books: DataFrame) -> DataFrame:
    """Footnotes of books that aren't stored."""
    b = books.select(F.lower("guid").alias("_g")).distinct()
    return footnotes.join(b, F.lower("book_guid") == F.col("_g"), "left_anti")
