"""Incremental import of a folder: a file stream cut into chunks and index rows, published book by book.

A batch writes chunks and index rows first and the books' rows last, so a book is visible only when it is whole. Ids
derive from the path and the chunk's number and each batch has its own partition, so a batch that runs again after a
loss replaces what it wrote. Books that are stored already are skipped unless forced."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.text import collapse_whitespace, composed, windows_path
from quire.functions.tokenizer import index_text
from quire.operators.chunking import Chunker, chunk_books
from quire.operators.errata import errata
from quire.sources.files import MARKER, archive_members, epub_text, image_suffix, text_of

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def books_of(files: DataFrame) -> DataFrame:
    """guid, source_path, title, content, errata_stats of Markdown and text files in whatever encoding, of archives by their
    Markdown, and of EPUB files. What `refused` names isn't among them."""
    f = files.where(~F.col("path").rlike(r"/\.[^/]+$"))
    text = f.where(F.lower("path").rlike(r"\.(?:md|txt)$")).select("path", text_of(F.col("content")).alias("text"))
    packed = archive_members(f).where(F.col("member") == MARKER).select("path", text_of(F.col("bytes")).alias("text"))
    every = text.unionByName(packed).unionByName(epub_text(f).where("text is not null"))
    plain = F.regexp_replace("path", "^file:/*", "/")
    return every.select(F.md5(windows_path(plain)).alias("guid"), plain.alias("source_path"), composed(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).alias("title"),
                        collapse_whitespace(F.col("text")).alias("content")).withColumn("errata_stats", F.to_json(errata(F.col("content"))))


def pictures_of(files: DataFrame) -> DataFrame:
    """guid, ref, md5, suffix, bytes of the images in archives, by the name under which their book refers to them."""
    plain = F.regexp_replace("path", "^file:/*", "/")
    got = archive_members(files.where(~F.col("path").rlike(r"/\.[^/]+$"))).withColumn("suffix", image_suffix(F.col("bytes"))).where("suffix <> '.img'")
    return got.select(F.md5(windows_path(plain)).alias("guid"), F.col("member").alias("ref"), F.md5("bytes").alias("md5"), "suffix", "bytes")


def import_books(spark: SparkSession, books: DataFrame, out: str, batch: int | str, chunker: Chunker | None = None, force: bool = False) -> None:
    """Chunks, then index rows, then books."""
    if not force:
        try:
            # this batch's own rows don't count: it may be running again
            done = spark.read.parquet(f"{out}/book").where(F.col("batch") != str(batch)).select("guid")
            books = books.join(done, "guid", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
    put(chunk_books(books, "guid", "content", chunker), "chunk")
    chunks = spark.read.parquet(f"{out}/chunk/batch={batch}")
    put(chunks.select("chunk_id", index_text(F.col("content")).alias("content_tokenized")), "fts")
    n = chunks.groupBy("guid").agg(F.count("*").alias("expected_chunks"))
    put(books.join(n, "guid", "left").withColumn("expected_chunks", F.coalesce("expected_chunks", F.lit(0))).withColumn("status", F.lit("done")), "book")


def watch_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000, once: bool = False, chunker: Chunker | None = None) -> StreamingQuery:
    """Starts the import of what is and what comes into a folder."""
    s = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)

    def batch(files: DataFrame, n: int) -> None:
        import_books(spark, books_of(files), out, n, chunker)

    w = s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
