"""A document store in a folder of Parquet tables, and what its users ask of it.

Tables: book, chunk, fts (as the import writes them), posting (the stored inverted index of fts), vec, footnote, cache, chat,
note. A table is a list of folders; each state of it is a numbered manifest, and the greatest number is the current one. A
change writes new folders first and then one manifest, by a rename that fails if that number is taken, so readers see a
state before or after it and never half of one, and of two writers the later tries again upon the other's state. Adding
rows writes these rows alone. Old folders stay for readers of old states until `vacuum`."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import tags as G
from quire.functions.tokenizer import STOPWORDS, index_text
from quire.functions.text import front_matter, path_key, snippet, without_front_matter
from quire.operators.chat import clean, rounds, summaries
from quire.operators.chunking import Chunker, book_card
from quire.operators.embedding import embed_texts
from quire.operators.errata import merge_stats, note, payload, read_stats, trust
from quire.operators.fulltext import postings, write_postings
from quire.operators.images import ocr, with_readings
from quire.operators.ledger import alive, deletion, match_manifest, missing_guids, orphan_images, tag_audit, tag_cloud, with_counts
from quire.plans.search import DEFAULT_MAX_PER_BOOK, Engine, SearchResult
from quire.sources.config import Config
from quire.sources.files import binary_files, chats, image_suffix, importable, inline_images, notes, utf8
from quire.streaming.ingest import books_of, import_books, pictures_of

SCHEMAS = {
    "book": "guid string, source_path string, title string, content string, errata_stats string, expected_chunks bigint, status string, bucket string, tags string, created_at timestamp",
    "chunk": "guid string, chunk_seq int, heading_path string, content string, char_start bigint, char_len int, visible_start bigint, visible_len int, byte_start bigint, byte_len int, "
             "grapheme_len int, has_pua boolean, chunk_id bigint",
    "fts": "chunk_id bigint, content_tokenized string, indexed_at timestamp",
    "posting": "term string, chunk_id bigint, tf bigint, len int, part int",
    "vec": "chunk_id bigint, embedding array<float>, indexed_at timestamp",
    "card": "guid string, card string, embedding array<float>, created_at timestamp",
    "image": "md5 string, suffix string, bytes binary, ocr_text string",
    "image_ref": "guid string, ref string, md5 string",
    "footnote": "book_guid string, page_idx int, box string, text string, judge_version string",
    "cache": "text_hash string, model string, embedding array<float>, expires_at timestamp",
    "chat": "guid string, source_path string, content string, summary string, bucket string, tags string, created_at timestamp, content_tokenized string, embedding array<float>",
    "note": "guid string, source_path string, content string, title string, bucket string, tags string, created_at timestamp, content_tokenized string",
}
#: folders of a table beyond which adding rows makes them one
MOST_PARTS = 64
ATTEMPTS = 20
#: missing books that an answer names one by one; it counts them all
NAMED = 1000


class Store:
    def __init__(self, spark: SparkSession, path: str, embed=None, rerank=None, dims: int = 64, config: Config | None = None, reader=None):
        """reader: the text of an image's bytes. config: `search.default_tags`, `search.stopwords` (a list) and `chunking.max_per_book` are read from it."""
        self.config, self.reader = config or Config({}), reader
        self.spark, self.path, self.embed, self.rerank, self.dims = spark, path.rstrip("/"), embed, rerank, dims
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(conf)

    # tables

    def _state(self, name: str) -> tuple[int, list[str]]:
        """(number, folders) of the current manifest; 0 before the first."""
        at = self._p(f"{self.path}/{name}/state")
        numbers = [int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()] if self._fs.exists(at) else []
        if not numbers:
            return 0, []
        n = max(numbers)
        file = self._fs.open(self._p(f"{self.path}/{name}/state/{n}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()
        return n, json.loads(text)

    def table(self, name: str) -> DataFrame:
        parts = self._state(name)[1]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        read = self.spark.read.schema(SCHEMAS[name])
        if name != "posting":
            return read.parquet(*[f"{self.path}/{name}/{p}" for p in parts])
        out = None
        for p in parts:
            one = read.option("basePath", f"{self.path}/{name}/{p}").parquet(f"{self.path}/{name}/{p}")
            out = one if out is None else out.unionByName(one)
        return out

    def _commit(self, name: str, before: int, parts: list[str]) -> bool:
        """False if another writer has made this state meanwhile."""
        new = self._p(f"{self.path}/{name}/state/.{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        to = self._p(f"{self.path}/{name}/state/{before + 1}")
        if not self._fs.exists(to) and self._fs.rename(new, to):
            return True
        self._fs.delete(new, False)
        return False

    def _write(self, name: str, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        if name == "posting":
            write_postings(rows, f"{self.path}/{name}/{part}")
        else:
            rows.write.parquet(f"{self.path}/{name}/{part}")
        return part

    def change(self, name: str, f) -> None:
        """The table becomes f(table), upon whatever state it has by then."""
        for _ in range(ATTEMPTS):
            n, _ = self._state(name)
            if self._commit(name, n, [self._write(name, f(self.table(name)))]):
                return
        raise RuntimeError(f"{name}: changed by others {ATTEMPTS} times over")

    def append(self, name: str, rows: DataFrame) -> None:
        """Writes these rows alone; many small folders become one now and then."""
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], SCHEMAS[name]).schema}
        part = self._write(name, rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]))
        for _ in range(ATTEMPTS):
            n, parts = self._state(name)
            if self._commit(name, n, [*parts, part]):
                if len(parts) >= MOST_PARTS:
                    self.change(name, lambda t: t)
                return
        raise RuntimeError(f"{name}: changed by others {ATTEMPTS} times over")

    def vacuum(self) -> int:
        """Deletes folders and manifests of old states, when nobody reads them any more; how many folders."""
        gone = 0
        for name in SCHEMAS:
            at = self._p(f"{self.path}/{name}")
            if not self._fs.exists(at):
                continue
            n, parts = self._state(name)
            for f in self._fs.listStatus(at):
                if f.getPath().getName() not in ("state", *parts):
                    self._fs.delete(f.getPath(), True)
                    gone += 1
            for f in self._fs.listStatus(self._p(f"{self.path}/{name}/state")):
                if f.getPath().getName() != str(n):
                    self._fs.delete(f.getPath(), False)
        return gone

    def reset(self) -> None:
        for name in SCHEMAS:
            self._fs.delete(self._p(f"{self.path}/{name}"), True)

    # imports

    def import_books(self, folder: str, bucket: str, tags: str = "", recursive: bool = True, force: bool = False, directory_tag: bool = True, chunker: Chunker | None = None) -> int:
        """Books that aren't stored whole yet; their chunks and index rows are stored before they are."""
        tags = G.for_write(tags)
        files = importable(binary_files(self.spark, folder, recursive))
        new = books_of(files)
        folder_tag = F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1) if directory_tag else F.lit("")
        own = F.array_join(F.array_distinct(F.concat(G.split_col(F.lit(tags)), F.filter(F.array(folder_tag), lambda x: (x != "") & ~x.contains(",")))), ",")
        if force:
            self.remove(new.select("guid"))
        else:
            whole = with_counts(self.table("book"), self.table("chunk")).where("status = 'done' and actual = expected_chunks").select("guid")
            new = new.join(whole, "guid", "left_anti")
        stage = f"{self.path}/stage/{uuid.uuid4().hex}"
        new = self._illustrated(new, files, stage)
        import_books(self.spark, new, stage, 0, chunker, force=True)
        read = lambda n: self.spark.read.parquet(f"{stage}/{n}").drop("batch")
        got = read("book").withColumn("bucket", F.lit(bucket)).withColumn("tags", own).withColumn("created_at", F.current_timestamp())
        n = got.count()
        self.append("chunk", read("chunk"))
        fts = read("fts").withColumn("indexed_at", F.current_timestamp())
        self.append("fts", fts)
        self.append("posting", postings(fts))
        if self.embed is not None:
            self.append("vec", self._vectors(read("chunk")))
            cards = got.select("guid", book_card(F.coalesce("title", F.lit("")), F.col("content")).alias("card"), "created_at")
            self.append("card", self._embedded(cards, "guid", "card"))
        self.append("book", got)
        self._fs.delete(self._p(stage), True)
        return n

    def _illustrated(self, new: DataFrame, files: DataFrame, stage: str) -> DataFrame:
        """The books, read once, with their images stored: those of archives and those that stand in the text itself, which
        become references. With a reader each distinct image that isn't stored yet is read once, and what it says stands below it."""
        new.write.parquet(f"{stage}/new")
        new = self.spark.read.parquet(f"{stage}/new")
        inside, new = inline_images(new, "guid", "content")
        inside = inside.select("guid", F.concat(F.lit("images/"), "md5").alias("ref"), "md5", image_suffix(F.col("bytes")).alias("suffix"), "bytes")
        pictures_of(files).join(new.select("guid"), "guid", "left_semi").unionByName(inside).write.parquet(f"{stage}/picture")
        found = self.spark.read.parquet(f"{stage}/picture")
        have = self.table("image").select("md5")
        fresh = found.select("md5", "suffix", "bytes").join(have, "md5", "left_anti").groupBy("md5").agg(F.min("suffix").alias("suffix"), F.min("bytes").alias("bytes"))
        texts = ocr(fresh.select("md5", "bytes"), self.reader)
        fresh.join(texts, "md5", "left").write.parquet(f"{stage}/image")
        if not found.isEmpty():
            self.append("image", self.spark.read.parquet(f"{stage}/image"))
            self.append("image_ref", found.select("guid", "ref", "md5").distinct())
        if self.reader is None:
            return new
        said = found.select("guid", "ref", "md5").distinct().join(self.table("image").select("md5", "ocr_text"), "md5")
        return with_readings(new, said, "guid", "content")

    def clean_images(self, dry_run: bool = True) -> int:
        """Images that no book refers to; they go unless it is a dry run."""
        lost = orphan_images(self.table("image"), self.table("image_ref")).select("md5")
        n = lost.count()
        if n and not dry_run:
            self.change("image", lambda now: now.join(self.table("image_ref").select("md5").distinct(), "md5", "left_semi").select(*now.columns))
        return n

    def _vectors(self, chunks: DataFrame, model: str = "default", days: int | None = None) -> DataFrame:
        """Cached vectors by the text's hash; only the rest is embedded, in batches and with the model's limit in mind."""
        embed = self.embed
        c = chunks.select("chunk_id", F.md5("content").alias("text_hash"))
        alive_ = self.table("cache").where((F.col("model") == model) & alive(F.col("expires_at"))).select("text_hash", "embedding")
        rest = chunks.select(F.md5("content").alias("text_hash"), "content").dropDuplicates(["text_hash"]).join(alive_.select("text_hash"), "text_hash", "left_anti")
        until = F.lit(None).cast("timestamp") if days is None else F.current_timestamp() + F.make_dt_interval(F.lit(days))
        made = embed_texts(rest, "text_hash", "content", lambda texts: [embed(t) for t in texts])
        self.append("cache", made.withColumn("model", F.lit(model)).withColumn("expires_at", until))
        every = self.table("cache").where((F.col("model") == model) & alive(F.col("expires_at"))).groupBy("text_hash").agg(F.min("embedding").alias("embedding"))
        return c.join(every, "text_hash").select("chunk_id", "embedding", F.current_timestamp().alias("indexed_at"))

    def _embedded(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        """The rows with the vector of their text, or null where there is no embedder."""
        if self.embed is None:
            return rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        embed = self.embed
        return rows.join(embed_texts(rows, key, text, lambda texts: [embed(t) for t in texts]), key, "left")

    def import_chats(self, folder: str, bucket: str = "chat", tags: str = "", cleaned: bool = True) -> int:
        f = chats(binary_files(self.spark, folder)).select(F.md5("path").alias("guid"), F.col("path").alias("source_path"), utf8(F.col("content")).alias("content"))
        f = f.join(self.table("chat").select("guid"), "guid", "left_anti")
        c = clean(f, "guid", "content")
        s = summaries(rounds(c, "guid"), f, "guid")
        body = f.drop("content").join(c.select("guid", F.col("cleaned").alias("content")), "guid") if cleaned else f
        rows = body.join(s, "guid").withColumn("bucket", F.lit(bucket)).withColumn("tags", F.lit(G.for_write(tags))).withColumn("created_at", F.current_timestamp())
        n = rows.count()
        self.append("chat", self._embedded(rows.withColumn("content_tokenized", index_text(F.col("content"))), "guid", "content"))
        return n

    def import_notes(self, folder: str, bucket: str = "note", tags: str = "", directory_tag: bool = True) -> int:
        f = notes(binary_files(self.spark, folder)).select(F.md5("path").alias("guid"), F.col("path").alias("source_path"), utf8(F.col("content")).alias("raw"))
        f = f.join(self.table("note").select("guid"), "guid", "left_anti")
        title = F.coalesce(F.try_element_at(front_matter(F.col("raw")), F.lit("title")), snippet(without_front_matter(F.col("raw")), 50))
        own = F.concat_ws(",", *([F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1)] if directory_tag else []), F.lit(G.for_write(tags)))
        rows = f.select("guid", "source_path", without_front_matter(F.col("raw")).alias("content"), title.alias("title"), F.lit(bucket).alias("bucket"),
                        F.regexp_replace(own, ",+$", "").alias("tags"), F.current_timestamp().alias("created_at"))
        n = rows.count()
        self.append("note", rows.withColumn("content_tokenized", index_text(F.col("content"))))
        return n

    # questions

    def engine(self) -> Engine:
        t = {n: self.table(n) for n in ("book", "chunk", "fts", "posting", "vec", "chat", "note")}
        t["book"] = t["book"].drop("content")
        # ids first, texts of the hits last
        t["text"] = t["chunk"].select("chunk_id", F.lit(0).alias("first"), "content")
        t["chunk"] = t["chunk"].drop("content")
        words = self.config.get("search.stopwords")
        e = Engine(self.spark, t, self.embed, self.rerank, int(self.config.get("chunking.max_per_book", DEFAULT_MAX_PER_BOOK)), self.dims, STOPWORDS if words is None else frozenset(words))
        e.set_default_tags(self.config.get("search.default_tags", "") or "")
        return e

    def search(self, query: str, **kw) -> SearchResult:
        return self.engine().search(query, **kw)

    def find_books(self, query: str, bucket: str | None = None, tags: str | None = None, limit: int = 10) -> dict:
        """Books whose title and table of contents are nearest to the query, and a signal of how near; never a verdict whether
        the store has what is asked for."""
        if self.embed is None:
            return {"error": "no embedder"}
        b = self.table("book").drop("content")
        wanted = G.for_query(tags)
        b = b if bucket is None else b.where(F.col("bucket") == bucket)
        b = b.where(G.any_tag(F.col("tags"), wanted)) if wanted else b
        cards = self.table("card").where("embedding is not null").join(b.select("guid"), "guid", "left_semi")
        near, signal = self.engine().find_books(self.embed(query), cards, limit)
        shown = near.join(with_counts(b, self.table("chunk")).select("guid", "title", "bucket", "tags", F.col("actual").alias("chunks")), "guid")
        return {"query": query, "books": shown.select("guid", "title", "bucket", "tags", "chunks", F.round(1 - F.col("distance"), 4).alias("score")).orderBy(F.col("score").desc(), "guid"), "signal": signal}

    def sql(self, query: str, args: dict | list | None = None) -> DataFrame:
        """Any query over the store's tables, with its parameters apart from its text."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(query, args)

    def list_buckets(self) -> DataFrame:
        out = None
        for n in ("book", "chat", "note"):
            one = self.table(n).groupBy("bucket").agg(F.count("*").alias("documents")).withColumn("table", F.lit(n))
            out = one if out is None else out.unionByName(one)
        return out.orderBy(F.col("documents").desc(), "table", "bucket")

    def list_tags(self, bucket: str | None = None) -> DataFrame:
        out = None
        for n in ("book", "chat", "note"):
            one = self.table(n).select("bucket", "tags")
            out = one if out is None else out.unionByName(one)
        if bucket is not None:
            out = out.where(F.col("bucket") == bucket)
        return tag_cloud(out).orderBy(F.col("n").desc(), "tag")

    def list_books(self, bucket: str | None = None, tags: str | None = None, limit: int = 50, match: str = "any") -> DataFrame:
        """Newest first; any of the tags exactly, or with match='all_like' all of them loosely."""
        b = with_counts(self.table("book"), self.table("chunk"))
        if bucket is not None:
            b = b.where(F.col("bucket") == bucket)
        asked = G.for_query(tags)
        if asked:
            b = b.where(G.all_like(F.coalesce("tags", F.lit("")), asked) if match == "all_like" else G.any_tag(F.col("tags"), asked))
        return b.select("guid", "title", "bucket", "tags", F.col("actual").alias("chunks"), "created_at").orderBy(F.col("created_at").desc(), "guid").limit(min(max(limit, 1), 200))

    def read_chunk(self, guid: str, seq: int, context: int = 1) -> dict:
        """A chunk with up to 5 neighbours on either side, in the book's own characters, with what is known of its text."""
        k = min(max(context, 0), 5)
        b = self.table("book").where(F.lower("guid") == guid.lower())
        c = self.table("chunk").where((F.lower("guid") == guid.lower()) & F.col("chunk_seq").between(max(1, seq - k), seq + k))
        raw = F.when(F.col("has_pua"), F.expr("substring(whole, cast(char_start as int) + 1, char_len)")).otherwise(F.col("content"))
        j = c.join(b.select("guid", F.col("content").alias("whole"), "source_path", note(F.col("errata_stats")).alias("trust"), "errata_stats"), "guid")
        got = j.select("chunk_seq", "heading_path", raw.alias("text"), "source_path", "trust", "errata_stats").orderBy("chunk_seq").collect()
        if not any(r["chunk_seq"] == seq for r in got):
            return {"error": f"no chunk {seq} in {guid}"}
        return {"chunks": [{"chunk_seq": r["chunk_seq"], "heading_path": r["heading_path"], "text": r["text"]} for r in got], "book_path": got[0]["source_path"],
                "text_trust": got[0]["trust"], "text_errata": payload(stats := read_stats(got[0]["errata_stats"])), "text_note": trust(stats)}

    # changes

    def remove(self, guids: DataFrame, dry_run: bool = False) -> dict:
        """Books and all that belongs to them; the missing ones are named, all of them as a table."""
        lacking = missing_guids(guids, self.table("book"))
        names = ("book", "chunk", "fts", "posting", "vec", "card", "image_ref", "footnote")
        t = {n: self.table(n) for n in names}
        left = deletion(t, guids)
        removed = {n: t[n].count() - left[n].count() for n in names}
        out = {"missing": [r[0] for r in lacking.orderBy(lacking.columns[0]).limit(NAMED).collect()], "missing_count": lacking.count(), "removed": removed}
        if not dry_run:
            # each table is what is left of its own state by then; books go last, as they tell what belongs to them
            for n in ("fts", "posting", "vec", "chunk", "card", "image_ref", "footnote", "book"):
                if removed[n]:
                    self.change(n, lambda now, n=n: deletion(t | {n: now}, guids)[n])
        return out

    def under(self, folder: str) -> DataFrame:
        return self.table("book").where(path_key(F.col("source_path")).startswith(path_key(F.lit(folder)))).select("guid")

    def tag(self, guid: str, add: str = "", remove: str = "") -> list[str]:
        add_, remove_ = G.elements(G.for_write(add, reserved=G.reserved_words(self.spark) if add else frozenset())), G.elements(remove)
        t = F.col("tags")
        t = G.add_col(t, add_) if add_ else t
        t = G.remove_col(t, remove_) if remove_ else t
        if add_ or remove_:
            self.change("book", lambda now: now.withColumn("tags", F.when(F.lower("guid") == guid.lower(), t).otherwise(F.col("tags"))))
        r = self.table("book").where(F.lower("guid") == guid.lower()).select("tags").first()
        return G.elements(r[0]) if r else []

    def audit_tags(self, samples: int = 5) -> tuple[DataFrame, DataFrame]:
        return tag_audit(self.table("book"), G.reserved_words(self.spark), samples)

    def annotate(self, manifest: DataFrame, apply: bool = False, replace: bool = False) -> DataFrame:
        """The plan of an annotation manifest, and its application if asked, upon what is known or in place of it. manifest as
        the sources read it."""
        m = manifest.withColumn("row", F.monotonically_increasing_id().cast("string"))
        m = m.select("row", *[F.col(f"match.{k}").alias(k) for k in ("guid", "content_md5", "source_path", "title")], "errata", "glossary", "note", "source")
        b = self.table("book").withColumn("content_md5", F.md5("content"))
        plan = match_manifest(m.select("row", "guid", "content_md5", "source_path", "title"), b).join(m.select("row", "errata", "glossary", "note", "source"), "row")
        if apply:
            @F.pandas_udf("string")
            def merged(old: pd.Series, changes: pd.Series) -> pd.Series:
                def one(o, cs):
                    got = {} if replace else read_stats(o)
                    for c in cs:
                        got = merge_stats(got, json.loads(c["errata"] or "null"), c["source"] or "annotate:", c["note"], json.loads(c["glossary"] or "null"))
                    return json.dumps(got, ensure_ascii=False, sort_keys=True)

                return pd.Series([one(o, c) for o, c in zip(old, changes)], index=old.index)

            ch = plan.where("state = 'matched'").groupBy(F.col("matched_guid").alias("guid")).agg(
                F.array_sort(F.collect_list(F.struct("row", F.to_json("errata").alias("errata"), "source", "note", F.to_json("glossary").alias("glossary")))).alias("_c"))

            def annotated(now: DataFrame) -> DataFrame:
                # only books that are annotated meet Python
                new = now.select("guid", "errata_stats").join(ch, "guid").select("guid", merged("errata_stats", "_c").alias("_new"))
                return now.join(new, "guid", "left").withColumn("errata_stats", F.coalesce("_new", "errata_stats")).drop("_new")

            self.change("book", annotated)
        return plan.select("row", "matched_guid", "matched_by", "state")

    def clean_cache(self, everything: bool = False) -> int:
        c = self.table("cache")
        kept = c.limit(0) if everything else c.where(alive(F.col("expires_at")))
        n = c.count() - kept.count()
        if n:
            self.change("cache", lambda now: now.limit(0) if everything else now.where(alive(F.col("expires_at"))))
        return n
