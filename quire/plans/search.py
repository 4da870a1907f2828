"""Hybrid retrieval: routes, fusion, roll-up per book, and an account of what was done."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.tags import any_tag, for_query
from quire.functions.text import snippet
from quire.functions.tokenizer import STOPWORDS, raw_terms, salvage_terms, split_terms
from quire.operators.fulltext import rank, rank_postings, substring_hits
from quire.operators.vectors import nearest

# Fixed values of the ranking.
WEIGHTS_CJK, WEIGHTS_OTHER = (0.2, 0.8), (0.6, 0.4)
BONUS, BONUS_HITS = 0.05, 4
SALVAGE_SCORE = 0.05
OVERFETCH, OVERFETCH_WHOLE = 3, 2
RERANK_PER_BOOK, RERANK_CHARS = 6, 800
#: categories of whole documents: (table, has vectors)
WHOLE = {"chat": ("chat", True), "onenote": ("note", False)}
SNIPPET_CHARS = 200
DEFAULT_MAX_PER_BOOK = 3


def weights(query: str) -> tuple[float, float]:
    """(full text, vector); Chinese queries lean on vectors."""
    cjk = any("\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or "\u3000" <= c <= "\u303f" or "\uff00" <= c <= "\uffef" for c in query)
    return WEIGHTS_CJK if cjk else WEIGHTS_OTHER


def fuse(ft: DataFrame, vec: DataFrame, w_ft: float, w_vec: float, key: str = "chunk_id") -> DataFrame:
    """key, score, score_ft, score_vec, source. A hit of one route only counts by presence, so a distance of 0 is the best
    similarity and not none."""
    j = ft.withColumnRenamed("score", "_ft").join(vec.withColumnRenamed("distance", "_d"), key, "full_outer")
    sim = F.greatest(F.lit(0.0), 1 - F.col("_d"))
    score = (F.when(F.col("_ft").isNotNull() & F.col("_d").isNotNull(), w_ft * F.col("_ft") + w_vec * sim)
             .when(F.col("_ft").isNotNull(), F.col("_ft")).otherwise(w_vec * sim))
    source = F.when(F.col("_ft").isNotNull() & F.col("_d").isNotNull(), "both").when(F.col("_ft").isNotNull(), "fulltext").otherwise("vector")
    return j.select(key, F.round(score, 4).alias("score"), F.round(F.coalesce("_ft", F.lit(0.0)), 4).alias("score_ft"),
                    F.round(F.when(F.col("_d").isNotNull(), sim).otherwise(0.0), 4).alias("score_vec"), source.alias("source"))


def roll_up(hits: DataFrame, group: str = "guid", score: str = "score") -> DataFrame:
    """group, book_score, book_hit_count: best hit and a bonus for further ones, with a ceiling."""
    return hits.groupBy(group).agg(F.max(score).alias("_best"), F.count("*").alias("book_hit_count")).select(
        group, F.round(F.col("_best") + F.least(BONUS * (F.col("book_hit_count") - 1), F.lit(BONUS * BONUS_HITS)), 4).alias("book_score"), "book_hit_count")


def per_book(hits: DataFrame, most: int, limit: int | None, group: str = "guid", key: str = "chunk_id") -> DataFrame:
    """At most `most` hits of each book, the best first, `limit` in all. Where hits have been reranked (score_rerank), theirs is
    the order, they alone are shown, and a book's score starts at its best of them."""
    order = F.col("score_rerank") if "score_rerank" in hits.columns else F.col("score")
    w = Window.partitionBy(group).orderBy(order.desc(), key)
    kept = hits.where(order.isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
    out = kept.join(roll_up(hits, group, "score_rerank" if "score_rerank" in hits.columns else "score"), group).orderBy(order.desc(), key)
    return out if limit is None else out.limit(limit)


def reranked(query: str, hits: DataFrame, model: Callable[[str, list[str]], list[float]], most: int | None = RERANK_PER_BOOK, group: str = "guid", key: str = "chunk_id",
             text: str = "content", score: str = "score") -> DataFrame:
    """The `most` best hits of each group (None: all hits) with a cross-encoder's score_rerank; the model sees no other hit."""
    kept = hits
    if most is not None:
        w = Window.partitionBy(group).orderBy(F.col(score).desc(), key)
        kept = hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")

    @F.pandas_udf("double")
    def of(s):
        import pandas as pd

        return pd.Series(model(query, list(s)), index=s.index)

    return kept.withColumn("score_rerank", of(F.substring(text, 1, RERANK_CHARS)))


def top(query: str, rows: DataFrame, model: Callable[[str, list[str]], list[float]], n: int, key: str, text: str) -> DataFrame:
    """The n rows that fit the query best."""
    return reranked(query, rows, model, None, key=key, text=text).orderBy(F.col("score_rerank").desc(), key).limit(n)


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """chunk_id, content of a few ids: the copy that is first by `first`."""
    return texts.join(F.broadcast(ids), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min_by("content", "first").alias("content"))


@dataclass
class SearchResult:
    results: DataFrame
    meta: dict = field(default_factory=dict)


class Engine:
    """Searches over a document store's tables. `embed` maps a text to a vector, `rerank` a column pair (query, text) to
    a score; both are optional and their absence or failure is reported, never silent."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], embed: Callable[[str], list[float]] | None = None,
                 rerank: Callable[[str, list[str]], list[float]] | None = None, max_per_book: int = DEFAULT_MAX_PER_BOOK, dims: int = 64,
                 stopwords: frozenset[str] = STOPWORDS):
        self.spark, self.t, self.embed, self.rerank, self.max_per_book, self.dims, self.stopwords = spark, tables, embed, rerank, max_per_book, dims, stopwords
        self.default_tags: str | None = None

    def set_default_tags(self, tags: str = "") -> str | None:
        for_query(tags)
        self.default_tags = tags.strip() or None
        return self.default_tags

    def _books(self, bucket: str | None, tags: list[str] | None) -> DataFrame:
        b = self.t["book"]
        if bucket is not None:
            b = b.where(F.col("bucket") == bucket)
        return b.where(any_tag(F.col("tags"), tags)) if tags else b

    def _scope(self, bucket: str | None, tags: list[str] | None) -> DataFrame:
        """Chunks of the books asked for; conditions hold before any top-k."""
        return self.t["chunk"].select("chunk_id", "guid").join(self._books(bucket, tags).select("guid").distinct(), "guid", "left_semi").select("chunk_id").distinct()

    def search(self, query: str, bucket: str | None = None, tags: str | None = None, limit: int = 10, fulltext_only: bool = False, vector_only: bool = False,
               category: str | None = None) -> SearchResult:
        """Books chunk by chunk, chats and notes as whole documents; `category` is one of them or all (None). One order for all:
        the rerank's score where there is one, else the fused one."""
        if category not in (None, "book", *WHOLE):
            raise ValueError(f"category: book, {', '.join(WHOLE)} or none")
        wanted = for_query(tags if tags is not None else self.default_tags)
        kept, pruned = split_terms(query, self.stopwords)
        meta = {"mode": "hybrid", "fallback": None, "degraded": [], "salvaged": False, "retried_unpruned": False, "query_terms": {"kept": kept, "pruned": pruned}}
        if pruned and len(pruned) >= len(kept):
            meta["degraded"].append("most of the query's words were pruned")
        use_ft, use_vec = not vector_only, not fulltext_only
        if use_ft != use_vec:
            meta["mode"] = "fulltext" if use_ft else "vector"
        vector: list = []

        def embedded() -> list[float] | None:
            """The query's vector, made once; without it the route is reported as degraded, once."""
            if not vector:
                try:
                    vector.append(None if self.embed is None else self.embed(query))
                    if self.embed is None:
                        meta["degraded"].append("vector: no embedder")
                except Exception as e:  # a route that fails isn't the absence of data
                    meta["degraded"].append(f"vector: {e}")
                    vector.append(None)
            return vector[0]

        def answer(ft: bool, vec: bool) -> DataFrame:
            found = []
            if category in (None, "book") and "chunk" in self.t:
                found.append(self._books_found(query, kept, pruned, bucket, wanted, limit, ft, embedded if vec else None, meta))
            for c, (name, has_vectors) in WHOLE.items():
                if category in (None, c) and name in self.t:
                    found.append(self._whole_found(query, c, self.t[name], kept, bucket, wanted, limit, ft, embedded if vec and has_vectors else None))
            if not found:
                raise ValueError(f"no table of category {category}")
            every = found[0]
            for f in found[1:]:
                every = every.unionByName(f, allowMissingColumns=True)
            ties = [c for c in ("chunk_id", "guid") if c in every.columns]
            return every.orderBy(F.coalesce("score_rerank", "score").desc(), *ties).limit(limit).persist()

        out = answer(use_ft, use_vec)
        if use_ft != use_vec and out.isEmpty():
            meta["fallback"] = "vector" if use_ft else "fulltext"
            out = answer(not use_ft, not use_vec)
        return SearchResult(out, meta)

    def _rank(self, table: DataFrame, name: str, terms: list[str], k: int, only: DataFrame, **kw) -> DataFrame:
        """By the stored postings where there are any, else by a scan of the index rows."""
        if name in self.t:
            return rank_postings(self.t[name], terms, k, only=only, **kw)
        return rank(table, terms, k, only=only, **kw)

    def _books_found(self, query, kept, pruned, bucket, wanted, limit, use_ft, embedded, meta) -> DataFrame:
        scope = self._scope(bucket, wanted)
        ft = self._rank(self.t["fts"], "posting", kept, limit * OVERFETCH, scope).persist() if use_ft else None
        if use_ft and pruned and ft.isEmpty():
            meta["retried_unpruned"] = True
            ft = self._rank(self.t["fts"], "posting", raw_terms(query), limit * OVERFETCH, scope).persist()
        v = embedded() if embedded else None
        vec = nearest(self.t["vec"], v, limit * OVERFETCH, dims=self.dims, only=scope).persist() if v is not None else None
        fused = fuse(ft if ft is not None else self.spark.createDataFrame([], "chunk_id bigint, score double"),
                     vec if vec is not None else self.spark.createDataFrame([], "chunk_id bigint, distance double"), *weights(query))
        if (use_ft or embedded) and fused.isEmpty():
            texts = self.t.get("text", self.t["chunk"])
            ids = substring_hits(texts.join(scope, "chunk_id", "left_semi"), salvage_terms(query), limit * OVERFETCH)
            fused = ids.select("chunk_id", F.lit(SALVAGE_SCORE).alias("score"), F.lit(0.0).alias("score_ft"), F.lit(0.0).alias("score_vec"), F.lit("like").alias("source"))
            meta["salvaged"] = not fused.isEmpty()
        # texts are read last, of the hits alone: at most OVERFETCH times `limit` of either route
        hits = F.broadcast(fused).join(self.t["chunk"], "chunk_id").dropDuplicates(["chunk_id"]).join(self._books(bucket, wanted).dropDuplicates(["guid"]), "guid")
        if "text" in self.t:
            hits = hits.join(texts_of(self.t["text"], fused.select("chunk_id")), "chunk_id", "left")
        hits = hits.persist()
        best = None
        if self.rerank is None:
            meta["degraded"].append("rerank: no model")
        else:
            try:
                best = reranked(query, hits, self.rerank).select("chunk_id", "score_rerank").persist()
                if best.count() < 2:
                    best = None
            except Exception as e:
                meta["degraded"].append(f"rerank: {str(e).splitlines()[-1]}")
                best = None
        if best is None:
            out = per_book(hits, self.max_per_book, None).withColumn("score_rerank", F.lit(None).cast("double"))
        else:
            out = per_book(hits.join(best, "chunk_id", "left"), self.max_per_book, None)
        return out.withColumn("category", F.lit("book"))

    def _whole_found(self, query, category, docs, kept, bucket, wanted, limit, use_ft, embedded) -> DataFrame:
        """Whole documents: guid and payload of the best of both routes."""
        scope = docs if bucket is None else docs.where(F.col("bucket") == bucket)
        scope = scope.where(any_tag(F.col("tags"), wanted)) if wanted else scope
        ids = scope.select("guid")
        none = self.spark.createDataFrame([], "guid string, score double, distance double")
        ft = rank(docs, kept, limit * OVERFETCH_WHOLE, key="guid", ts="created_at", only=ids) if use_ft else none.select("guid", "score")
        v = embedded() if embedded else None
        vec = nearest(docs, v, limit * OVERFETCH_WHOLE, key="guid", ts="created_at", dims=self.dims, only=ids) if v is not None else none.select("guid", "distance")
        fused = fuse(ft, vec, *weights(query), key="guid")
        shown = [c for c in docs.columns if c in ("bucket", "tags", "title", "source_path")]
        body = docs.select("guid", *shown, snippet(F.col("content"), SNIPPET_CHARS).alias("snippet"))
        return F.broadcast(fused).join(body, "guid").dropDuplicates(["guid"]).withColumn("category", F.lit(category)).withColumn("score_rerank", F.lit(None).cast("double"))

    def find_books(self, query_vector: list[float], cards: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
        """(books by distance, signal): cards has guid and embedding; the signal needs every book's distance."""
        d = nearest(cards, query_vector, None, key="guid", ts=None, dims=self.dims)
        return d.orderBy("distance", "guid").limit(max(0, limit)), existence_signal(d)


def existence_signal(distances: DataFrame) -> DataFrame:
    """corpus_books, top1_distance, gap to the 5th (or last), z of the best; never a verdict. The five least distances
    come from a bounded top-k, not from a list of all."""
    a = distances.agg(F.count("*").alias("n"), F.min("distance").alias("d0"), F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("sd"))
    top = distances.orderBy("distance").limit(5).agg(F.max("distance").alias("d5"))
    return a.crossJoin(F.broadcast(top)).select(
        F.col("n").alias("corpus_books"), F.round("d0", 4).alias("top1_distance"), F.round(F.col("d5") - F.col("d0"), 4).alias("gap"),
        F.round(F.when((F.col("n") > 1) & (F.col("sd") > 0), (F.col("mean") - F.col("d0")) / F.col("sd")).otherwise(0.0), 2).alias("z"))
