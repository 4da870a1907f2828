"""An inverted index as a table and ranking by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import fold_term, fold_word


#: parts of a stored index: a query reads those of its terms
PARTS = 64


def part_of(term):
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def postings(fts: DataFrame, key: str = "chunk_id", tokens: str = "content_tokenized", ts: str = "indexed_at") -> DataFrame:
    """part, term, key, tf, len of the earliest copy of each record; len is the record's number of terms. The record's own row
    (term null, part -1) counts it even if it has no term. Counting within the record needs no shuffle of its terms."""
    first = fts.where(F.col(key).isNotNull() & F.col(tokens).isNotNull()).groupBy(key).agg(F.min_by(tokens, F.struct(ts, F.md5(tokens))).alias("_t"))
    doc = first.select(key, F.filter(F.split(fold_term(F.col("_t")), r"[ \n\t]+"), lambda x: x != "").alias("_w"))
    term = F.explode(F.concat("_w", F.array(F.lit(None).cast("string")))).alias("term")
    got = doc.select(key, F.size("_w").alias("len"), term).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    none = F.col("term").isNull()
    return got.select(F.when(none, -1).otherwise(part_of(F.col("term"))).alias("part"), "term", key, F.when(none, 0).otherwise(F.col("tf")).alias("tf"), "len")


def write_postings(index: DataFrame, path: str) -> None:
    """Partitioned by part and sorted by term, so a query reads the row groups of its terms."""
    index.repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").mode("overwrite").parquet(path)


def _scores(hits: DataFrame, stats: DataFrame, key: str, mode: str, k1: float, b: float) -> DataFrame:
    """key, score of (key, len, term, tf) of the asked terms; stats: total, avg_len."""
    # one row per asked term: its size is that of the query
    idf = hits.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    s = hits.join(F.broadcast(idf), "term")
    if mode == "bm25":
        w = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    else:
        idf_ = F.log10(F.col("total") / F.col("df"))
        w = F.col("tf") * idf_ * idf_
    return s.groupBy(key).agg(F.round(F.sum(w), 6).alias("score"))


def rank_postings(index: DataFrame, terms: list[str], k: int | None, key: str = "chunk_id", only: DataFrame | None = None, mode: str = "nl", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """As `rank`, from a stored index: the postings of the asked terms and the records' own rows are read, nothing else."""
    asked = sorted({fold_word(t) for t in terms if t})
    if not asked:
        return index.sparkSession.createDataFrame([], f"`{key}` {dict(index.dtypes)[key]}, score double")
    at = sorted({r[0] for r in index.sparkSession.createDataFrame([(t,) for t in asked], "t string").select(part_of(F.col("t"))).collect()})
    hits = index.where(F.col("part").isin(at) & F.col("term").isin(asked)).select(key, "len", "term", "tf")
    stats = index.where("part = -1").agg(F.count("*").alias("total"), F.avg("len").alias("avg_len"))
    out = _scores(hits, stats, key, mode, k1, b)
    out = out if only is None else out.join(only, key, "left_semi")
    return out if k is None else out.orderBy(F.col("score").desc(), key).limit(k)


def rank(fts: DataFrame, terms: list[str], k: int | None, key: str = "chunk_id", tokens: str = "content_tokenized", ts: str = "indexed_at",
         only: DataFrame | None = None, mode: str = "nl", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score: records with any of the terms by the sum of tf * idf^2 with idf = log10(N / n) (mode nl), or BM25.
    Records are scanned once; only counts of the few asked terms leave the scan. `only` (keys) restricts the result, not
    the statistics."""
    asked = sorted({fold_word(t) for t in terms if t})
    if not asked:
        return fts.sparkSession.createDataFrame([], f"`{key}` {dict(fts.dtypes)[key]}, score double")
    words = F.filter(F.split(fold_term(F.col(tokens)), r"[ \n\t]+"), lambda x: x != "")
    # texts stay where they are: only lengths and the few asked terms of each copy are moved
    each = fts.where(F.col(key).isNotNull() & F.col(tokens).isNotNull()).select(key, F.struct(ts, F.md5(tokens)).alias("_o"), words.alias("_w")).select(
        key, "_o", F.struct(F.size("_w").alias("len"), F.filter("_w", lambda x: x.isin(asked)).alias("h")).alias("_d"))
    doc = each.groupBy(key).agg(F.min_by("_d", "_o").alias("_d")).select(key, F.col("_d.len").alias("len"), F.col("_d.h").alias("_h"))
    stats = doc.agg(F.count("*").alias("total"), F.avg("len").alias("avg_len"))
    hits = doc.where(F.size("_h") > 0).select(key, "len", F.explode("_h").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    out = _scores(hits, stats, key, mode, k1, b)
    if only is not None:
        out = out.join(only, key, "left_semi")
    return out if k is None else out.orderBy(F.col("score").desc(), key).limit(k)


def substring_hits(chunks: DataFrame, terms: list[str], k: int, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """Records that contain any of the terms, the shortest first."""
    if not terms:
        return chunks.where(F.lit(False)).select(key)
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.col(text).contains(t)
    return chunks.where(hit).groupBy(key).agg(F.min(F.octet_length(text)).alias("_n")).orderBy("_n", key).limit(k).select(key)
