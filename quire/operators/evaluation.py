"""Evaluation of retrieval and operation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut


def length_stats(rows: DataFrame, text: str) -> DataFrame:
    """calls, distinct, shortest, upper median and longest length."""
    q = rows.where(F.col(text).isNotNull())
    one = q.groupBy(F.length(text).alias("len")).agg(F.count("*").alias("n"))
    # running counts over distinct lengths, of which there are few
    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    run = one.withColumn("upto", F.sum("n").over(w)).crossJoin(F.broadcast(one.agg(F.sum("n").alias("total"))))
    med = run.where("upto > floor(total / 2)").agg(F.min("len").alias("median_len"))
    return q.agg(F.count("*").alias("calls"), F.count_distinct(text).alias("distinct_texts"), F.min(F.length(text)).alias("min_len"), F.max(F.length(text)).alias("max_len")).crossJoin(F.broadcast(med))


def cluster(c: Column, themes: list[tuple[str, list[str]]], other: str = "other") -> Column:
    """The first theme any of whose words occurs."""
    out = None
    low = F.lower(c)
    for name, words in themes:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def auroc(rows: DataFrame, score: str, label: str, higher_is_positive: bool = True) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half, from rank sums over distinct scores:
    no pairs are made."""
    s = F.col(score) if higher_is_positive else -F.col(score)
    g = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(s.alias("s")).agg(
        F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("q"))
    # ranges of scores, each summed in its own task; what lies below a range is a sum over as many rows as there are ranges
    parts = cut(g.repartitionByRange("s").withColumn("part", F.spark_partition_id()))
    whole = parts.groupBy("part").agg(F.sum("q").alias("n"))
    before = whole.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("q").over(Window.partitionBy("part").orderBy("s")) - F.col("q")
    below = parts.withColumn("own", own).join(F.broadcast(before), "part").withColumn("below", F.col("before") + F.col("own"))
    return below.withColumn("u", F.col("p") * (F.col("below") + F.col("q") / 2)).agg(
        F.round(F.try_divide(F.sum("u"), F.sum("p") * F.sum("q")), 6).alias("auroc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def confusion(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """For each threshold: positives and negatives at or above it."""
    t = F.explode(F.array(*map(F.lit, thresholds)))
    return rows.select(score, label, t.alias("threshold")).groupBy("threshold").agg(
        F.count_if(F.col(label) & (F.col(score) >= F.col("threshold"))).alias("positives_rejected"),
        F.count_if(~F.col(label) & (F.col(score) >= F.col("threshold"))).alias("negatives_caught"), F.count("*").alias("n"))


def sliding_usage(log: DataFrame, who: str, ts: str, amount: str, seconds: int = 60) -> DataFrame:
    """Calls and amount of the last `seconds` up to each call, per caller."""
    sec = F.col(ts).cast("timestamp").cast("double")
    w = Window.partitionBy(who).orderBy(F.col("_s")).rangeBetween(-seconds, 0)
    return log.withColumn("_s", sec).withColumn("calls_in_window", F.count("*").over(w)).withColumn("amount_in_window", F.sum(amount).over(w)).drop("_s")


def health_window(log: DataFrame, who: str, order: list[str], failed: Column, n: int = 20) -> DataFrame:
    """Failures among each caller's last n outcomes."""
    w = Window.partitionBy(who).orderBy(*order).rowsBetween(-(n - 1), 0)
    return log.withColumn("failures_in_window", F.sum(failed.cast("int")).over(w))


def health_states(log: DataFrame, who: str, order: list[str], failed: Column, down_after: int = 4, refused: Column | None = None) -> DataFrame:
    """State after each call. misconfigured: the call was refused for its credentials, which is no failure of the other side;
    down or degraded: so many failures since the last success; healthy; unknown: no outcome so far (null isn't one)."""
    no = F.lit(False)
    bad = F.coalesce(refused, no) if refused is not None else no
    w = Window.partitionBy(who).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s = log.withColumn("_f", F.coalesce(failed, no) & ~bad).withColumn("_r", bad).withColumn("_ok", F.coalesce(~failed, no) & ~bad)
    s = s.withColumn("_g", F.sum((F.col("_ok") | F.col("_r")).cast("int")).over(w)).withColumn("_n", F.sum(F.col("_ok").cast("int")).over(w))
    run = F.sum(F.col("_f").cast("int")).over(Window.partitionBy(who, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    state = (F.when(F.col("_r"), "misconfigured").when(F.col("consecutive") >= down_after, "down").when(F.col("consecutive") > 0, "degraded")
             .when(F.col("_n") > 0, "healthy").otherwise("unknown"))
    return s.withColumn("consecutive", run).withColumn("state", state).drop("_f", "_r", "_ok", "_g", "_n")


def errors(rows: DataFrame, kind: str, message: str, example: str) -> DataFrame:
    """Histogram of 'kind: message' with the first example."""
    return rows.groupBy(F.concat_ws(": ", kind, message).alias("error")).agg(F.count("*").alias("n"), F.min(example).alias("example"))


def within_vocabulary(rows: DataFrame, tags: str, library: DataFrame) -> DataFrame:
    """Rows with whether all their tags are among the library's (one column tag)."""
    each = rows.select("id", F.explode(tags).alias("tag")).join(library.select("tag").distinct().withColumn("_known", F.lit(True)), "tag", "left")
    known = each.groupBy("id").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("all_known"))
    return rows.select("id").join(known, "id", "left").withColumn("all_known", F.coalesce("all_known", F.lit(True)))
