"""Evaluation and operation logs, and the store's generic relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.evaluation import auroc, cluster, confusion, errors, health_states, health_window, length_stats, sliding_usage
from quire.operators.vectors import weighted_mean
from quire.session import table

THEMES = [("stars", ["telescope", "satellite", "orbit"]), ("stones", ["basalt", "granite", "limestone"]), ("books", ["manuscript", "ledger", "binding"])]


def query_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_stats(table(spark, sf_dir, "eval_items"), "text")


def query_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_items").groupBy(cluster(F.col("text"), THEMES).alias("theme")).agg(F.count("*").alias("items"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("value is not null").select(F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("label"))


def score_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auroc(_scored(spark, sf_dir), "score", "label")


def score_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(_scored(spark, sf_dir), "score", "label", [0.45, 0.49, 0.53, 10.0, 50.0])


def usage_sliding_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u = sliding_usage(e.select("event_id", "user_id", "ts", F.length("props").alias("size")), "user_id", "ts", "size", 60)
    return u.select("event_id", "calls_in_window", "amount_in_window")


def usage_sliding_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u = sliding_usage(e.select("event_id", "user_id", "ts", F.length("props").alias("size")), "user_id", "ts", "size", 86_400)
    return u.select("event_id", "calls_in_window", "amount_in_window")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "props")


def health_window20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health_window(_log(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "failures_in_window")


def health_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health_states(_log(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") != "click").select("event_id", "consecutive", "state")


def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors(_log(spark, sf_dir).withColumn("m", F.substring("props", 1, 4)).withColumn("e", F.col("event_id")), "event_type", "m", "e")


def mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of the labelled vectors, weighted by id."""
    e = table(spark, sf_dir, "embeddings").withColumn("w", F.col("vec_id") % 7 + 1)
    m = weighted_mean(e, ["label"], "embedding", "w")
    return m.select("label", F.posexplode("mean").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def orders_without_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anti-join and a decorrelated count on the star schema."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.count_if(F.col("n").isNull()).alias("without_items"), F.sum(F.coalesce("n", F.lit(0))).alias("items"))


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation")}
    j = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("items"))


QUERIES = {f.__name__: f for f in (query_lengths, query_clusters, score_auroc, score_confusion, usage_sliding_60s, usage_sliding_day, health_window20, health_state, error_histogram,
                                   mean_by_label, orders_without_items, revenue_by_nation)}
_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in THEMES) + " ELSE 'other' END"
_SLIDE = """SELECT event_id, count(*) OVER w AS calls_in_window, sum(length(props)) OVER w AS amount_in_window FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL {n} SECOND PRECEDING AND CURRENT ROW)"""
SQL = {
    "query_lengths": """SELECT count(*) AS calls, count(DISTINCT text) AS distinct_texts, min(length(text)) AS min_len, max(length(text)) AS max_len,
      list_sort(list(length(text)))[(count(*) // 2 + 1)::INT] AS median_len FROM eval_items WHERE text IS NOT NULL""",
    "query_clusters": f"SELECT {_CASE} AS theme, count(*) AS items FROM eval_items GROUP BY 1",
    "score_auroc": """WITH s AS (SELECT value AS v, event_type = 'purchase' AS l FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
      r AS (SELECT l, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM s)
      SELECT round((sum(rk) FILTER (l) - count(*) FILTER (l) * (count(*) FILTER (l) + 1) / 2.0) / (count(*) FILTER (l) * count(*) FILTER (NOT l)), 6) AS auroc,
        count(*) FILTER (l) AS positives, count(*) FILTER (NOT l) AS negatives FROM r""",
    "score_confusion": """SELECT t AS threshold, count(*) FILTER (event_type = 'purchase' AND value >= t) AS positives_rejected, count(*) FILTER (event_type <> 'purchase' AND value >= t) AS negatives_caught,
      count(*) AS n FROM events, unnest([0.45::DOUBLE, 0.49, 0.53, 10.0, 50.0]) u(t) WHERE value IS NOT NULL GROUP BY 1""",
    "usage_sliding_60s": _SLIDE.format(n=60),
    "usage_sliding_day": _SLIDE.format(n=86_400),
    "health_window20": """SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS failures_in_window FROM events""",
    "health_state": """WITH g AS (SELECT *, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
      c AS (SELECT event_id, sum((event_type <> 'click')::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS consecutive FROM g)
      SELECT event_id, consecutive, CASE WHEN consecutive >= 4 THEN 'down' WHEN consecutive > 0 THEN 'degraded' ELSE 'healthy' END AS state FROM c""",
    "error_histogram": "SELECT concat_ws(': ', event_type, substr(props, 1, 4)) AS error, count(*) AS n, min(event_id) AS example FROM events GROUP BY 1",
    "mean_by_label": """WITH p AS (SELECT label, vec_id % 7 + 1 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
      m AS (SELECT label, i, sum(w * x) / sum(w) AS x FROM p GROUP BY 1, 2) SELECT label, i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""",
    "orders_without_items": """SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (n IS NULL) AS without_items, sum(coalesce(n, 0)) AS items
      FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""",
    "revenue_by_nation": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
}
