"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.mixing import mix
from quire.llm.tokens import count_tokens
from quire.session import spread_table, table


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread_table(spark, sf_dir, "documents").where("source is not null and text is not null")
    return mix(count_tokens(docs, "text", ["doc_id", "source"]), "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_targets"))


def p9_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen records with their number of copies."""
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, sf_dir)[1]


def p9_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records chosen too often or from no targeted source, and sources beyond their budget; there are none."""
    targets = table(spark, sf_dir, "mix_targets").select("source", "max_repeats")
    chosen, report = _mix(spark, sf_dir)
    odd = chosen.join(targets, "source", "left").where("max_repeats is null or copies > max_repeats or copies < 1").select("source", F.lit("record").alias("what"))
    far = report.where("tokens > budget + 0.5").select("source", F.lit("share").alias("what"))
    return odd.unionByName(far)


QUERIES = {"p9_chosen": p9_chosen, "p9_shares": p9_shares, "p9_violations": p9_violations}
SQL = {"p9_violations": "SELECT source, 'record' AS what FROM mix_targets WHERE false"}
