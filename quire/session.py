"""Session helpers: shared folder, checkpoints and table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which the session names. Where it names none, as in tests on one machine, a folder of
    our own that goes with the driver; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quire-shared-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        where = "file://" + _own[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


#: folders of our own by application
_own: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and continue from there, so that it is computed once and
    survives the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table for work that is heavy per row: one that is read in fewer parts than there are cores, as a small file is, is
    dealt out to all of them; a large one, which has parts enough, isn't moved."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(table(spark, sf_dir, name))


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a result whose size doesn't grow with the data; raises beyond `most` instead of dropping any."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows, too many to hold on the driver")
    return rows
