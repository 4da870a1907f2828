"""Records of several sources mixed to target shares of the total size.

Each record has a hash; a source's records below a threshold are taken. Sizes are summed by source and hash bucket, the
bucket in which the budget is reached is found by a running sum over the buckets, and only that bucket's records are
summed again by finer buckets, so the threshold is found without sorting records. Thresholds of smaller budgets are
nested in those of larger ones.

The size of the mix is `total`, by default the size of all records of the targeted sources. A source whose capped
repetitions fall short of its budget is taken whole, max_repeats times, and the rest goes to the others in proportion
to their weights. Defined results: records of sources without a target, or without source, aren't chosen; a targeted
source without records is reported with share 0; a null or zero size is never chosen beyond whole repeats; weights are
scaled to sum to 1; ties of hashes are taken or left together; empty tables give an empty mix; repeated rows count as
records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import bounded_rows, cut

#: a table of targets is written by hand
MOST_TARGETS = 10_000
BITS = 10
LEVELS = 4


def budgets(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float) -> dict[str, float]:
    """Budget of each source: weights of the total, with what capped sources lack given to the others."""
    weights = {s: w for s, w, _ in targets if w and w > 0}
    cap = {s: (sizes.get(s) or 0) * max(r or 0, 0) for s, _, r in targets}
    out, free, left = {}, set(weights), float(total)
    while free:
        whole = sum(weights[s] for s in free)
        full = {s for s in free if left * weights[s] / whole >= cap[s]}
        if not full:
            return out | {s: left * weights[s] / whole for s in free}
        for s in full:
            out[s] = float(cap[s])
        left -= sum(cap[s] for s in full)
        free -= full
    return out


def _thresholds(sized: DataFrame, want: DataFrame) -> DataFrame:
    """source, threshold: the hashes below it hold at most the source's `part` of the size, and the next bucket of
    2**(BITS*LEVELS) would exceed it."""
    at = want.select("source", "part", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("below"))
    w = Window.partitionBy("source").orderBy("bucket")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        bucket = F.shiftright("hash", shift)
        # only records of the boundary bucket of the level before
        mine = sized.join(F.broadcast(at), "source").where(F.shiftright(bucket, BITS) == F.col("prefix"))
        sums = mine.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.first("below").alias("below"), F.first("part").alias("part"))
        run = sums.withColumn("upto", F.col("below") + F.sum("size").over(w))
        fits = run.where("upto <= part").groupBy("source").agg(F.max("bucket").alias("_b"), F.max("upto").alias("_upto"))
        # the first bucket that doesn't fit is the next one to refine
        at = at.join(run.where("upto > part").groupBy("source").agg(F.min("bucket").alias("_next")), "source", "left").join(fits, "source", "left").select(
            "source", "part",
            F.coalesce("_next", F.when(F.col("_b").isNotNull(), F.col("_b") + 1), F.shiftleft("prefix", BITS)).alias("prefix"),
            F.coalesce("_upto", "below").alias("below"))
        # as many rows as there are targets
        at = sized.sparkSession.createDataFrame(bounded_rows(at, MOST_TARGETS, "targets"), "source string, part double, prefix bigint, below bigint")
    return at.select("source", F.col("prefix").alias("threshold"))


def mix(sized: DataFrame, key: str, source: str, size: str, targets: DataFrame, total: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(chosen, report). chosen: `key`, source, size, copies. report: source, target_weight, target_share and budget in
    tokens (after caps), records, tokens, actual_share."""
    spark = sized.sparkSession
    rows = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in bounded_rows(
        targets.where("source is not null").groupBy("source").agg(F.max("weight"), F.max("max_repeats")), MOST_TARGETS, "targets")]
    whole = sum(w for _, w, _ in rows) or 1.0
    wanted = spark.createDataFrame([(s,) for s, _, _ in rows], "source string")
    mask = (1 << (BITS * LEVELS)) - 1
    one = sized.select(F.col(key), F.col(source).alias("source"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"),
                       F.xxhash64(F.lit(seed), F.col(key)).bitwiseAND(F.lit(mask)).alias("hash"))
    one = cut(one.join(F.broadcast(wanted), "source"))
    sizes = {r[0]: r[1] for r in bounded_rows(one.groupBy("source").agg(F.sum("size")), MOST_TARGETS, "sources")}
    total = sum(sizes.values()) if total is None else total
    plan = budgets(sizes, rows, total)
    parts = []
    for s, b in plan.items():
        n = sizes.get(s, 0)
        full = int(b // n) if n else 0
        parts.append((s, full, b - full * n))
    want = spark.createDataFrame([(s, f, float(p)) for s, f, p in parts], "source string, full int, part double")
    cuts = _thresholds(one, want)
    chosen = one.join(F.broadcast(want.select("source", "full")), "source").join(F.broadcast(cuts), "source").select(
        key, "source", "size", (F.col("full") + (F.col("hash") < F.col("threshold")).cast("int")).alias("copies")).where("copies > 0")
    share = spark.createDataFrame([(s, w / whole, plan.get(s, 0.0) / total if total else 0.0, float(plan.get(s, 0.0)), r) for s, w, r in rows],
                                  "source string, target_weight double, target_share double, budget double, max_repeats int")
    got = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("records"), F.max("copies").alias("most_copies"),
                                       F.sum(F.col("size") * F.col("copies")).alias("tokens"))
    report = share.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    report = report.withColumn("actual_share", F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1)))
    return chosen, report
