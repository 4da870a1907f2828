"""References to records that do not exist: direct and inherited orphans over a foreign-key graph.

Defined results: a null or blank reference refers to nothing and is no orphan; copies of a record count once with
their earliest time; a null time of the record or of the reference counts as in time; empty tables give no rows,
and an empty parent table makes every reference missing; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut


def guid_key(c: Column) -> Column:
    """Guids are the same whatever their letter case, surrounding blanks and braces."""
    bare = F.regexp_replace(c, r"^[\p{IsWhite_Space}{}\x{200B}\x{FEFF}]+|[\p{IsWhite_Space}{}\x{200B}\x{FEFF}]+$", "")
    return F.nullif(F.lower(bare), F.lit(""))


@dataclass
class Entity:
    """`rows` with any columns; `key` and `ts` are expressions over them."""

    name: str
    rows: DataFrame
    key: Column
    ts: Column


@dataclass
class ForeignKey:
    child: str
    parent: str
    ref: Column
    #: key column of records that were deleted on purpose, already normalised
    deleted: DataFrame | None = None
    #: > 1 where one parent may be named by a large share of all children
    salt: int = 1


@dataclass
class _State:
    records: DataFrame
    refs: list[ForeignKey] = field(default_factory=list)


def _collapse(e: Entity, fks: list[ForeignKey]) -> DataFrame:
    """One row per key: the earliest time and, for each foreign key, the earliest copy's reference."""
    cols = [e.key.alias("_key"), e.ts.alias("_ts")]
    for i, fk in enumerate(fks):
        cols.append(fk.ref.alias(f"_ref{i}"))
    aggs = [F.min("_ts").alias("_ts")]
    for i, _ in enumerate(fks):
        # the earliest copy that has a reference; equal times by the reference itself
        aggs.append(
            F.min(F.when(F.col(f"_ref{i}").isNotNull(), F.struct(F.coalesce("_ts", F.timestamp_micros(F.lit(0))), f"_ref{i}")))
            .getField(f"_ref{i}").alias(f"_ref{i}")
        )
    return e.rows.select(*cols).where(F.col("_key").isNotNull()).groupBy("_key").agg(*aggs)


def _order(entities: dict[str, Entity], fks: list[ForeignKey]) -> list[str] | None:
    """Parents before children; None if references form a cycle."""
    left, done = dict.fromkeys(entities), []
    while left:
        ready = [n for n in left if all(f.parent in done for f in fks if f.child == n)]
        if not ready:
            return None
        done += ready
        for n in ready:
            del left[n]
    return done


def _spread(child: DataFrame, parent: DataFrame, salt: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Replicates the (small) parent side so that the children of one parent are spread over `salt` tasks."""
    if salt <= 1:
        return child, parent, []
    return (
        child.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salt)).cast("int")),
        parent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))),
        ["_salt"],
    )


def orphan_cascade(entities: list[Entity], fks: list[ForeignKey], max_rounds: int = 50) -> DataFrame:
    """table_name, row_key, parent_table, ref_key, ref_state (late, deleted, missing or inherited), orphan_kind
    (direct or inherited), earliest_ts.

    A direct orphan's reference finds no record in time. Whatever refers to an orphan is an inherited orphan; these
    follow from semi-joins down the graph, in one sweep where the graph has no cycle, else round by round until none
    is added. A row that is a direct orphan by a reference isn't listed as inherited by the same one."""
    by = {e.name: e for e in entities}
    own = {n: [f for f in fks if f.child == n] for n in by}
    records = {n: _collapse(e, own[n]) for n, e in by.items()}

    def direct(n: str) -> list[DataFrame]:
        out = []
        for i, fk in enumerate(own[n]):
            child = records[n].select("_key", "_ts", F.col(f"_ref{i}").alias("_ref")).where("_ref is not null")
            parent = records[fk.parent].select(F.col("_key").alias("_ref"), F.col("_ts").alias("_parent_ts"), F.lit(True).alias("_found"))
            child, parent, extra = _spread(child, parent, fk.salt)
            # parents grow with the data: merged, never broadcast
            found = child.join(parent.hint("merge"), ["_ref", *extra], "left")
            found = found.where("_found is null or _parent_ts > _ts")
            if fk.deleted is not None:
                gone = fk.deleted.select(F.col(fk.deleted.columns[0]).alias("_ref")).where("_ref is not null").distinct().withColumn("_gone", F.lit(True))
                # the children of one deleted parent are spread as before
                gone = gone.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(fk.salt - 1)))) if extra else gone
                found = found.join(gone, ["_ref", *extra], "left")
            else:
                found = found.withColumn("_gone", F.lit(None).cast("boolean"))
            out.append(found.select(
                F.lit(n).alias("table_name"), F.col("_key").cast("string").alias("row_key"), F.lit(fk.parent).alias("parent_table"),
                F.col("_ref").cast("string").alias("ref_key"),
                F.when(F.col("_found"), "late").when(F.col("_gone"), "deleted").otherwise("missing").alias("ref_state"),
                F.lit("direct").alias("orphan_kind"), F.col("_ts").alias("earliest_ts")))
        return out

    directs = {n: direct(n) for n in by}
    order = _order(by, fks)
    parts: list[DataFrame] = [d for ds in directs.values() for d in ds]

    def heirs(n: str, fk: ForeignKey, i: int, affected: DataFrame) -> DataFrame:
        child = records[n].select("_key", "_ts", F.col(f"_ref{i}").alias("_ref")).where("_ref is not null")
        child, keys, extra = _spread(child, affected.withColumnRenamed("_key", "_ref"), fk.salt)
        return child.join(keys.hint("merge"), ["_ref", *extra], "left_semi").join(
            directs[n][i].select(F.col("row_key").alias("_dk")).hint("merge"), F.col("_key").cast("string") == F.col("_dk"), "left_anti"
        ).select(F.lit(n).alias("table_name"), F.col("_key").cast("string").alias("row_key"), F.lit(fk.parent).alias("parent_table"),
                 F.col("_ref").cast("string").alias("ref_key"), F.lit("inherited").alias("ref_state"),
                 F.lit("inherited").alias("orphan_kind"), F.col("_ts").alias("earliest_ts"))

    def typed_keys(n: str, rows: list[DataFrame]) -> DataFrame | None:
        kind = dict(records[n].dtypes)["_key"]
        keys = [r.select(F.col("row_key").cast(kind).alias("_key")) for r in rows]
        out = None
        for k in keys:
            out = k if out is None else out.unionByName(k)
        return out.distinct() if out is not None else None

    if order is not None:
        affected: dict[str, DataFrame | None] = {}
        for n in order:
            mine = [heirs(n, fk, i, affected[fk.parent]) for i, fk in enumerate(own[n]) if affected.get(fk.parent) is not None]
            parts += mine
            affected[n] = typed_keys(n, directs[n] + mine)
    else:
        affected = {n: (cut(k) if (k := typed_keys(n, directs[n])) is not None else None) for n in by}
        inherited: dict[tuple[str, int], DataFrame] = {}
        for _ in range(max_rounds):
            grown = False
            for n in by:
                mine = {i: heirs(n, fk, i, affected[fk.parent]) for i, fk in enumerate(own[n]) if affected.get(fk.parent) is not None}
                inherited |= {(n, i): d for i, d in mine.items()}
                new = typed_keys(n, list(mine.values()))
                if new is None:
                    continue
                if affected[n] is not None:
                    new = new.join(affected[n], "_key", "left_anti")
                new = cut(new)
                if not new.isEmpty():
                    grown = True
                    affected[n] = new if affected[n] is None else cut(affected[n].unionByName(new))
            if not grown:
                break
        else:
            raise ValueError(f"no fixpoint after {max_rounds} rounds")
        parts += list(inherited.values())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month of their earliest time (UTC), state and kind."""
    return orphans.groupBy("table_name", F.date_format("earliest_ts", "yyyy-MM").alias("month_utc"), "ref_state", "orphan_kind").agg(
        F.count("*").alias("orphans"))
