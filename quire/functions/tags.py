"""Comma-separated tags in a column: splitting, query normalisation, validation, audit, editing."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: means "all data" in a query; never stored
ALL_DATA = "OMNIA"
# Characters that break the column's structure.
FORBIDDEN = ("'", '"', "`", ";", "\\", "\n", "\r", "\t")


class TagError(ValueError):
    """A tag that can't be stored or asked for."""


def split_col(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_replace(x, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")), lambda x: x != "")


def any_tag(c: Column, tags: list[str]) -> Column:
    """The column holds any of the tags as an exact element."""
    return F.arrays_overlap(split_col(F.coalesce(c, F.lit(""))), F.array(*map(F.lit, tags)))


def all_like(c: Column, parts: list[str]) -> Column:
    """The column contains every part somewhere."""
    out = F.lit(True)
    for p in parts:
        out = out & c.contains(p)
    return out


def reserved_words(spark: SparkSession) -> frozenset[str]:
    """SQL's own keywords, as the engine lists them."""
    return frozenset(r[0].lower() for r in spark.sql("SELECT keyword FROM sql_keywords()").collect())


def defect(element: str, reserved: frozenset[str] = frozenset()) -> str | None:
    """Why an element can't be a tag: sentinel, illegal or keyword; None if it can."""
    if element.strip().upper() == ALL_DATA:
        return "sentinel"
    if any(c in element for c in FORBIDDEN):
        return "illegal"
    return "keyword" if element.lower() in reserved else None


def defect_col(e: Column, reserved: frozenset[str]) -> Column:
    bad = "[" + "".join("\\" + c if c in "\\'\"`;" else {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c] for c in FORBIDDEN) + "]"
    keyword = F.array_contains(F.array(*[F.lit(w) for w in sorted(reserved)] or [F.lit("")]), F.lower(e))
    return F.when(F.upper(F.trim(e)) == ALL_DATA, "sentinel").when(e.rlike(bad), "illegal").when(keyword, "keyword")


def elements(tags: str | None) -> list[str]:
    return [t for x in (tags or "").split(",") if (t := x.strip())]


def for_query(tags: str | None, reserved: frozenset[str] = frozenset()) -> list[str] | None:
    """None: no condition. The sentinel alone means all data; with other tags it has no sense."""
    got = elements(tags)
    if not got or [t.upper() for t in got] == [ALL_DATA]:
        return None
    for t in got:
        if (why := defect(t, reserved)) is not None:
            raise TagError(f"{t!r}: {why}")
    return got


def for_write(tags: str | None, single: bool = False, reserved: frozenset[str] = frozenset()) -> str:
    """The normal form to store; a single value may hold no comma."""
    if single and "," in (tags or ""):
        raise TagError(f"{tags!r}: a comma would make several tags of it")
    got = elements(tags)
    for t in got:
        if (why := defect(t, reserved)) is not None:
            raise TagError(f"{t!r}: {why}")
    return ",".join(got)


def add_col(c: Column, tags: list[str]) -> Column:
    return F.array_join(F.array_union(split_col(F.coalesce(c, F.lit(""))), F.array(*map(F.lit, tags))), ",")


def remove_col(c: Column, tags: list[str]) -> Column:
    return F.array_join(F.array_except(split_col(F.coalesce(c, F.lit(""))), F.array(*map(F.lit, tags))), ",")
