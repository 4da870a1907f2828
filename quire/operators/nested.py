"""Deeply nested records as related flat tables.

`flatten` walks each document once and emits one row per element of every array level: the path of the level (`[]`
marks arrays), a surrogate key made of the document's key and the element's positions, the parent's surrogate key, the
element's ordinal, its positions from the root down and its own scalar fields as a map. A level's rows form its child table (`child_table`), typed by the
merged schema that `merged_schema` infers from all rows. Depth is unbounded.

Defined results: null and unreadable documents have no rows; of a document's copies the first readable one counts; empty arrays have no rows;
an array within an array is a level of its own; an element that is no object has its value under `value`; object fields
are flattened into the element with dotted names; an empty table gives empty tables; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.drift import first_readable, one_copy, tag

ROOT = "$"
_SCHEMA = "doc_key string, level_path string, node_key string, parent_key string, ordinal int, ordinals array<int>, tags map<string,string>, fields map<string,string>"
#: scalar fields of one level that become columns, the most frequent first; further ones (ids as keys) stay together in a map
MOST_FIELDS = 2_000


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


class _Match(dict):
    """Whether a pattern matches a name; names are few, so each is matched once."""

    def __init__(self, pattern: str | None):
        self.match = re.compile(pattern).fullmatch if pattern else None

    def __missing__(self, name: str) -> bool:
        self[name] = got = self.match is None or self.match(name) is not None
        return got


def _rows(d, doc: str, fields: _Match, levels: _Match, out: tuple[list, ...]) -> None:
    """Own scalar fields of each element of the wanted levels; an explicit stack, so depth costs no recursion."""
    stack = [(d, doc, None, (), ROOT)]
    docs, paths, keys, parents, ordinals, places, tags, own_fields = out
    while stack:
        v, key, parent, place, path = stack.pop()
        wanted = levels[path]
        own, kinds, todo = [], [], [("", v)]
        while todo:
            at, x = todo.pop()
            if isinstance(x, dict):
                todo += [(f"{at}.{k}" if at else k, y) for k, y in x.items()] if at else x.items()
            elif isinstance(x, list):
                below = f"{path}.{at}[]" if at else f"{path}[]"
                # a list of nothing but scalars has no further levels
                if levels[below] or any(isinstance(e, (dict, list)) for e in x):
                    stack += [(e, f"{key}/{at}:{i}", key, (*place, i), below) for i, e in enumerate(x)]
            elif wanted and fields[at]:
                own.append((at or "value", _text(x)))
                kinds.append((at or "value", tag(x)))
        if wanted:
            for to, x in ((docs, doc), (paths, path), (keys, key), (parents, parent), (ordinals, place[-1] if place else 0), (places, place), (tags, kinds), (own_fields, own)):
                to.append(x)


def flatten(df: DataFrame, key: str, raw: str, fields: str | None = None, levels: str | None = None, order: str | None = None) -> DataFrame:
    """doc_key, level_path, node_key, parent_key, ordinal, ordinals, tags, fields. `fields` and `levels`: patterns that the
    names of scalar fields and the paths of levels must match to be kept; `order`: by which a document's copies are tried."""
    ways = pa.map_(pa.string(), pa.string())
    kinds = [pa.string()] * 4 + [pa.int32(), pa.list_(pa.int32()), ways, ways]
    cols = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, at = _Match(fields), _Match(levels)
        out: tuple[list, ...] = tuple([] for _ in cols)
        for k, d in first_readable(batches):
            _rows(d, k, want, at, out)
            if len(out[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], cols)
                out = tuple([] for _ in cols)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], cols)

    return one_copy(df.withColumn(key, F.col(key).cast("string")), key, raw, order).mapInArrow(run, _SCHEMA)


def merged_schema(flat: DataFrame) -> DataFrame:
    """level_path, field, tags (all alternatives), spark_type (string where they conflict), rows."""
    e = flat.select("level_path", F.explode("tags").alias("field", "tag"))
    got = e.where("tag <> 'null'").groupBy("level_path", "field").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.count("*").alias("rows"))
    is_ = lambda *t: F.size(F.array_except("tags", F.array(*map(F.lit, t)))) == 0
    return got.withColumn("spark_type", F.when(is_("int"), "bigint").when(is_("int", "float"), "double").when(is_("bool"), "boolean").otherwise("string"))


def child_table(flat: DataFrame, level_path: str) -> DataFrame:
    """The typed table of one array level: node_key, parent_key, ordinal and a column per scalar field. Names that differ
    only in case or clash with the keys get a number."""
    return typed(flat.where(F.col("level_path") == level_path), level_path)


def typed(part: DataFrame, what: str, *more: str) -> DataFrame:
    """The typed table of some levels' elements, with the columns `more`; a field has one type in all of them. Beyond MOST_FIELDS
    fields the rarer ones are in the map more_fields."""
    one = part.withColumn("level_path", F.lit(what))
    found = merged_schema(one).orderBy(F.col("rows").desc(), "field").select("field", "spark_type").limit(MOST_FIELDS + 1).collect()
    rows, beyond = found[:MOST_FIELDS], len(found) > MOST_FIELDS
    taken, cols = {"node_key", "parent_key", "ordinal", "doc_key", "more_fields", *more}, []
    for f, t in sorted(map(tuple, rows)):
        name, n = f.replace(".", "_"), 1
        while name.lower() in taken:
            n += 1
            name = f"{f.replace('.', '_')}_{n}"
        taken.add(name.lower())
        v = F.try_element_at("fields", F.lit(f))
        cols.append((v if t == "string" else v.try_cast(t)).alias(name))
    if beyond:
        cols.append(F.map_filter("fields", lambda k, v: ~k.isin([f for f, _ in rows])).alias("more_fields"))
    return part.select("doc_key", "node_key", "parent_key", "ordinal", *more, *cols)
