"""Schemas that drift between JSON files: tagged-union inference, alias resolution and change reports.

`shapes` parses every file once and writes, per object path, the signature (field names in order with tagged types) of
its objects; `fuse` unions all parallel signatures. `new_names` goes down a declared shape level by level and counts, over
the fused signatures, which unknown names stand for a declared field; `drift` compares each file's signatures with the
shape under those names. Signatures stay in Spark, however many there are; the driver holds the new names alone.

Defined results: null and unreadable texts are no files (a file counts if one of its copies can be read; of several
readable copies every departure counts once, while tables take the earliest, then the one of the smallest hash); depth
has no limit; an empty table gives no rows; a file of `{}` lacks each required top field; null as a value is another
type; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from json.decoder import scanstring

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import bounded_rows, cut

#: more new names of declared fields than any family of files has
MOST_NAMES = 200_000


def tag(v) -> str:
    """The tagged type of a value; of lists with the sorted types of their elements."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, str):
        return "str"
    if isinstance(v, list):
        return "list<" + ",".join(sorted({tag(x) if not isinstance(x, list) else "list" for x in v})) + ">"
    return "obj"


def load(raw: str | None):
    """The parsed object, or None where there is none."""
    if raw is None:
        return None
    try:
        d = json.loads(raw)
    except RecursionError:
        d = deep(raw)
    except ValueError:
        return None
    return d if isinstance(d, dict) else None


_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?|true|false|null|NaN|-?Infinity", re.A)
_NAMED = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def deep(raw: str):
    """JSON nested too deep for the recursive parser; None where it isn't JSON."""
    top: list = []
    stack: list = [top]
    key, at, want = None, 0, "value"
    try:
        while True:
            at = _SPACE.match(raw, at).end()
            here, c = stack[-1], raw[at : at + 1]
            if want == "next":
                if here is top:
                    return top[0] if at == len(raw) else None
                if c == ",":
                    want = "key" if isinstance(here, dict) else "value"
                elif c == ("}" if isinstance(here, dict) else "]"):
                    stack.pop()
                else:
                    return None
                at += 1
            elif want in ("key", "key or end"):
                if c == "}" and want == "key or end":
                    stack.pop()
                    at, want = at + 1, "next"
                    continue
                if c != '"':
                    return None
                key, at = scanstring(raw, at + 1)
                at = _SPACE.match(raw, at).end()
                if raw[at : at + 1] != ":":
                    return None
                at, want = at + 1, "value"
            elif c == "]" and want == "value or end":
                stack.pop()
                at, want = at + 1, "next"
            else:
                if c == '"':
                    v, at = scanstring(raw, at + 1)
                    then = "next"
                elif c in ("{", "[") and c:
                    v, at, then = ({} if c == "{" else []), at + 1, "key or end" if c == "{" else "value or end"
                else:
                    m = _ATOM.match(raw, at)
                    if not m:
                        return None
                    v = _NAMED[m[0]] if m[0] in _NAMED else float(m[0]) if m[1] or m[2] else int(m[0])
                    at, then = m.end(), "next"
                if isinstance(here, dict):
                    here[key] = v
                else:
                    here.append(v)
                if then != "next":
                    stack.append(v)
                want = then
    except ValueError:
        return None


def one_copy(df: DataFrame, key: str, raw: str, order: str | None = None) -> DataFrame:
    """_key, _raw for `first_readable`: exact copies of a document are one, what is left of it stands together, the earliest by
    `order` first. Copies are told by their hash before they are moved, so a file copied often is one row."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    one = df.select(F.col(key).alias("_key"), (F.col(order) if order else F.lit(0)).alias("_at"), F.col(raw).alias("_raw")).where("_key is not null and _raw is not null")
    own = one.groupBy("_key", F.xxhash64("_raw").alias("_hash"), F.length("_raw").alias("_len")).agg(F.min("_at").alias("_at"), F.first("_raw").alias("_raw"))
    return own.repartition(n, "_key").sortWithinPartitions("_key", "_at", "_hash").select("_key", "_raw")


def first_readable(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict]]:
    """(key, parsed) of the first readable copy of each document, as `one_copy` orders them."""
    last = None
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != last and (d := load(raw)) is not None:
                last = k
                yield k, d


@dataclass
class Shape:
    """A declared object: accepted tags per field; `sub` are shapes of object fields or of the objects in a list."""

    required: dict[str, set[str]] = field(default_factory=dict)
    optional: dict[str, set[str]] = field(default_factory=dict)
    sub: dict[str, "Shape"] = field(default_factory=dict)

    @property
    def known(self) -> dict[str, set[str]]:
        return self.required | self.optional


def _walk(v, path: str, depth: int | None, out: Counter) -> None:
    """An explicit stack, so depth costs no recursion; without a limit lists within lists are entered too."""
    stack = [(v, path, depth)]
    while stack:
        v, path, left = stack.pop()
        if isinstance(v, list):
            stack += [(e, path + "[]", left) for e in v if isinstance(e, (dict, list))]
            continue
        out[path, json.dumps([[k, tag(x)] for k, x in v.items()], ensure_ascii=False)] += 1
        if left == 0:
            continue
        below = None if left is None else left - 1
        for k, x in v.items():
            p = f"{path}.{k}" if path else k
            if isinstance(x, dict):
                stack.append((x, p, below))
            elif isinstance(x, list):
                stack += [(e, p + "[]", below) for e in x if isinstance(e, dict) or (left is None and isinstance(e, list))]


def shapes(df: DataFrame, key: str, raw: str, depth: int | None = 3) -> DataFrame:
    """key, path, signature, objects: the signatures of each readable file's objects, down to `depth` levels below the
    root, or all of them (None)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b[key], b[raw]):
                d = load(text)
                if d is not None:
                    out: Counter = Counter()
                    _walk(d, "", depth, out)
                    rows += [(k, p, s, n) for (p, s), n in out.items()]
            yield pd.DataFrame(rows, columns=[key, "path", "signature", "objects"])

    kind = dict(df.dtypes)[key]
    return df.select(key, raw).where(F.col(raw).isNotNull() & F.col(key).isNotNull()).mapInPandas(
        run, f"{key} {kind}, path string, signature string, objects bigint")


def fuse(found: DataFrame) -> DataFrame:
    """The union of all signatures: path, signature, objects, files."""
    return found.groupBy("path", "signature").agg(F.sum("objects").alias("objects"), F.count("*").alias("files"))


def fused_schema(found: DataFrame) -> DataFrame:
    """The merged schema as tagged unions: path, field, alternatives (each tag with the objects that have it), branches
    (columns the field splits into where its alternatives conflict), canonical type."""
    one = found.select("path", "objects", F.explode(F.from_json("signature", "array<array<string>>")).alias("f")).select(
        "path", F.col("f")[0].alias("field"), F.col("f")[1].alias("tag"), "objects")
    per = one.groupBy("path", "field", "tag").agg(F.sum("objects").alias("objects"))
    alts = per.groupBy("path", "field").agg(F.array_sort(F.collect_list(F.struct("tag", "objects"))).alias("alternatives"))
    tags = F.array_distinct(F.transform("alternatives", lambda a: F.when(a["tag"].startswith("list"), "list").otherwise(a["tag"])))
    tags = F.filter(tags, lambda t: t != "null")
    wide = F.when(F.array_contains(tags, "float") & (F.size(F.array_except(tags, F.array(F.lit("int"), F.lit("float")))) == 0), F.array(F.lit("float"))).otherwise(tags)
    return alts.withColumn("branches", F.when(F.size(wide) > 1, F.transform(wide, lambda t: F.concat_ws("__", "field", t))).otherwise(F.array("field"))).withColumn(
        "canonical_type", F.array_max(F.transform("alternatives", lambda a: F.struct(a["objects"].alias("n"), a["tag"].alias("t"))))["t"])


def _fits(t: str, want: set[str]) -> bool:
    return t in want


def _class(t: str) -> str:
    return "list" if t.startswith("list") else "num" if t in ("int", "float") else t


@lru_cache(maxsize=100_000)
def _fields(signature: str) -> list:
    return json.loads(signature)


def _join(p: str, f: str) -> str:
    return f"{p}.{f}" if p else f


_CANDIDATE = "at string, name string, field string, required boolean, objects bigint, beside bigint, fits bigint, placed bigint"


def candidates(fused: DataFrame, nodes: dict[str, tuple[str, Shape]]) -> DataFrame:
    """Unknown names of the objects on the paths `nodes` that stand for a declared field: they never occur beside it, are of
    its type and at its place in the order of keys. at, name, field, required, share (of objects in which it is at that place)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text, n in zip(b["path"], b["signature"], b["objects"]):
                if path not in nodes:
                    continue
                at, shape = nodes[path]
                sig, known = _fields(text), shape.known
                names, order = [k for k, _ in sig], list(known)
                for i, (k, t) in enumerate(sig):
                    if k in known:
                        continue
                    before = next((x for x in reversed(names[:i]) if x in known), None)
                    for j, m in enumerate(order):
                        beside = m in names
                        placed = not beside and before == next((x for x in reversed(order[:j]) if x in names), None)
                        rows.append((at, k, m, m in shape.required, n, n * beside, n * _fits(t, known[m]), n * placed))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CANDIDATE.split(", ")])

    got = fused.select("path", "signature", "objects").mapInPandas(run, _CANDIDATE).groupBy("at", "name", "field", "required").agg(
        *[F.sum(c).alias(c) for c in ("objects", "beside", "fits", "placed")])
    return got.where("beside = 0 and fits >= 0.9 * objects and placed >= 0.5 * objects").select("at", "name", "field", "required", (F.col("placed") / F.col("objects")).alias("share"))


def new_names(fused: DataFrame, shape: Shape) -> tuple[dict[str, dict[str, str]], dict[str, tuple[str, Shape]]]:
    """(new names of declared fields by canonical object path; canonical path and shape of each path that files use)."""
    aliases: dict[str, dict[str, str]] = {}
    nodes: dict[str, tuple[str, Shape]] = {}
    level = {"": ("", shape)}
    while level:
        nodes |= level
        aliases |= {at: {} for at, _ in level.values()}
        # the best field of each name first
        for at, name, to, _, _ in sorted(map(tuple, bounded_rows(candidates(fused, level), MOST_NAMES, "new names of fields")), key=lambda c: (c[0], c[1], -c[4], not c[3], c[2])):
            aliases[at].setdefault(name, to)
        level = {_join(p, k) + ("[]" if any(t.startswith("list") for t in s.known[m]) else ""): (below(at, m, s), inner)
                 for p, (at, s) in level.items() for m, inner in s.sub.items() for k in (m, *(x for x, to in aliases[at].items() if to == m))}
    return aliases, nodes


def changes(signature: str, at: str, shape: Shape, alias: dict[str, str]) -> list[tuple[str, str]]:
    """(field_path, change_kind) of the objects of one signature."""
    sig, known = _fields(signature), shape.known
    names = {k for k, _ in sig}
    out, have = [], set()
    for k, t in sig:
        m = k if k in known else alias.get(k)
        if m is None or (m != k and m in names):
            out.append((_join(at, k), "added"))
            continue
        have.add(m)
        if m != k:
            out.append((_join(at, m), "renamed"))
        if not _fits(t, known[m]):
            out.append((_join(at, m), "retyped"))
    return out + [(_join(at, m), "missing") for m in shape.required if m not in have]


def drift(df: DataFrame, key: str, raw: str, shape: Shape, depth: int = 3) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """(changes, new names by object path): changes has `key`, field_path, change_kind, one row each. `depth`: how many
    levels below the root the shape has."""
    found = cut(shapes(df, key, raw, depth))
    # read once for each level of the shape; what is lost of it is made again from the signatures
    fused = fuse(found).persist()
    aliases, nodes = new_names(fused, shape)
    fused.unpersist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for b in batches:
            rows = []
            for i, (p, sig) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if p in nodes:
                    if (p, sig) not in told:
                        if len(told) > 100_000:
                            told.clear()
                        told[p, sig] = changes(sig, *nodes[p], aliases[nodes[p][0]])
                    rows += [(i, f, k) for f, k in told[p, sig]]
            at, f, k = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(f, pa.string()), pa.array(k, pa.string())], [key, "field_path", "change_kind"])

    kind = dict(df.dtypes)[key]
    return found.select(key, "path", "signature").mapInArrow(run, f"`{key}` {kind}, field_path string, change_kind string").distinct(), aliases


def value(obj: dict, name: str, alias: dict[str, str]):
    """(name in the file, value) of a declared field under its own or a new name."""
    if name in obj:
        return name, obj[name]
    for k, m in alias.items():
        if m == name and k in obj:
            return k, obj[k]
    return None, None


def numbers(v) -> list[float] | None:
    """Canonical conversion of a box: a list of numbers or of digits, comma-joined text, or an object of corners."""
    try:
        if isinstance(v, dict):
            v = [v[k] for k in ("x0", "y0", "x1", "y1")]
        elif isinstance(v, str):
            v = v.split(",")
        return [float(x) for x in v] if isinstance(v, list) else None
    except (KeyError, TypeError, ValueError, OverflowError):
        return None


def whole(v) -> int | None:
    try:
        n = None if v is None else int(v)
    except (TypeError, ValueError, OverflowError):
        return None
    return n if n is not None and -(2**63) <= n < 2**63 else None


def flag(v) -> bool | None:
    """Canonical conversion of a truth value: itself, 0 or 1, or their names."""
    return {"true": True, "1": True, "1.0": True, "false": False, "0": False, "0.0": False}.get(str(v).strip().lower())


def label(v) -> str | None:
    """Canonical conversion of a name: itself, the only element of a list, or an object's name; else its JSON text."""
    if isinstance(v, list) and v:
        v = v[0]
    if isinstance(v, dict):
        v = v.get("name")
    return v if v is None or isinstance(v, str) else json.dumps(v)


def names(v) -> list[str | None] | None:
    """Canonical conversion of a list of names; one alone is a list of one."""
    return None if v is None else [label(x) for x in (v if isinstance(v, list) else [v])]


def text(v) -> str:
    """JSON; with escapes where it has halves of surrogate pairs."""
    try:
        s = json.dumps(v, ensure_ascii=False, sort_keys=True)
        return s if s.isascii() or not any("\ud800" <= c <= "\udfff" for c in s) else json.dumps(v, sort_keys=True)
    except RecursionError:
        return deep_text(v)


def deep_text(v) -> str:
    """JSON of what is nested too deep for the recursive writer."""
    out: list[str] = []
    todo: list = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, _Written):
            out.append(x)
        elif isinstance(x, (dict, list)):
            pairs = sorted(x.items()) if isinstance(x, dict) else [(None, e) for e in x]
            out.append("{" if isinstance(x, dict) else "[")
            todo.append(_Written("}" if isinstance(x, dict) else "]"))
            for i, (k, e) in enumerate(reversed(pairs)):
                todo += [e, _Written((", " if i < len(pairs) - 1 else "") + ("" if k is None else json.dumps(k) + ": "))]
        else:
            out.append(json.dumps(x))
    return "".join(out)


class _Written(str):
    """Text that is written already."""


def kind(want: set[str]):
    """(column type, conversion) of a declared field; None as conversion: nested, held as JSON."""
    if want <= {"str"}:
        return pa.string(), label
    if want <= {"int"}:
        return pa.int64(), whole
    if want <= {"bool"}:
        return pa.bool_(), flag
    if want <= {"list<int>", "list<float>", "list<float,int>", "list<>"} and want != {"list<>"}:
        return pa.list_(pa.float64()), numbers
    if want <= {"list<str>", "list<>"} and want != {"list<>"}:
        return pa.list_(pa.string()), names
    return pa.string(), None


def tidy(v, shape: Shape | None, where: str, aliases: dict[str, dict[str, str]]):
    """A nested value with the declared names and types; what was of another type also stays, as `field__type`."""
    if shape is None:
        return v
    if isinstance(v, list):
        return [tidy(x, shape, where, aliases) if isinstance(x, dict) else x for x in v]
    if not isinstance(v, dict):
        return v
    out, meant = {}, {k: m for m in shape.known if (k := value(v, m, aliases.get(where, {}))[0])}
    for k, x in v.items():
        m = meant.get(k)
        if m is None:
            out[k] = x
            continue
        to = kind(shape.known[m])[1]
        got = to(x) if to else tidy(x, shape.sub.get(m), below(where, m, shape), aliases)
        out[m] = x if got is None else got
        if tag(x) not in shape.known[m]:
            out[f"{m}__{tag(x).split('<')[0]}"] = x
    return out


def below(where: str, name: str, shape: Shape) -> str:
    """The path of the objects in a declared field."""
    return (f"{where}.{name}" if where else name) + ("[]" if any(t.startswith("list") for t in shape.known[name]) else "")


def declared(shape: Shape, skip: set[str], at: str = "") -> dict[str, set[str]]:
    """Dotted names of the fields that become columns: those of declared objects each for itself."""
    out: dict[str, set[str]] = {}
    for m, want in shape.known.items():
        if m in shape.sub and want == {"obj"}:
            out |= declared(shape.sub[m], set(), f"{at}{m}.")
        elif m not in skip:
            out[at + m] = want
    return out


def read(obj: dict, shape: Shape, where: str, aliases: dict[str, dict[str, str]], skip: set[str], at: str = "") -> tuple[dict, dict, dict]:
    """(converted values, values of another type, unknown fields) of an object, by dotted name. `skip`: fields whose
    objects have rows of their own."""
    out, odd, used = {}, {}, set()
    extra: dict = {}
    for m, want in shape.known.items():
        k, v = value(obj, m, aliases.get(where, {}))
        if not k:
            continue
        used.add(k)
        if tag(v) not in want:
            odd[f"{at}{m}__{tag(v).split('<')[0]}"] = v
        if m in shape.sub and want == {"obj"}:
            if isinstance(v, dict):
                for to, x in zip((out, odd, extra), read(v, shape.sub[m], below(where, m, shape), aliases, set(), f"{at}{m}.")):
                    to.update(x)
        elif m not in skip:
            to = kind(want)[1]
            out[at + m] = to(v) if to else text(tidy(v, shape.sub.get(m), below(where, m, shape), aliases))
            if out[at + m] is None and v is not None:
                odd[f"{at}{m}__{tag(v).split('<')[0]}"] = v
    extra |= {at + k: v for k, v in obj.items() if k not in used}
    return out, odd, extra


#: names of columns that say more than the field's
_RENAMED = {"type": "block_type", "index": "block_index"}


def canonical_table(df: DataFrame, shape: Shape, aliases: dict[str, dict[str, str]], pages: str) -> DataFrame:
    """One consistent table of all that a kind of file holds: a row for each file, page and block that lies directly in a
    page (`part`), whatever its file calls the fields, and a column for each declared field. Values are converted to the
    canonical type, nested ones are JSON under the declared names; a value of another type also stays as it was, as the
    branch `field__type` in typed_branches; unknown fields are in extra."""
    page = shape.sub[pages]
    where = f"{pages}[]"
    blocks = {m: want for s in page.sub.values() for m, want in declared(s, set()).items()}
    wants = {("file", m): w for m, w in declared(shape, {pages}).items()} | {("page", m): w for m, w in declared(page, set(page.sub)).items()} | {
        ("block", m): w for m, w in blocks.items()}
    taken = Counter(m for _, m in wants)
    name = {(p, m): (f"{p}_{m}" if taken[m] > 1 else _RENAMED.get(m, m) if p == "block" else m).replace(".", "_") for p, m in wants}
    schema = pa.schema([("file_id", pa.int64()), ("part", pa.string()), ("page_pos", pa.int32()), ("branch", pa.string()), ("block_pos", pa.int32()),
                        *((name[x], kind(w)[0]) for x, w in wants.items()), ("typed_branches", pa.string()), ("extra", pa.string())])
    ddl = ", ".join(f"`{f.name}` {_DDL[f.type]}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def put(fid, part, pp, branch, i, obj, s, at, skip):
            got, odd, extra = read(obj, s, at, aliases, skip)
            rows.append({"file_id": fid, "part": part, "page_pos": pp, "branch": branch, "block_pos": i, "typed_branches": text(odd), "extra": text(extra)}
                        | {name[part, m]: valid(v) for m, v in got.items()})

        for fid, d in first_readable(batches):
            put(fid, "file", None, None, None, d, shape, "", {pages})
            listed = value(d, pages, aliases.get("", {}))[1]
            for pp, pg in enumerate(listed if isinstance(listed, list) else []):
                if not isinstance(pg, dict):
                    continue
                put(fid, "page", pp, None, None, pg, page, where, set(page.sub))
                for branch, s in page.sub.items():
                    found = value(pg, branch, aliases.get(where, {}))[1]
                    for i, blk in enumerate(found if isinstance(found, list) else []):
                        if isinstance(blk, dict):
                            put(fid, "block", pp, branch, i, blk, s, f"{where}.{branch}[]", set())
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows.clear()
        yield pa.RecordBatch.from_pylist(rows, schema)

    return one_copy(df.withColumn("file_id", F.col("file_id").cast("bigint")), "file_id", "raw", "produced_at" if "produced_at" in df.columns else None).mapInArrow(run, ddl)


_DDL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean", pa.list_(pa.float64()): "array<double>", pa.list_(pa.string()): "array<string>"}


def valid(v):
    """Text without halves of surrogate pairs, which no column can hold."""
    if isinstance(v, str):
        return v if v.isascii() else v.encode("utf-8", "replace").decode()
    return [valid(x) for x in v] if isinstance(v, list) else v


def canonical_blocks(df: DataFrame, shape: Shape, aliases: dict[str, dict[str, str]], pages: str) -> DataFrame:
    """The blocks of `canonical_table` with the columns that blocks have."""
    own = {m for s in shape.sub[pages].sub.values() for m in declared(s, set())}
    all_ = canonical_table(df, shape, aliases, pages).where("part = 'block'")
    ways = {c for m in own for c in (_RENAMED.get(m, m), f"block_{m}") for c in (c.replace(".", "_"),)}
    return all_.select("file_id", "page_pos", "branch", "block_pos", *(c for c in all_.columns if c in ways), "typed_branches", "extra")
