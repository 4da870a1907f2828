"""The k most similar vectors of every vector (or of stated queries), exactly, by cosine similarity.

Block matrix join: vectors are packed into blocks of bounded size, one row each, that are written to the shared folder once;
each pair of blocks is one tile, and its task reads both there, so that no copies are shuffled or kept. Within a tile,
products in a few dimensions bound each similarity from above where `min_sim` is given, else (or where that leaves many
pairs) products of int8 codes give it with a bound on its quantisation error; only pairs whose upper bound reaches what is
needed (`min_sim`, or the k-th best lower bound of the row so far) are computed again in float and kept in a heap of k per row. A task merges the heaps of its tiles, and those of all tasks are merged by rank. Nothing is
broadcast. The work is quadratic by nature; memory and disk aren't.

Defined results: null, empty, all-zero vectors, those of another length or with NaN or infinite values take no part; of
a key's copies the earliest counts (then the smallest vector); similarities are compared at 7 decimals and ties go to the smaller key, so a collection of nothing but copies has
defined neighbours; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut

#: rows of a block: two blocks are held by one task
BLOCK = 32_768
_ROWS, _COLS, _PAIRS = 512, 4_096, 65_536
#: the same for products in fewer dimensions; what the share of pairs that these leave costs, in dimensions (parts without any are passed fast)
_SHORT_ROWS, _SHORT_COLS, _CHECK = 256, 1_024, 200_000
#: results that a task holds at least before it merges them
HEAP = 1 << 20
#: below every similarity
NO_BOUND = -2.0


def usable(df: DataFrame, key: str, vec: str, ts: str | None, dims: int) -> DataFrame:
    """id, v: one row per key with a usable vector."""
    v = F.col(vec)
    ok = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3.0e38)) & F.exists(v, lambda x: x != 0)
    one = df.where(F.col(key).isNotNull() & v.isNotNull()).where(ok).select(F.col(key).cast("bigint").alias("id"), (F.col(ts) if ts else F.lit(0)).alias("ts"), v.alias("v"))
    return one.groupBy("id").agg(F.min_by("v", F.struct("ts", "v")).alias("v"))


def blocks(df: DataFrame, dims: int, size: int, parts: int) -> DataFrame:
    """b, ids, vecs (packed int64 and float32): one row per block of about `size` of the rows id, v, in `parts` partitions at most.
    A partition of `df` is cut into even blocks, so nothing is moved for it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers are unique, not dense; they are odd in every other partition
        number, held, n = TaskContext.get().partitionId(), [], 0

        def block(rows: int) -> pa.RecordBatch:
            nonlocal number, held, n
            ids, vecs = (np.concatenate(z) for z in zip(*held))
            held, n = [(ids[rows:], vecs[rows:])], n - rows
            number += 1 << 32
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x[:rows].tobytes()], pa.binary()) for x in (ids, vecs))], ["b", "ids", "vecs"])

        for x in batches:
            held.append((x.column(0).to_numpy(), np.asarray(x.column(1).flatten(), dtype=np.float32).reshape(-1, dims)))
            n += x.num_rows
            while n >= 2 * size:
                yield block(size)
        # a little over the size isn't worth another block
        for left in range(1 + (n > 1.25 * size), 0, -1):
            if n:
                yield block(-(-n // left))

    return df.coalesce(parts).mapInArrow(pack, "b bigint, ids binary, vecs binary")


def _codes(x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes of `x` in steps of `scale`, and the length of what each row loses. Codes are held as float32 while the sums of
    their products stay exact in it (127 * 127 * dims below 2**24), else as float64."""
    q = np.rint(x / scale)
    lost = np.linalg.norm(x - q * scale, axis=1) + 1e-6
    return q.astype(np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64), lost


def _short(lv: np.ndarray, rv: np.ndarray, min_sim: float) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in fewer dimensions, so that no product is below that of the whole vectors of length 1 by more than rounding: the
    first main axes of `lv`, and the length of the rest. As many as are cheapest for the first rows, by how many pairs they leave."""
    axes = np.linalg.eigh(lv.T @ lv)[1][:, ::-1]

    def first(x: np.ndarray, m: int) -> np.ndarray:
        y = x @ axes
        return np.hstack([y[:, :m], np.linalg.norm(y[:, m:], axis=1, keepdims=True)]).astype(np.float32)

    def cost(m: int) -> float:
        return m + _CHECK * float(np.mean(first(lv[:_ROWS], m) @ first(rv[:_COLS], m).T >= min_sim))

    m = min(range(min(8, lv.shape[1]), lv.shape[1] + 1, 8), key=cost)
    return first(lv, m), first(rv, m)


def _best(row: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each row: greatest similarity, then smallest other."""
    order = np.lexsort((other, -sim, row))
    r = row[order]
    first = np.concatenate(([True], r[1:] != r[:-1])) if len(r) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0)) if len(r) else r
    return order[np.arange(len(r)) - start < k]


def tile(li: np.ndarray, lv: np.ndarray, ri: np.ndarray, rv: np.ndarray, k: int, min_sim: float | None, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, sim): the k best in `ri` of each of `li` and, with both, the k best in `li` of each of `ri`."""
    lv64, rv64 = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (lv.astype(np.float64), rv.astype(np.float64)))
    # one step for both sides, so the products compare as they are, without being scaled first
    scale = max(np.abs(lv64).max(initial=0), np.abs(rv64).max(initial=0)) / 127 or 1.0
    unit = scale * scale
    codes: list[tuple[np.ndarray, np.ndarray]] = []
    kept: list[tuple[np.ndarray, ...]] = []
    kth_l = np.full(len(li), NO_BOUND if min_sim is None else min_sim, dtype=np.float32)
    kth_r = np.full(len(ri), NO_BOUND if min_sim is None else min_sim, dtype=np.float32)
    # where each of `li` stands in `ri` (or -1): no row is its own neighbour, so its own product must not raise a bound either
    order = np.argsort(ri)
    at = order[np.minimum(np.searchsorted(ri, li, sorter=order), len(ri) - 1)] if len(ri) else np.zeros(len(li), np.int64)
    self_at = np.where(ri[at] == li, at, -1) if len(ri) else at - 1

    def raise_(kth: np.ndarray, start: int, part: np.ndarray, dense: np.ndarray, slack: float) -> None:
        """The k-th best lower bound within this part is a bound for the whole."""
        if len(dense) and part.shape[1] > k:
            low = np.partition(part[dense], part.shape[1] - k, axis=1)[:, part.shape[1] - k] * unit - slack
            kth[dense + start] = np.maximum(kth[dense + start], low)

    def many(rows: np.ndarray, n: int) -> np.ndarray:
        return np.flatnonzero(np.bincount(rows, minlength=n) > 4 * k)

    def look(r: np.ndarray, c: np.ndarray) -> None:
        """Pairs again in float64; the best are kept."""
        for p in range(0, len(r), _PAIRS):
            x, y = r[p : p + _PAIRS], c[p : p + _PAIRS]
            sim = np.round(np.einsum("ij,ij->i", lv64[x], rv64[y]), 7)
            go = sim >= (-np.inf if min_sim is None else min_sim)
            x, y, sim = li[x[go]], ri[y[go]], sim[go]
            i = _best(x, y, sim, k)
            kept.append((x[i], y[i], sim[i]))
            if both:
                i = _best(y, x, sim, k)
                kept.append((y[i], x[i], sim[i]))

    def look_few() -> None:
        r, c = (np.concatenate(z) for z in zip(*few))
        go = li[r] != ri[c]
        look(r[go], c[go])

    # what the products in fewer dimensions leave, of many parts at a time
    few: list[tuple[np.ndarray, np.ndarray]] = []
    n_few = 0
    short = min_sim is not None and len(li) > 0 and len(ri) > 0
    rows, cols = (_SHORT_ROWS, _SHORT_COLS) if short else (_ROWS, _COLS)
    if short:
        sl, sr = _short(lv64, rv64, min_sim)
    for a in range(0, len(li), rows):
        sa = slice(a, min(a + rows, len(li)))
        for b in range(0, len(ri), cols):
            sb = slice(b, min(b + cols, len(ri)))
            if short:
                # 1e-5: the products are float32
                at = np.flatnonzero((sl[sa] @ sr[sb].T).ravel() >= np.float32(min_sim - 1e-5))
                if len(at) <= rows * cols // 64:
                    r, c = np.divmod(at, sb.stop - b)
                    few.append((r + a, c + b))
                    n_few += len(r)
                    if n_few > _PAIRS:
                        look_few()
                        few, n_few = [], 0
                    continue
                # so many near copies that bounds by the k-th best are worth the whole products
            if not codes:
                codes += _codes(lv64, scale), _codes(rv64, scale)
            (ql, el), (qr, er) = codes
            s = ql[sa] @ qr[sb].T
            own = np.flatnonzero((self_at[sa] >= b) & (self_at[sa] < sb.stop))
            s[own, self_at[sa][own] - b] = -np.inf
            bound = el[sa].max() + er[sb].max() + el[sa].max() * er[sb].max()
            # rows without any bound get one first, else all of their cells would be candidates
            raise_(kth_l, a, s, np.flatnonzero(kth_l[sa] <= NO_BOUND), bound)
            if both:
                raise_(kth_r, b, s.T, np.flatnonzero(kth_r[sb] <= NO_BOUND), bound)
            base = min(kth_l[sa].min(), kth_r[sb].min()) if both else kth_l[sa].min()
            # 1e-6: thresholds are float32
            at = np.flatnonzero(s.ravel() >= (base - bound - 1e-6) / unit)
            if not len(at):
                continue
            r, c = np.divmod(at, s.shape[1])
            up = s.ravel()[at] * unit + bound + 1e-6
            raise_(kth_l, a, s, many(r[up >= kth_l[sa][r]], s.shape[0]), bound)
            want = up >= kth_l[sa][r]
            if both:
                raise_(kth_r, b, s.T, many(c[up >= kth_r[sb][c]], s.shape[1]), bound)
                want |= up >= kth_r[sb][c]
            r, c = r[want] + a, c[want] + b
            look(r, c)
    if few:
        look_few()
    if not kept:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0)
    row, other, sim = (np.concatenate(z) for z in zip(*kept))
    i = _best(row, other, sim, k)
    return row[i], other[i], sim[i]


def _near(stored: DataFrame, dims: int, n: int, min_sim: float) -> float:
    """About how many of all n rows reach `min_sim` with a row, from some 4,096 rows of the stored blocks."""
    step = max(1, n // _COLS)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for v in t.column(0):
                x = np.frombuffer(v.as_buffer(), dtype=np.float32).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([pa.array([x[::step].tobytes()], pa.binary())], ["vecs"])

    x = np.frombuffer(b"".join(r[0] for r in stored.select("vecs").mapInArrow(some, "vecs binary").collect()), dtype=np.float32).reshape(-1, dims).astype(np.float64)
    if len(x) < 2:
        return 0.0
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    pairs = sum(int((x[a : a + _ROWS] @ x.T >= min_sim).sum()) for a in range(0, len(x), _ROWS)) - len(x)
    return pairs / (len(x) * (len(x) - 1)) * n


def knn(df: DataFrame, key: str, vec: str, k: int = 10, dims: int = 64, ts: str | None = None, min_sim: float | None = None,
        queries: Column | None = None, block: int = BLOCK) -> DataFrame:
    """id, neighbour_id, cosine, rank. `queries`: a condition on column id; without it every vector is a query. With
    `min_sim` only neighbours of at least that similarity are listed."""
    spark = df.sparkSession
    n = df.count()
    cores = spark.sparkContext.defaultParallelism
    nb = max(1, math.ceil(n / block), min(math.ceil(math.sqrt(4 * cores)), n // 1024))
    size = max(1, math.ceil(n / nb))
    good = usable(df, key, vec, ts, dims)
    right = cut(blocks(good, dims, size, nb))
    # One tile for both sides has results of the right rows too, which its task can't merge: only where they are few in all
    both = queries is None and min_sim is not None and _near(right, dims, n, min_sim) <= 4 * k
    if right.rdd.getNumPartitions() < min(nb, math.ceil(math.sqrt(4 * cores))):
        # a small table, in fewer partitions than give every core a pair of them
        right = right.repartition(nb)
    left = right if queries is None else cut(blocks(good.where(queries), dims, size, nb))
    pair = F.lit(True)
    if both:
        # one of (x, y) and (y, x), in such a way that every block has about as many tiles
        pair = (F.col("r.b") == F.col("l.b")) | ((F.col("r.b") < F.col("l.b")) == ((F.col("r.b") + F.col("l.b")) % 2 != 0))
    # a task has one partition of the left blocks, and of the others as many as leave 4 tasks for each core, or 8 of which half have nothing to do
    runs = max(1, min(right.rdd.getNumPartitions(), math.ceil((8 if both else 4) * cores / max(1, left.rdd.getNumPartitions()))))
    sides = (right.coalesce(runs).alias("r").hint("shuffle_replicate_nl").join(left.alias("l"), pair)
             .select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("b", "ids", "vecs"))))
    kk, least, d, most = k, min_sim, dims, max(HEAP, 4 * size * k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def batch(got: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], ["id", "neighbour_id", "cosine"])

        for t in batches:
            for z in range(t.num_rows):
                lb, li, lv, rb, ri, rv = (c[z].as_py() if c.type == pa.int64() else c[z].as_buffer() for c in t.columns)
                li, ri = (np.frombuffer(x, dtype=np.int64) for x in (li, ri))
                lv, rv = (np.frombuffer(x, dtype=np.float32).reshape(-1, d) for x in (lv, rv))
                held.append(tile(li, lv, ri, rv, kk, least, both and lb != rb))
                n += len(held[-1][0])
                if n > most:
                    row, other, sim = (np.concatenate(x) for x in zip(*held))
                    i = _best(row, other, sim, kk)
                    held, n = [(row[i], other[i], sim[i])], len(i)
                    if n > most // 2:
                        yield batch(held[0])
                        held, n = [], 0
        if held:
            row, other, sim = (np.concatenate(x) for x in zip(*held))
            i = _best(row, other, sim, kk)
            yield batch((row[i], other[i], sim[i]))

    # a row is two blocks, so one row a batch; what the session says holds again afterwards, therefore the tiles are computed here
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        heaps = cut(sides.mapInArrow(run, "id bigint, neighbour_id bigint, cosine double"))
    finally:
        spark.conf.set(name, said)
    w = Window.partitionBy("id").orderBy(F.col("cosine").desc(), F.col("neighbour_id"))
    return heaps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """id_a < id_b: pairs in which each is a neighbour of the other."""
    pair = neighbours.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b"))
    return pair.groupBy("id_a", "id_b").agg(F.count("*").alias("n")).where("n = 2").select("id_a", "id_b")
