"""Passages of held-out items in a corpus, whole or in part and with some words altered.

Filter by the q-gram lemma: a passage of n words with e of them altered shares at least as many character q-grams with
its item as it has, less those that e words touch, and all of them lie in a narrow band of diagonals. Shared q-grams are
counted in overlapping bands for every document at once; what reaches the item's bound is verified by an alignment of
the words within that band. Letters alone form the q-grams, so punctuation, markup, spaces and line breaks don't matter;
Han items use shorter ones.

Defined results: null and blank documents or items leak nothing; repeated documents are reported each; an item text that
occurs twice is reported for each of its items; items are held in passes of a bounded number; texts are processed whole;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.glyphs import looks

#: items of one pass; their index is sent to every task
ITEMS_A_PASS = 20_000
Q, Q_HAN = 8, 4
_HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f"
_WORD = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+")
_MARKUP = re.compile(
    r"<!--.*?-->|</?[a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,6});|\]\([^()\s]+\)|\[\[[^\[\]|]*\||\\[a-zA-Z]+\*?", re.S)
_CUT = re.compile(r"(?<=[^\W\d_])[-¬]\s*\n\s*(?=[^\W\d_])")
_SIZE = 22
#: places of shared q-grams that are held at once
MOST_PLACES = 4_000_000


def words(text: str) -> list[str]:
    """Words in the form in which they are compared; each Han character is one."""
    text = looks(text, fold_case=True, merge=True)
    if "<" in text or "&" in text or "\\" in text or "[" in text:
        text = _MARKUP.sub(lambda m: "" if m[0][0] == "<" and m[0][1:2] in "!/bisueacBISUEACf" else " ", text)
    if "\n" in text:
        text = _CUT.sub("", text)
    return _WORD.findall(text)


def _grams(code: np.ndarray, q: int) -> np.ndarray:
    if len(code) < q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(code) - q + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[i : len(code) - q + 1 + i].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _codes(ws: list[str]) -> np.ndarray:
    return np.frombuffer("".join(ws).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _least_sum(x: np.ndarray, n: int) -> int:
    """The least sum of any n in a row."""
    c = np.concatenate(([0], np.cumsum(x)))
    return int((c[n:] - c[:-n]).min()) if n > 0 else 0


def _least_distinct(x: list, n: int) -> int:
    """The fewest distinct ones of any n in a row."""
    if n <= 0:
        return 0
    again, last = np.zeros(len(x) + 2, np.int64), {}
    for i, v in enumerate(x):
        j = last.get(v, -n)
        if i - j < n:  # counts once only where both lie in the window
            again[max(0, i - n + 1)] += 1
            again[j + 1] -= 1
        last[v] = i
    return n - int(np.cumsum(again)[: len(x) - n + 1].max())


def _budgets(n: int, share: float, rate: float) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(altered or dropped, added)]): lengths of passages of an item of n words, each with the most alterations that
    `repeats` accepts; added words count towards the length they are measured by. A passage of twice the least length or
    more has a part that is accepted too; of lengths with the same alterations the shortest is enough."""
    m = max(1, math.ceil(share * n - 1e-9))
    before = None
    for length in range(m, min(n, 2 * m - 1) + 1):
        most = [(int(rate * (length + i) + 1e-9) - i, i) for i in range(int(rate * length / (1 - rate) + 1e-9) + 1)] if rate < 1 else [(length, 0)]
        if most != before:
            yield length, most
        before = most


class Index:
    """q-grams of the items of one kind (Han or not), with each item's bound and band width."""

    def __init__(self, items: list[tuple[int, list[str]]], q: int, share: float, rate: float):
        self.q, self.items = q, items
        grams, item, place, need, width, length = [], [], [], [], [], []
        #: word pairs of each item, and how many of them any of its passages keeps: an altered word breaks two at most, an added one one (of triples three and two)
        self.pairs, self.keep, self.triples, self.keep3 = [], [], [], []
        #: where each word of an item begins
        self.begin: list[np.ndarray] = []
        for n, (_, ws) in enumerate(items):
            g = _grams(_codes(ws), q)
            grams.append(g)
            item.append(np.full(len(g), n))
            place.append(np.arange(len(g)))
            lens = np.array([len(w) for w in ws])
            self.begin.append(np.cumsum(lens) - lens)
            worst = np.concatenate(([0], np.cumsum(np.sort(lens)[::-1] + q - 1)))
            grid, grid3 = list(zip(ws, ws[1:])), list(zip(ws, ws[1:], ws[2:]))
            self.pairs.append(set(grid))
            self.triples.append(set(grid3))
            keep, keep3, least = [], [], []
            for m, most in _budgets(len(ws), share, rate):
                keep.append(_least_distinct(grid, m - 1) - max(2 * e + i for e, i in most))
                keep3.append(_least_distinct(grid3, m - 2) - max(3 * e + 2 * i for e, i in most))
                least.append(_least_sum(lens, m) - (q - 1) - max(int(worst[e]) + i * (q - 1) for e, i in most))
            self.keep.append(min(keep))
            self.keep3.append(min(keep3))
            need.append(max(1, min(least)))
            width.append(max(8, 2 * int(np.sort(lens)[::-1][: max(1, int(len(ws) * rate))].sum())))
            length.append(int(lens.sum()))
        self.need, self.width, self.length = np.array(need), np.array(width), np.array(length)
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.item, self.place = (np.concatenate(item)[order], np.concatenate(place)[order]) if len(g) else (g, g)
        self.grams, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << _SIZE, bool)
        self.bits[(self.grams >> np.uint64(64 - _SIZE)).astype(np.int64)] = True

    def _bands(self, at: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item and band as one number, q-grams shared in it), sorted. Frequent q-grams have many places: so many at a time
        that memory stays bounded, and the counts of all parts are added."""
        upto = np.cumsum(self.count[i])
        parts = []
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MOST_PLACES, side="right")))
            n = self.count[i[a:b]]
            post = np.repeat(self.first[i[a:b]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            item, diag = self.item[post], np.repeat(at[a:b], n) - self.place[post]
            parts.append(np.unique(item * (1 << 40) + (diag + self.length[item]) // self.width[item], return_counts=True))
            a = b
        if len(parts) == 1:
            return parts[0]
        key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)

    def regions(self, code: np.ndarray, valid: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, from, to): letter ranges that share enough q-grams with an item."""
        if not len(self.grams):
            return []
        g = _grams(code, self.q)
        at = np.flatnonzero(self.bits[(g >> np.uint64(64 - _SIZE)).astype(np.int64)] & valid[: len(g)])
        if not len(at):
            return []
        i = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        ok = self.grams[i] == g[at]
        at, i = at[ok], i[ok]
        if not len(at):
            return []
        k, hits = self._bands(at, i)
        both = hits + np.where(np.concatenate((k[1:] == k[:-1] + 1, [False])), np.concatenate((hits[1:], [0])), 0)
        out: list[tuple[int, int, int]] = []
        last = -2
        for key_ in k[both >= self.need[k >> 40]].tolist():
            it, b = key_ >> 40, key_ & ((1 << 40) - 1)
            w, n = int(self.width[it]), int(self.length[it])
            lo, hi = (b - 1) * w - n, (b + 3) * w
            # neighbouring bands are one region
            if key_ == last + 1:
                lo = out.pop()[1]
            out.append((it, lo, hi))
            last = key_
        return out


def repeats(item: list[int], doc: list[int], share: float, rate: float, first: np.ndarray | None = None, last: np.ndarray | None = None) -> float:
    """The share of the item's words covered by its longest passage in `doc` in which at most `rate` of the words are
    changed, dropped or added; banded local alignment: the item's word i meets the words first[i] to last[i] (exclusive) of
    `doc` alone, both of which never fall. Without a band it meets all."""
    a, b = np.asarray(item), np.asarray(doc)
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    first = np.zeros(n, np.int64) if first is None else first
    last = np.full(n, m) if last is None else last
    wide = max(1, int((last - first).max()))
    # row i + 1 holds cells (i, first[i] + x - 1); cells outside the band are 0, as if the alignment began behind them
    step = np.diff(first, prepend=first[0])
    H = np.zeros((n + 1, wide + 2 + int(step.max())), np.int16 if 2 * (n + m) < 30_000 else np.int32)
    cols = np.arange(wide + 1, dtype=H.dtype)
    for i in range(n):
        w, d = int(last[i] - first[i]), int(step[i])
        if w <= 0:
            continue
        same = (b[first[i] : last[i]] == a[i]).astype(H.dtype) * 3 - 1
        row = H[i + 1, 1 : w + 1]
        np.add(H[i, d : d + w], same, out=row)
        np.maximum(row, H[i, d + 1 : d + 1 + w] - 1, out=row)
        np.maximum(row, 0, out=row)
        row += cols[:w]
        np.maximum.accumulate(row, out=row)
        row -= cols[:w]
    i, x = np.unravel_index(int(H.argmax()), H.shape)
    bad, own = [], []  # altered?, words of the item
    while i and x and H[i, x] > 0:
        h, d, j = H[i, x], int(step[i - 1]), first[i - 1] + x - 1
        # (i - 1, j - 1) and (i - 1, j) stand at x + d - 1 and x + d of the row before
        if a[i - 1] == b[j] and h == H[i - 1, x + d - 1] + 2:
            bad.append(0), own.append(1)
            i, x = i - 1, x + d - 1
        elif h == H[i - 1, x + d - 1] - 1:
            bad.append(1), own.append(1)
            i, x = i - 1, x + d - 1
        elif h == H[i - 1, x + d] - 1:
            bad.append(1), own.append(1)
            i, x = i - 1, x + d
        else:
            bad.append(1), own.append(0)
            x -= 1
    if not bad:
        return 0.0
    p = np.concatenate(([0], np.cumsum(np.asarray(bad) - rate)))
    w = np.concatenate(([0], np.cumsum(own)))
    # the earliest start of each end whose words between them are altered by no more than the rate
    start = np.searchsorted(np.maximum.accumulate(p), p - 1e-9)
    return float((w - w[start]).max()) / n


def _texts(batch: list[tuple[object, str]], most: int = 3_000_000) -> Iterator[list[tuple[object, str]]]:
    part, n = [], 0
    for k, t in batch:
        part.append((k, t))
        n += len(t)
        if n > most:
            yield part
            part, n = [], 0
    if part:
        yield part


def _find(part, indexes: list[Index], ids: list[list[int]], share: float, rate: float):
    gap = max(ix.q for ix in indexes)
    ws = [words(t) for _, t in part]
    flat = [w for d in ws for w in (*d, "\0" * gap)]
    code = _codes(flat)
    lens = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(lens)
    doc_of = np.repeat(np.arange(len(part)), [len(d) + 1 for d in ws])
    valid = code != 0
    seen: dict[tuple[int, int, int], float] = {}
    for x, ix in enumerate(indexes):
        for it, lo, hi in ix.regions(code, valid):
            wa, wb = int(np.searchsorted(ends, max(lo, 0), side="right")), int(np.searchsorted(ends, min(hi, len(code)), side="left")) + 1
            wb = min(wb, len(flat))
            for d in range(int(doc_of[min(wa, len(doc_of) - 1)]), int(doc_of[wb - 1]) + 1):
                lo_w, hi_w = max(wa, int(np.searchsorted(doc_of, d))), min(wb, int(np.searchsorted(doc_of, d, side="right")) - 1)
                if seen.get((x, it, d), 0.0) >= share or hi_w - lo_w < share * (1 - rate) * len(ix.items[it][1]) * 0.9:
                    continue
                region, pairs = flat[lo_w:hi_w], ix.pairs[it]
                if len(pairs.intersection(zip(region, region[1:]))) < ix.keep[it]:
                    continue
                if len(ix.triples[it].intersection(zip(region, region[1:], region[2:]))) < ix.keep3[it]:
                    continue
                number: dict[str, int] = {}
                a = [number.setdefault(w, len(number)) for w in ix.items[it][1]]
                b = [number.get(w, -1) for w in region]
                # the band of diagonals in which the q-grams lie, in words
                begin, own = ends[lo_w:hi_w] - lens[lo_w:hi_w], ix.begin[it]
                first, last = np.searchsorted(begin, own + lo), np.searchsorted(begin, own + (hi - int(ix.length[it])), side="right")
                seen[x, it, d] = max(seen.get((x, it, d), 0.0), repeats(a, b, share, rate, first, last))
    return [(part[d][0], iid, s) for (x, it, d), s in seen.items() if s >= share for iid in ids[x][it]]


@lru_cache(maxsize=2)
def _build(rows: tuple, share: float, rate: float) -> tuple[list[Index], list[list[list]]]:
    """Indexes of the Han and the other items, with the ids of each distinct text; once per worker."""
    kinds: dict[bool, dict[tuple[str, ...], list]] = {True: {}, False: {}}
    for i, t in rows:
        w = words(t)
        if w:
            han = sum(len(x) == 1 and x > "⺀" for x in w) > len(w) / 2
            kinds[han].setdefault(tuple(w), []).append(i)
    indexes = [Index([(n, list(w)) for n, w in enumerate(kinds[h])], Q_HAN if h else Q, share, rate) for h in (True, False)]
    return indexes, [list(kinds[h].values()) for h in (True, False)]


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, share: float = 0.4, rate: float = 1 / 8) -> DataFrame:
    """doc_key, item_key, covered (share of the item's words in the passage)."""
    one = items.select(item_key, item_text).where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).distinct()
    passes = max(1, math.ceil(one.count() / ITEMS_A_PASS))
    out = None
    for p in range(passes):
        rows = one.where(F.pmod(F.xxhash64(item_key), F.lit(passes)) == p).orderBy(item_key).collect() if passes > 1 else one.orderBy(item_key).collect()
        got = _leaks(docs, doc_key, doc_text, [tuple(r) for r in rows], item_key, dict(items.dtypes)[item_key], share, rate)
        out = got if out is None else out.unionByName(got)
    return out.groupBy(doc_key, item_key).agg(F.max("covered").alias("covered"))


def _leaks(docs, doc_key, doc_text, rows, item_key, item_kind, share, rate) -> DataFrame:
    given = tuple(rows)
    schema = f"`{doc_key}` {dict(docs.dtypes)[doc_key]}, `{item_key}` {item_kind}, covered double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, ids = _build(given, share, rate)
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            found = [x for part in _texts([(k, t) for k, t in pairs if t]) for x in _find(part, indexes, ids, share, rate)]
            k, i, s = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, b.schema.field(0).type), pa.array(i, kind), pa.array(s, pa.float64())], [doc_key, item_key, "covered"])

    kind = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    return docs.select(doc_key, doc_text).where(F.col(doc_key).isNotNull() & F.col(doc_text).isNotNull()).mapInArrow(run, schema)
