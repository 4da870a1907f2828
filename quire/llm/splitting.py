"""Items over a token limit cut into pieces at natural boundaries, with an overlap between consecutive pieces.

Every place between two tokens has a boundary strength: heading, turn of speech, paragraph, line, sentence, word, none.
A sparse table over the strengths answers for any window of permissible piece lengths which cut is the strongest, the
rightmost of equal ones; the next piece begins the overlap's tokens before the cut. Pieces are counted again as texts of
their own; if one is then over the limit, its window is shortened by the excess.

Defined results: null, empty and short texts have no pieces; a text without any boundary is cut between characters; a
cut never splits a character; only a single character of more tokens than the limit is over it; repeated rows are pieces of their own keys; extra columns are ignored; texts of any
length are processed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tokens import TOKENIZER, encoding, token_bytes

HEADING, TURN, PARAGRAPH, LINE, SENTENCE, WORD, NONE = 6, 5, 4, 3, 2, 1, 0
_RULES = (
    (WORD, re.compile(r"(?<=\s)(?=\S)")),
    (SENTENCE, re.compile(r"(?<=[.!?…;])[\"'»”’)\]]*\s+(?=\S)|[。！？；][」』”’）]*")),
    (LINE, re.compile(r"\n")),
    (PARAGRAPH, re.compile(r"\n[ \t\r]*\n+")),
    (TURN, re.compile(r"\n+(?=(?:\*\*)?(?:user|assistant|system|tool|human)(?:\*\*)?\s*[:：])", re.I)),
    (HEADING, re.compile(r"\n+(?=#{1,6}\s?\S|[^\n]{1,80}\n(?:={3,}|-{3,})\s*(?:\n|$)|(?:Chapter|Chapitre|Kapitel|Глава|Part)\s+\d+|第[\d一二三四五六七八九十百]+[章部篇节])")),
)


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each character, and after the last."""
    out = np.zeros(len(text) + 1, dtype=np.int8)
    for s, rule in _RULES:
        at = np.fromiter((m.end() for m in rule.finditer(text)), dtype=np.int64)
        out[at] = np.maximum(out[at], s)
    return out


class RangeMax:
    """The position of the greatest value in a range, the rightmost of equal ones."""

    def __init__(self, values: np.ndarray, longest: int | None = None):
        """`longest`: no range that is asked for is longer, so tables of longer ones aren't needed."""
        n = len(values)
        self.n, v = n, values.astype(np.int64) * (n + 1) + np.arange(n)
        self.rows = [v]
        k = 1
        while 2 * k <= min(n, longest or n):
            v = np.maximum(v[:-k], v[k:])
            self.rows.append(v)
            k *= 2

    def at(self, lo: int, hi: int) -> int:
        """In lo..hi inclusive."""
        j = (hi - lo + 1).bit_length() - 1
        row = self.rows[j]
        return int(max(row[lo], row[hi - (1 << j) + 1]) % (self.n + 1))


def pieces(text: str, limit: int, overlap: int, path: str, shortest: float = 0.5) -> list[tuple[int, int, int, int]]:
    """(char_start, char_end, tokens, strength of the cut at its end); [] if the text is within the limit."""
    e = encoding(path)
    ids = e.encode_ordinary(text)
    n = len(ids)
    if n <= limit:
        return []
    ends = np.concatenate(([0], np.cumsum(token_bytes(path)[np.asarray(ids)])))  # byte position of each cut
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64))))  # byte position of each character
    char = np.searchsorted(starts, ends)
    whole = starts[np.minimum(char, len(starts) - 1)] == ends
    s = np.where(whole, strengths(text)[np.minimum(char, len(text))], -1)
    table, out, a = RangeMax(s, limit + 1), [], 0
    while True:
        if n - a <= limit:
            m = len(e.encode_ordinary(text[char[a]:]))
            if m <= limit:
                out.append((int(char[a]), len(text), m, int(HEADING)))
                return out
        most = min(limit, n - a)
        while True:
            lo, hi = a + max(overlap + 1, int(most * shortest)), a + most
            b = table.at(min(lo, hi), hi)
            if s[b] < 0:  # no whole character within the window
                b = next((x for x in range(hi, a, -1) if whole[x]), hi)
            m = len(e.encode_ordinary(text[char[a] : char[b]]))
            if m <= limit:
                break
            most -= max(m - limit, 1)
            if most <= overlap + 2:
                # no window is left: the longest piece of whole characters within the limit, one character at least
                fits = (x for x in range(a + min(limit, n - a), a, -1) if whole[x] and char[x] > char[a] and len(e.encode_ordinary(text[char[a] : char[x]])) <= limit)
                b = next(fits, None) or next((x for x in range(a + 1, n + 1) if whole[x] and char[x] > char[a]), n)
                m = len(e.encode_ordinary(text[char[a] : char[b]]))
                break
        out.append((int(char[a]), int(char[b]), m, int(s[b])))
        if b >= n:
            return out
        nxt = b - overlap
        while nxt > a and not whole[nxt]:
            nxt -= 1
        a = nxt if nxt > a else b


def split_long(df: DataFrame, key: str, text: str, limit: int = 1024, overlap: int = 64, path: str = TOKENIZER) -> DataFrame:
    """`key`, piece, char_start, char_end, n_tokens, cut_strength, content. A token is at least one byte, so texts of at
    most `limit` bytes never reach Python."""
    kind = dict(df.dtypes)[key]
    cols = [key, "piece", "char_start", "char_end", "n_tokens", "cut_strength", "content"]
    kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in cols]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, (x, y, m, s) in enumerate(pieces(t, limit, overlap, path)):
                    for to, v in zip(out, (k, i, x, y, m, s, t[x:y])):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t or b.schema.field(0).type) for v, t in zip(out, kinds)], cols)

    long = df.select(key, text).where(F.octet_length(text) > limit)
    return long.mapInArrow(run, f"`{key}` {kind}, piece int, char_start bigint, char_end bigint, n_tokens int, cut_strength int, content string")
