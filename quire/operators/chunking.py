"""Structure-aware chunking of Markdown with exact code-point, byte and grapheme coordinates.

A book is one row and its chunks depend on each other in order, so a book is cut by one function; books are independent
and run in parallel over Arrow batches. Offsets are code points into the text given."""

from __future__ import annotations

import bisect
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the store: widths of its columns and limits of its embedding model.
MOST_HEADING, MOST_PATH = 200, 512
MOST_POINTS, MODEL_POINTS = 8000, 8192
CARD_CHARS = 2000
SKIPPED = "目录"
# What counts as a heading, a fence and a chapter.
_HEADING = re.compile(r"^(#{1,6})\s*(.*?)\s*$")
_FENCE = re.compile(r"^\s*(?:`{3,}|~{3,})")
_CHAPTER = re.compile(r"^(?:第\s*[0-9一二三四五六七八九十百千零两]+\s*[篇部章]|part\s*\d+|chapter\s*\d+)", re.I)
_SENTENCE = re.compile(r"[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$")
_PUA = re.compile("[-\U000f0000-\U000ffffd\U00100000-\U0010fffd]")


#: by code point: 1 for visible characters, 0 for separators, controls, formats and surrogates, -1 while not looked up
_SEEN = np.full(sys.maxunicode + 1, -1, np.int8)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _visible(code: np.ndarray) -> np.ndarray:
    got = _SEEN[code]
    if (got < 0).any():
        for c in np.unique(code[got < 0]).tolist():
            k = unicodedata.category(chr(c))
            _SEEN[c] = not (k[0] == "Z" or k in ("Cc", "Cf", "Cs"))
        got = _SEEN[code]
    return got


#: characters that may share a grapheme with a neighbour
_JOINING = regex.compile(r"[\p{M}\r\u200d\u1100-\u11ff\ua960-\ua97f\uac00-\ud7ff\U0001f1e6-\U0001f1ff\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f\u0600-\u0605\u06dd\u070f\u0e33\u0eb3\u200c]")


def seen_len(s: str) -> int:
    return int(_visible(_codes(s)).sum())


class Text:
    """A text with running sums of visible characters and bytes, and its grapheme boundaries."""

    def __init__(self, text: str):
        self.text = text
        code = _codes(text)
        self.visible = np.concatenate(([0], np.cumsum(_visible(code), dtype=np.int64)))
        self.bytes = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), dtype=np.int64)))
        self.cells = [m.start() for m in regex.finditer(r"\X", text)] + [len(text)] if _JOINING.search(text) else range(len(text) + 1)

    def seen(self, a: int, n: int) -> int:
        """Visible characters among the `n` from `a`."""
        return int(self.visible[a + n] - self.visible[a])

    def reach(self, a: int, seen: int) -> int:
        """The farthest place that has at most `seen` visible characters since `a`."""
        return int(np.searchsorted(self.visible, self.visible[a] + seen, side="right")) - 1

    def floor(self, at: int) -> int:
        """The grapheme boundary at or before `at`."""
        return self.cells[bisect.bisect_right(self.cells, at) - 1]

    def graphemes(self, a: int, b: int) -> int:
        return bisect.bisect_left(self.cells, b) - bisect.bisect_left(self.cells, a)


@dataclass
class Section:
    heading: str
    chapter: bool
    start: int
    lines: list[str] = field(default_factory=list)

    @property
    def body(self) -> str:
        return "\n".join(self.lines).rstrip()


def clip(s: str, limit: int) -> str:
    return s if len(s) <= limit else s[: Text(s[: limit + 1]).floor(limit)]


def sections(text: str) -> list[Section]:
    """Text between headings outside fenced code; tables of contents are left out, empty sections stay for their chapter."""
    out: list[Section] = []
    at, fenced, skip, now = 0, False, False, None
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        head = None if fenced else _HEADING.match(line)
        if head:
            title = clip(head[2].strip(), MOST_HEADING)
            skip = title == SKIPPED
            now = None if skip else Section(title, bool(_CHAPTER.match(title)), at)
            if now:
                out.append(now)
        elif not skip and (line.strip() or (now and now.lines)):
            if now is None:
                now = Section("", False, at)
                out.append(now)
            if not now.lines:
                now.start = at
            now.lines.append(line)
        at += len(line) + 1
    return out


@dataclass
class Piece:
    path: str
    content: str
    start: int
    end: int


class Chunker:
    """Sizes are visible characters."""

    def __init__(self, target: int = 2000, most: int = 2500, least: int = 400, overlap: int = 300, merge_across_chapters: bool = True):
        self.target, self.most, self.least, self.overlap, self.across = target, most, least, overlap, merge_across_chapters

    def pieces(self, text: str) -> list[Piece]:
        return self._pieces(Text(text))

    def _pieces(self, t: Text) -> list[Piece]:
        text, out, held, chapter = t.text, [], [], ""

        def path(s: Section) -> str:
            if s.chapter or not s.heading:
                return s.heading or chapter
            return clip(f"{chapter} > {s.heading}" if chapter else s.heading, MOST_PATH)

        def flush() -> None:
            if held:
                where = path(held[0]) if len(held) == 1 else clip(chapter or held[0].heading, MOST_PATH)
                last = held[-1]
                out.append(Piece(where, "\n\n".join(s.body for s in held), held[0].start, last.start + len(last.body)))
                held.clear()

        size = 0
        for s in sections(text):
            n = t.seen(s.start, len(s.body))
            if s.chapter:
                flush()
                chapter = s.heading
            if not n:
                continue
            if n > self.most:
                flush()
                out += [Piece(path(s), c, a, b) for c, a, b in self.long(s.body, s.start, t)]
                continue
            if held and size + n > self.target:
                flush()
            size = n if not held else size + n
            held.append(s)
        flush()
        if len(out) > 1:
            a, b = out[-2:]
            same = self.across or a.path.split(" > ")[0] == b.path.split(" > ")[0]
            if 0 < seen_len(b.content) < self.least and seen_len(a.content) + seen_len(b.content) + 2 <= self.most and same:
                out[-2:] = [Piece(a.path, f"{a.content}\n\n{b.content}", a.start, b.end)]
        return out

    def units(self, body: str, start: int, t: Text) -> Iterator[tuple[int, int]]:
        """(from, to) of paragraphs, and of the parts of those that are too long."""
        at = start
        for para in body.split("\n\n"):
            bare = para.strip()
            if bare:
                a = at + len(para) - len(para.lstrip())
                if t.seen(a, len(bare)) > self.most or len(bare) > MOST_POINTS:
                    yield from self.giant(a, a + len(bare), t)
                else:
                    yield a, a + len(bare)
            at += len(para) + 2

    def giant(self, a: int, end: int, t: Text) -> Iterator[tuple[int, int]]:
        """Each part reaches to the last end of a sentence within the limits, which the running sums tell; a sentence beyond
        them is cut between graphemes."""
        ends = [m.end() for m in _SENTENCE.finditer(t.text, a, end)]
        i = 0
        while i < len(ends):
            j = bisect.bisect_right(ends, min(t.reach(a, self.most), a + MOST_POINTS), i)
            if j > i:
                yield a, ends[j - 1]
                a, i = ends[j - 1], j
                continue
            while a < ends[i]:
                b = min(int(np.searchsorted(t.visible, t.visible[a] + self.most)), a + MOST_POINTS, ends[i])
                b = b if b >= ends[i] else max(t.floor(b), a + 1)
                yield a, b
                a = b
            i += 1

    def long(self, body: str, start: int, t: Text) -> Iterator[tuple[str, int, int]]:
        """Units packed to the target: running sums over the units tell where a piece ends, and each begins with the last
        sentences of the one before where they fit."""
        units = list(self.units(body, start, t))
        # two for the empty line before each unit
        seen = [0, *accumulate(t.seen(a, b - a) + 2 for a, b in units)]
        points = [0, *accumulate(b - a + 2 for a, b in units)]
        i, lead = 0, None
        while i < len(units):
            n, m = (seen_len(lead[0]) + 2, len(lead[0]) + 2) if lead else (0, 0)
            j = max(i + 1, min(bisect.bisect_right(seen, seen[i] + self.target + 2 - n), bisect.bisect_right(points, points[i] + MOST_POINTS + 2 - m)) - 1)
            texts = [t.text[a:b] for a, b in units[i:j]]
            yield "\n\n".join([lead[0], *texts] if lead else texts), lead[1] if lead else units[i][0], units[j - 1][1]
            lead = self.tail(*units[j - 1], t)
            if j < len(units) and lead:
                a, b = units[j]
                lead = lead if seen_len(lead[0]) + t.seen(a, b - a) + 2 <= self.most and len(lead[0]) + b - a + 2 <= MOST_POINTS else None
            i = j

    def tail(self, where: int, end: int, t: Text) -> tuple[str, int] | None:
        """Whole sentences within the last `overlap` characters of a unit, mapped through its own offset."""
        if self.overlap <= 0:
            return None
        cut = max(where, end - self.overlap)
        if cut > where:
            m = re.compile(r"[。！？!?；;]").search(t.text, cut, end)
            if m and m.end() < end:
                cut = m.end()
        cut = t.floor(cut)
        text = t.text[cut:end]
        lead = len(text) - len(text.lstrip())
        return (text[lead:], cut + lead) if text.strip() else None

    def chunks(self, text: str) -> list[dict]:
        t, out = Text(text), []
        for i, p in enumerate(self._pieces(t), 1):
            content = _PUA.sub("�", p.content)
            if seen_len(content) > self.most or len(content) > MODEL_POINTS or not 0 <= p.start <= p.end <= len(text):
                raise ValueError(f"chunk {i} breaks its limits at {p.path!r}")
            out.append({
                "chunk_seq": i, "heading_path": p.path, "content": content, "char_start": p.start, "char_len": p.end - p.start,
                "visible_start": int(t.visible[p.start]), "visible_len": t.seen(p.start, p.end - p.start), "byte_start": int(t.bytes[p.start]),
                "byte_len": int(t.bytes[p.end] - t.bytes[p.start]), "grapheme_len": t.graphemes(p.start, p.end), "has_pua": content != p.content})
        return out


CHUNK = ("chunk_seq int, heading_path string, content string, char_start bigint, char_len int, visible_start bigint, visible_len int, byte_start bigint, "
         "byte_len int, grapheme_len int, has_pua boolean")


def chunk_books(books: DataFrame, key: str, text: str, chunker: Chunker | None = None) -> DataFrame:
    """`key` and the chunks of each text; chunk_id is derived from both, so a rerun gives the same ids."""
    kind, cutter = dict(books.dtypes)[key], chunker or Chunker()
    cols = [key, *(c.split()[0] for c in CHUNK.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{key: k, **c} for k, t in zip(b[key], b[text]) if t for c in cutter.chunks(t)]
            yield pd.DataFrame(rows, columns=cols)

    out = books.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"`{key}` {kind}, {CHUNK}")
    return out.withColumn("chunk_id", F.xxhash64(key, "chunk_seq"))


def book_card(title: Column, text: Column) -> Column:
    """The title and all headings, for the vector of a book; in the JVM."""
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]*(\S.*?)[ \t\r]*$"), 1)
    toc = F.array_join(F.filter(heads, lambda h: (h != SKIPPED) & (h != "")), "\n")
    return F.substring(F.when(toc != "", F.concat_ws("\n", title, toc)).otherwise(title), 1, CARD_CHARS)
