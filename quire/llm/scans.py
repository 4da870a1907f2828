"""Noise in text from scanned pages: cut words, misread characters, running lines and page numbers.

`facts` reads each text once and emits what the corpus has to decide: word counts, words cut at a line end (with their
joined and hyphenated forms), lines that may be running lines (as a fuzzy key that forgives case, numbers and misread
characters, and whether they stand at a page's edge) and page-number lines with their values. Running lines are those
whose key repeats: at the edges of several pages of its book, or at an edge and as the book's title or a chapter's
heading. Page numbers form sequences that run with the pages of their book; a line outside of one must have the form of
a page number and stand alone. A cut word is joined if the corpus knows the joined form better than the hyphenated one. A
word is misread if undoing usual confusions of characters gives a word the corpus has far more often. `repair` then
rewrites each text into continuous paragraphs.

Defined results: null and blank texts have no noise and stay as they are; headings as given by the caller are no running
lines; a misread word in a running line is part of that line's noise; repeated rows are one case; a column of figures is no page number unless it runs with the pages; where the place of
a text on its page is unknown, its edges are its ends and both sides of a page number; an empty table gives no rows;
texts are processed whole; columns beyond those named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.glyphs import SMALL, looks
from quire.session import cut

# Usual confusions of character recognition, as (seen, meant).
CONFUSED = (
    ("c", "e"), ("f", "t"), ("1", "i"), ("1", "l"), ("0", "o"), ("5", "s"), ("b", "h"), ("9", "g"), ("ri", "n"), ("cl", "d"), ("ii", "u"),
    ("rn", "m"), ("vv", "w"), ("6", "é"), ("8", "b"), ("6", "b"), ("n", "ri"), ("m", "rn"), ("d", "cl"), ("e", "c"), ("t", "f"), ("h", "b"),
    ("0", "о"), ("3", "з"), ("6", "б"), ("п", "н"), ("л", "п"), ("н", "п"), ("п", "л"), ("й", "и"), ("и", "й"), ("ш", "щ"), ("щ", "ш"),
)
# Accented Latin vowels that stand in Cyrillic words for the plain ones.
ACCENTED = (("é", "e"), ("ó", "o"), ("á", "a"), ("è", "e"), ("ò", "o"), ("à", "a"), ("ý", "y"))
#: the better known form must be so much more frequent than the misread one
TIMES_MORE = 8
#: distinct misread words that are sent to every task; beyond it they are found by a join
MOST_SENT = 500_000
_HAN = "㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[^\W_{_HAN}]+(?:[-'’][^\W_{_HAN}]+)*")
_PART = re.compile(rf"[^\W_{_HAN}]+")
_STRIP = re.compile(
    r"(?:^|\n)[ \t>]*(`{3,}|~{3,})[^\n]*\n.*?(?:\n[ \t>]*\1[^\n]*|\Z)|<!--.*?-->|</?[a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,8}|#x?[0-9a-fA-F]{1,6});|\]\([^()\s]*\)|"
    r"\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]*\\[^$\n]*\$|\\begin\{equation\}.*?\\end\{equation\}|\{\{.*?\}\}|\\cite\{[^}]*\}|\\[a-zA-Z]+\*?|`[^`\n]+`", re.S)
_END = re.compile(rf"([^\W\d_{_HAN}]+)([-‐‑¬­])[ \t]*$")
_CUTS = frozenset("-‐‑¬\xad")
_BEGIN = re.compile(rf"^[ \t]*([^\W\d_{_HAN}]+)")
_SOFT = re.compile("\xad(?=[ \t]*\n)")
_SIGNS = re.compile(r"[<&\\$`{]|\]\(|~~~")
_CUT_END = re.compile("[-‐‑¬­][ \t]*\n")
_BROKEN = re.compile(rf"[^\W_{_HAN}]+[-‐‑¬­][ \t]*\n\s*[^\W_{_HAN}]+")
_SIGN = "-–—−‐~·•|*_<>[]()（）【】"
_PAGE = re.compile(
    rf"(?:(?:page|pages|pg|p|pp|s|seite|стр|с|страница|pag|página|第)\.?[{re.escape(_SIGN)} ]*)?(?:((?=[Ool]*\d)[\dOol]+)|([ivxlIVXL]+)) ?(?:页|頁)?"
    r"(?: ?(?:of|/|von|из|sur|de|共) ?\d+ ?(?:页|頁)?)?", re.I)
_ROMAN = re.compile(r"^(?:x{1,3}|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
_CHAPTER = re.compile(r"^\W*(?:(?:chapter|chapitre|kapitel|глава|part|partie|teil|часть)\s+(?:\d+|[ivxl]+)\b|第\s*[\d一二三四五六七八九十百]+\s*[章部篇节])[\s.:：—-]*", re.I)
_LEAD = re.compile(r"^\W*(?:\d{1,4})(?=\s*[|·•—–\-:]|\s)[\s|·•—–\-:]*")
_TAIL = re.compile(r"[\s|·•—–\-:]+(?:\d{1,4})\W*$")
_MARKED = re.compile(r"^\s*(?:#|<|\\|==|\||>|\*|\{|```|!\[|\[\[)")
_STOP = ".。!?！？;；,，、:：…"


_FIGURES = str.maketrans("Ool", "001")
_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50}


def page_number(line: str) -> tuple[int, bool] | None:
    """(value, short) of a line that is nothing but a page number in whatever form. Numbers of more than four figures are
    page numbers only in a sequence."""
    x = line.strip()
    if x[-1:] in ".,:;":
        return None
    m = _PAGE.fullmatch(" ".join(x.strip(_SIGN + " \t\r\f\v\xa0\u3000").split()))
    if not m:
        return None
    if m[1]:
        return (int(m[1].translate(_FIGURES)), True) if len(m[1]) <= 4 else (int(m[1].translate(_FIGURES)[:18]), False)
    if not _ROMAN.match(m[2]):
        return None
    v = [_VALUES[c] for c in m[2].lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0])), True


def page_lines(lines: list[str]) -> dict[int, tuple[int, bool]]:
    """(value, sure) of the lines that are nothing but a page number; bare figures one below the other may be a column of
    figures, and only the pages' sequence can tell."""
    got = {i: v for i, x in enumerate(lines) if x and not x.isspace() and (v := page_number(x))}
    bare = {i for i in got if lines[i].strip().isdigit()}
    figures = bare | {i + d for i in bare for d in (-1, 1) if 0 <= i + d < len(lines) and lines[i + d].strip().isdigit()}
    return {i: (v, short and not (i in bare and (i - 1 in figures or i + 1 in figures))) for i, (v, short) in got.items()}


_LETTERS = re.compile(r"[^\W_]+")
#: what usually stands behind a line's last letter or figure
_BEHIND = " \t.,:;!?'\"()[]{}»”’*_|·•—–-…"
_FOLDS = (("ii", "u"), ("ri", "n"), ("rn", "m"), ("cl", "d"), ("vv", "w"))
_FOLD = str.maketrans({"e": "c", "é": "c", "6": "c", "t": "f", "1": "i", "l": "i", "0": "o", "5": "s", "h": "b", "8": "b", "9": "g", "п": "н", "л": "н", "и": "й",
                       "ó": "o", "á": "a", "3": "з", "б": "c"})
_FOLD |= {o: _FOLD.get(ord(c), c) for o, c in SMALL.items() if o not in _FOLD}
#: keys beyond this length are told apart by their hash
LONG_KEY = 40


def folded(text: str) -> str:
    """The form in which words and lines are compared; a soft hyphen at a line end is a hyphen like others."""
    if "\xad" in text:
        text = _SOFT.sub("-", text)
    return looks(text, fold_case=True)


def line_key(line: str) -> tuple[str, bool]:
    """(fuzzy key, had a number): what stays of a folded line without page number, chapter number and look of characters."""
    t = line.strip()
    m = _CHAPTER.match(t)
    core = t[m.end():] if m else t
    m = _LEAD.match(core)
    less = core[m.end():] if m else core
    end = less.rstrip(_BEHIND)[-1:]
    if end.isdigit() or not end.isalnum():
        less = _TAIL.sub("", less)
    numbered = less != core
    k = "".join(_LETTERS.findall(less))
    for a, b in _FOLDS:
        k = k.replace(a, b)
    k = k.translate(_FOLD)
    return k if len(k) <= LONG_KEY else xxhash.xxh3_128_hexdigest(k.encode("utf-8", "surrogatepass")), numbered


def may_run(line: str) -> bool:
    s = line.strip()
    return len(s) >= 2 and s[-1] not in _STOP and not _MARKED.match(s)


def broken_words(lines: list[str], skip: set[int]) -> list[tuple[int, str, str, bool]]:
    """(line, joined, hyphenated, sure): words cut at the end of a line. Page-number lines and empty lines between the
    parts are passed over; with sure=False also one more line, which must turn out to be a running line or the like."""
    out = []
    for i, x in enumerate(lines[:-1]):
        m = _END.search(x) if x.rstrip(" \t")[-1:] in _CUTS else None
        if not m:
            continue
        j, seen = i + 1, 0
        while j < len(lines) and seen < 2:
            if j in skip or not lines[j].strip():
                j += 1
                continue
            n = _BEGIN.match(lines[j])
            if n:
                a, b = looks(m[1], True), looks(n[1], True)
                if not (n[1][0].isupper() and not m[1].isupper()):
                    out.append((i, a + b, f"{a}-{b}", seen == 0))
            seen += 1
            j += 1
    return out


def plain(t: str) -> str:
    """Folded text without markup and without words that are cut at a line end."""
    if "\n" in t and _CUT_END.search(t):
        t = _BROKEN.sub(" ", t)
    return _STRIP.sub(" ", t) if _SIGNS.search(t) else t


def with_parts(counts: Counter) -> Counter:
    """Word counts in which the parts of compounds count too."""
    for w in [w for w in counts if "-" in w or "'" in w or "’" in w]:
        for part in _PART.findall(w):
            counts[part] += counts[w]
    return counts


_FACTS = "fact string, table_name string, row_id bigint, line int, book string, key string, other string, n bigint, page int"
#: bits of a line's n: it has a number, it stands at the edge of a text, its place on the page is the margin
NUMBERED, END, MARGIN = 1, 2, 4


def facts(rows: DataFrame) -> DataFrame:
    """rows: table_name, row_id, book, heading (of the text, may be null), is_heading, text and, where known, page (its place in
    the book), margin (does the text lie in the page's margin?)."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()]
    names = [c.split()[0] for c in _FACTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            counts: Counter = Counter()
            heads: set[tuple[str, str]] = set()
            for table, row, book, heading, is_heading, text, page, margin in zip(*(c.to_pylist() for c in b.columns)):
                if heading:
                    heads.add((book, line_key(folded(heading.split(" > ")[0]))[0]))
                if not text or text.isspace():
                    continue
                low = folded(text)
                counts.update(_WORD.findall(plain(low)))
                lines, lows = text.split("\n"), low.split("\n")
                pages = page_lines(lines)
                out += [("page", table, row, i, book, None, None if sure else "?" if margin else "-", v, page) for i, (v, sure) in pages.items()]
                out += [("cut", table, row, i, None, a, c, int(sure), None) for i, a, c, sure in broken_words(lines, {i for i, (_, sure) in pages.items() if sure})]
                if is_heading:
                    heads.add((book, line_key(low)[0]))
                    continue
                full = [i for i, x in enumerate(lines) if x and not x.isspace()]
                for at, i in enumerate(full):
                    if i not in pages and may_run(lines[i]):
                        k, numbered = line_key(lows[i] if len(lows) == len(lines) else folded(lines[i]))
                        if len(k) >= 2:
                            end = margin is None and (at in (0, len(full) - 1) or full[at - 1] in pages or full[at + 1] in pages)
                            out.append(("line", table, row, i, book, k, None, NUMBERED * numbered + END * end + MARGIN * bool(margin), page))
            out += [("word", None, None, None, None, w, None, n, None) for w, n in with_parts(counts).items()]
            out += [("head", None, None, None, bk, k, None, None, None) for bk, k in heads if k]
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    for c, kind in (("page", "int"), ("margin", "boolean")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    return rows.select("table_name", "row_id", "book", "heading", "is_heading", "text", "page", "margin").mapInArrow(run, _FACTS)


def vocabulary(got: DataFrame) -> DataFrame:
    return got.where("fact = 'word'").groupBy("key").agg(F.sum("n").alias("n"))


def running_lines(got: DataFrame, titles: DataFrame, least: int = 3) -> DataFrame:
    """table_name, row_id, line: lines whose fuzzy key repeats in its book. titles: book, title. A title or a chapter's heading is
    one occurrence, and any line with its key another; without one the key must stand in the margins of two pages, or at the
    edges of `least` texts with page numbers, or alone in a margin that holds running lines on the book's other pages."""

    @F.udf("string", useArrow=True)
    def key(t):
        return line_key(folded(t))[0] if t else None

    lines = got.where("fact = 'line'").select("table_name", "row_id", "line", "book", "key", "n", "page")
    heads = got.where("fact = 'head'").select("book", "key").unionByName(titles.select("book", key("title").alias("key"))).where("key <> ''").distinct()
    flag = lambda bit: F.col("n").bitwiseAND(F.lit(bit)) != 0
    place = F.coalesce(F.concat(F.lit("p"), F.col("page")), F.concat_ws("/", "table_name", "row_id"))
    edges = lines.where(flag(MARGIN | END)).select("book", "key", place.alias("place"), flag(MARGIN).alias("margin"), (flag(NUMBERED) & (F.length("key") >= 4)).alias("numbered")).distinct()
    # counts of distinct places, each of which is at most two rows of each kind here
    again = edges.groupBy("book", "key", "place").agg(F.max("margin").alias("margin"), F.max("numbered").alias("numbered")).groupBy("book", "key").agg(
        F.count_if("margin").alias("margins"), F.count_if("numbered").alias("numbers")).where((F.col("margins") >= 2) | (F.col("numbers") >= least)).select("book", "key")
    first = cut(lines.join(heads.unionByName(again).distinct(), ["book", "key"], "left_semi").select("table_name", "row_id", "line", "book", flag(MARGIN).alias("margin")))
    # the margin itself repeats: where it holds running lines on some pages, its lines on the others are such too
    there = lines.where(flag(MARGIN)).join(first.where("margin").select("book").distinct(), "book", "left_semi")
    return first.select("table_name", "row_id", "line").unionByName(there.select("table_name", "row_id", "line")).distinct()


def page_numbers(got: DataFrame) -> DataFrame:
    """table_name, row_id, line. A sequence: on at least two pages of a book the number is as far from the page's place in the
    book. What is in none, or in the middle of a page, must have the form of a page number for sure."""
    p = got.where("fact = 'page' and (other is null or other = '?')").select("table_name", "row_id", "line", "book", "page", "n", F.col("other").isNull().alias("sure"))
    off = p.where("page is not null").withColumn("off", F.col("n") - F.col("page"))
    seq = off.select("book", "off", "page").distinct().groupBy("book", "off").agg(F.count("*").alias("pages")).where("pages >= 2").select("book", "off")
    return p.where("sure").unionByName(off.join(seq, ["book", "off"], "left_semi").select(*p.columns)).select("table_name", "row_id", "line").distinct()


def cut_words(got: DataFrame, vocab: DataFrame) -> DataFrame:
    """table_name, row_id, line: cut words whose joined form the corpus prefers."""
    c = got.where("fact = 'cut'").select("table_name", "row_id", "line", "key", "other", (F.col("n") == 1).alias("sure"))
    j = vocab.select("key", F.col("n").alias("joined"))
    h = vocab.select(F.col("key").alias("other"), F.col("n").alias("apart"))
    known = c.join(j, "key", "left").join(h, "other", "left").na.fill(0, ["joined", "apart"])
    best = known.where("(sure and joined >= apart) or (not sure and joined > 0 and joined > apart)")
    return best.select("table_name", "row_id", "line").distinct()


def undone(w: str) -> set[str]:
    """Words that `w` may be a misreading of: one confusion undone, two in words with figures."""
    cyrillic = any("а" <= c <= "ӿ" for c in w)
    pairs = CONFUSED + ACCENTED if cyrillic else CONFUSED

    def once(x: str) -> set[str]:
        out = set()
        for a, b in pairs:
            i = x.find(a)
            while i >= 0:
                out.add(x[:i] + looks(b) + x[i + len(a) :])
                i = x.find(a, i + 1)
        return out

    figures = sum(c.isdigit() for c in w)
    one = once(w)
    if figures:
        # no known word has figures: each must be undone, so one of two confusions is always a figure's
        first = [x for x in one if sum(c.isdigit() for c in x) < figures] if figures <= 2 else []
        one = {z for y in first for z in (y, *once(y)) if not any(c.isdigit() for c in z)}
    return one - {w}


def misread_words(vocab: DataFrame) -> DataFrame:
    """word, meant. A figure within letters is enough if undoing it gives any known word more frequent than it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws, ms, ns = [], [], []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for m in undone(w):
                    ws.append(w), ms.append(m), ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(ms, pa.string()), pa.array(ns, pa.int64())], ["word", "key", "word_n"])

    words = vocab.where((F.length("key") >= 3) & ~F.col("key").rlike(r"^\d+$") & ~F.col("key").rlike(r"[-'’]"))
    tried = words.mapInArrow(run, "word string, key string, word_n bigint")
    known = vocab.where((F.length("key") >= 3) & ~F.col("key").rlike(r"\d")).select("key", "n")
    ok = F.when(F.col("word").rlike(r"\d"), F.col("n") > F.col("word_n")).otherwise(F.col("n") >= F.greatest(F.lit(5), TIMES_MORE * F.col("word_n")))
    got = tried.join(known, "key").where(ok)
    return got.groupBy("word").agg(F.max_by("key", F.struct("n", "key")).alias("meant"))


def _tokens(text: str) -> list[str]:
    return _PART.findall(plain(folded(text)))


def _line_words(text: str, bad=None) -> set[tuple[int, str]]:
    """(line, word) of a text's words, or of those in `bad`; a word that only the whole text shows has line -1."""
    every = _tokens(text)
    if bad is not None and bad.isdisjoint(every):
        return set()
    whole = {w for w in every if bad is None or w in bad}
    out = {(i, w) for i, x in enumerate(text.split("\n")) for w in _tokens(x) if w in whole}
    return out | {(-1, w) for w in whole - {w for _, w in out}}


def misread_rows(rows: DataFrame, wrong: DataFrame, sent: dict[str, str] | None, running: DataFrame) -> DataFrame:
    """table_name, row_id of texts with misread words outside of running lines, which are noise as a whole. The list goes to
    every task if it is small enough to be `sent`, else the texts' words are joined with it."""
    bad = None if sent is None else frozenset(sent)
    names = ["table_name", "row_id", "line", "word"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(t, i, n, w) for t, i, x in zip(*(c.to_pylist() for c in b.columns)) if x for n, w in _line_words(x, bad)]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()))], names)

    found = rows.select("table_name", "row_id", "text").mapInArrow(mark, "table_name string, row_id bigint, line int, word string")
    if bad is None:
        found = found.join(wrong.select("word"), "word", "left_semi")
    return found.join(running, ["table_name", "row_id", "line"], "left_anti").select("table_name", "row_id")


def row_words(rows: DataFrame, text: str, split: Callable[[str], list[str]]) -> DataFrame:
    """table_name, row_id, word: the words of each text once."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(t, i, w) for t, i, x in zip(*(c.to_pylist() for c in b.columns)) if x for w in set(split(x))]
            cols = list(zip(*out)) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["table_name", "row_id", "word"])

    return rows.select("table_name", "row_id", text).mapInArrow(words, "table_name string, row_id bigint, word string")


def listed_words(vocab: DataFrame) -> tuple[DataFrame, dict[str, str] | None]:
    """(misread words with what is meant; the same as a dict if they are few enough to be sent)."""
    wrong = misread_words(vocab)
    some = wrong.limit(MOST_SENT + 1).collect()
    if len(some) > MOST_SENT:
        return cut(wrong), None
    return vocab.sparkSession.createDataFrame(some, "word string, meant string"), {r[0]: r[1] for r in some}


def noise(rows: DataFrame, titles: DataFrame) -> tuple[DataFrame, dict]:
    """(cases: table_name, row_id, kind; parts by kind)."""
    got = cut(facts(rows))
    vocab = cut(vocabulary(got))
    wrong, sent = listed_words(vocab)
    running = running_lines(got, titles)
    parts = {
        "page_number": page_numbers(got),
        "running": running,
        "hyphen": cut_words(got, vocab),
        "misread": misread_rows(rows, wrong, sent, running),
        "words": wrong, "sent": sent,
    }
    out = None
    for kind in ("page_number", "running", "hyphen", "misread"):
        one = parts[kind].select("table_name", "row_id", F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out.distinct(), parts


def _mend(text: str, drop: set[int], join: set[int], meant: dict[str, str]) -> str:
    lines = text.split("\n")
    paragraphs: list[str] = []
    now = ""
    joined = False
    for i, x in enumerate(lines):
        if i in drop:
            continue
        s = x.strip()
        if not s:
            if now and not joined:
                paragraphs.append(now)
                now = ""
            continue
        if _MARKED.match(s):
            if now:
                paragraphs.append(now)
            paragraphs.append(s)
            now, joined = "", False
            continue
        glue = "" if not now or joined or (re.match(rf"[{_HAN}，。：；]", s[0]) and re.match(rf"[{_HAN}，。：；]", now[-1])) else " "
        now += glue + s
        joined = i in join
        if joined:
            now = _END.sub(lambda m: m[1], now)
    if now:
        paragraphs.append(now)

    return _reword("\n\n".join(paragraphs), meant)


def _reword(text: str, meant: dict[str, str]) -> str:
    def word(m: re.Match) -> str:
        w = m[0]
        r = meant.get(looks(w, True))
        return w if r is None else r.upper() if w.isupper() else r[:1].upper() + r[1:] if w[:1].isupper() else r

    return _PART.sub(word, text) if meant else text


def repair(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """table_name, row_id, text (as it was), repaired: continuous paragraphs without running lines and page numbers. Misread words
    get the meaning of the corpus' word. That list goes to every task if it is small, else the words of the mended texts are joined
    with it."""
    _, parts = noise(rows, titles)
    drop = parts["page_number"].unionByName(parts["running"]).groupBy("table_name", "row_id").agg(F.collect_set("line").alias("drop"))
    join = parts["hyphen"].groupBy("table_name", "row_id").agg(F.collect_set("line").alias("join"))
    meant = parts["sent"] or {}
    schema, names = "table_name string, row_id bigint, text string, repaired string", ["table_name", "row_id", "text", "repaired"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [None if t is None else _mend(t, set(d or ()), set(j or ()), meant) for t, d, j in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 2)), pa.array(done, pa.string())], names)

    def reword(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [t and _reword(t, dict(m or ())) for t, m in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 2)), pa.array(done, pa.string())], names)

    on = ["table_name", "row_id"]
    mended = rows.select(*on, "text").join(drop, on, "left").join(join, on, "left").mapInArrow(run, schema)
    if parts["sent"] is not None:
        return mended
    found = row_words(mended, "repaired", lambda t: [looks(w, True) for w in _PART.findall(t)]).join(parts["words"].select("word", "meant"), "word")
    own = found.groupBy(*on).agg(F.map_from_entries(F.collect_set(F.struct("word", "meant"))).alias("own"))
    return mended.join(own, on, "left").mapInArrow(reword, schema)
