"""Terms for full text: Han runs as single characters and pairs, everything else as words; one segmentation for both
the index and the query, so every query term of a text is among its index terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import HAN, WORD

# Words that nearly every text has; Han ones as single characters.
STOPWORDS = frozenset(
    "的 了 和 与 在 是 我 你 他 她 它 这 那 有 为 以 及 等 个 之 其 并 或 而 被 把 就 都 也 很 到 说 要 会 着 过 对 从 向 于 中 上 下 不 没 无 又 才 "
    "the a an of and or in on at to for is are was were be been it its this that".split()
)
_HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_SEGMENT = re.compile(f"[{_HAN}]+|[^{_HAN}]+")
_WORDS = re.compile(r"\w+")


def segments(c: Column) -> Column:
    """Runs of Han and of other characters that together are the text."""
    return F.regexp_extract_all(c, F.lit(f"[{HAN}]+|[^{HAN}]+"), 0)


def _pairs(seg: Column) -> Column:
    n = F.length(seg)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(seg, i, 2))).otherwise(F.array().cast("array<string>"))


def _chars(seg: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(seg)), lambda i: F.substring(seg, i, 1))


def _is_han(seg: Column) -> Column:
    return seg.rlike(f"^[{HAN}]")


def index_terms(c: Column) -> Column:
    return F.flatten(F.transform(segments(c), lambda s: F.when(_is_han(s), F.concat(_chars(s), _pairs(s))).otherwise(F.regexp_extract_all(s, F.lit(f"{WORD}+"), 0))))


def index_text(c: Column) -> Column:
    return F.array_join(index_terms(c), " ")


def query_terms_col(c: Column) -> Column:
    terms = F.transform(segments(c), lambda s: F.when(_is_han(s), F.when(F.length(s) == 1, F.array(s)).otherwise(_pairs(s))).otherwise(F.regexp_extract_all(s, F.lit(f"{WORD}+"), 0)))
    return F.array_distinct(F.flatten(terms))


def is_stop_col(t: Column, stopwords: frozenset[str] = STOPWORDS) -> Column:
    """A listed word, or Han of more than one character all of which are listed."""
    listed = F.array(*[F.lit(w) for w in sorted(stopwords)])
    han = "".join(sorted(w for w in stopwords if re.fullmatch(f"[{_HAN}]", w)))
    return F.array_contains(listed, F.lower(t)) | (t.rlike(f"^[{han}]{{2,}}$") if han else F.lit(False))


def raw_terms(query: str | None) -> list[str]:
    """The query's terms on the driver, each once, in order."""
    out: dict[str, None] = {}
    for seg in _SEGMENT.findall(query or ""):
        if not re.match(f"[{_HAN}]", seg):
            found = _WORDS.findall(seg)
        elif len(seg) == 1:
            found = [seg]
        else:
            found = [a + b for a, b in zip(seg, seg[1:])]
        out.update(dict.fromkeys(found))
    return list(out)


def split_terms(query: str | None, stopwords: frozenset[str] = STOPWORDS) -> tuple[list[str], list[str]]:
    """(kept, pruned). If all would be pruned all are kept, but still reported as pruned."""

    def stop(t: str) -> bool:
        return t.lower() in stopwords or (len(t) > 1 and re.fullmatch(f"[{_HAN}]+", t) is not None and stopwords.issuperset(t))

    terms = raw_terms(query)
    pruned = [t for t in terms if stop(t)]
    return [t for t in terms if not stop(t)] or terms, pruned


def salvage_terms(query: str, most: int = 3) -> list[str]:
    """The longest Han runs and Latin words, for a substring search when nothing else finds anything."""
    found = set(re.findall(f"[{_HAN}]{{2,}}", query)) | set(re.findall(r"[A-Za-z][A-Za-z0-9_+-]{2,}", query))
    return sorted(found, key=lambda t: (-len(t), t))[:most]
