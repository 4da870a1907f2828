"""Text expressions over Columns; everything here stays in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
HAN_WIDE = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
WORD = r"[\p{L}\p{N}_]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
SPACE = r"[\p{IsWhite_Space}\x{1c}-\x{1f}]"
INVISIBLE = r"[\p{Z}\p{Cc}\p{Cf}\p{Cs}]"
PUA = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}"
CYRILLIC = r"\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}"
LATIN = r"A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}"
GREEK = r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}"
# Accented Latin vowels that break a search for Cyrillic words.
ACCENTED = "áéóúýíōāē"


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def has_cjk(c: Column) -> Column:
    """Han, CJK punctuation or full-width forms occur (selects the weights of fusion)."""
    return c.rlike(f"[{HAN_WIDE}]")


def has_pua(c: Column) -> Column:
    return c.rlike(f"[{PUA}]")


def sanitize_pua(c: Column) -> Column:
    """Private-use characters become U+FFFD; lengths stay."""
    return F.regexp_replace(c, f"[{PUA}]", "\uFFFD")


def kangxi_table() -> tuple[str, str]:
    """Kangxi radicals and the unified characters they stand for, by their compatibility decomposition."""
    src = [chr(o) for o in range(0x2F00, 0x2FD6)]
    return "".join(src), "".join(unicodedata.normalize("NFKC", c) for c in src)


def fold_kangxi(c: Column) -> Column:
    return F.translate(c, *kangxi_table())


def kangxi_count(c: Column) -> Column:
    return count_matches(c, r"[\x{2F00}-\x{2FD5}]")


def pua_count(c: Column) -> Column:
    return count_matches(c, f"[{PUA}]")


def visible_len(c: Column) -> Column:
    """Code points that are neither separators, controls, formats nor surrogates."""
    return F.length(F.regexp_replace(c, INVISIBLE, ""))


def snippet(c: Column, n: int = 200) -> Column:
    """Whitespace runs as one space, then the first n characters."""
    return F.substring(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")), 1, n)


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def display_width(c: Column) -> Column:
    """Columns on a terminal: wide characters count twice."""
    return F.length(c) + count_matches(c, r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]")


def token_estimate(c: Column) -> Column:
    """Han characters one each, three other characters one."""
    han = count_matches(c, f"[{HAN}]")
    return han + F.floor((F.length(c) - han) / 3).cast("int")


def utf16_length(c: Column) -> Column:
    return (F.length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def composed(c: Column) -> Column:
    """Canonical composed form (names of files come decomposed from some systems). Only text with combining marks meets Python."""

    @F.pandas_udf("string")
    def nfc(s):
        return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    plain = ~c.rlike(r"[\p{M}\x{1100}-\x{11FF}]")
    return F.when(plain, c).otherwise(nfc(F.when(plain, None).otherwise(c)))


def windows_path(c: Column) -> Column:
    """/mnt/x/a/b -> X:\\a\\b; other paths with backslashes become as they are."""
    drive = F.regexp_extract(c, r"^/mnt/([A-Za-z])(?:/|$)", 1)
    rest = F.regexp_replace(c, r"^/mnt/[A-Za-z]/?", "")
    return F.when(drive != "", F.concat(F.upper(drive), F.lit(":\\"), F.translate(rest, "/", "\\"))).otherwise(c)


def path_key(c: Column) -> Column:
    """One spelling of a path: drive letter and slashes, no double or trailing ones."""
    p = F.regexp_replace(F.translate(c, "\\", "/"), r"^([A-Za-z]):/*", "/mnt/$1/")
    p = F.regexp_replace(p, "/{2,}", "/")
    drive = F.regexp_extract(p, r"^/mnt/([A-Za-z])/", 1)
    p = F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.regexp_replace(p, r"^/mnt/[A-Za-z]", ""))).otherwise(p)
    return F.regexp_replace(p, r"(?<=.)/+$", "")


def collapse_whitespace(c: Column) -> Column:
    """Indentation stays, whitespace within a line becomes one space (not in fenced code), at its end none; three and
    more line ends become two. Fenced blocks and what lies between them are treated apart, each as a whole."""
    ws, bar = r"[\p{IsWhite_Space}\x{1c}-\x{1f}]", r"(?:`{3,}|~{3,})"
    blank = r"[\p{IsWhite_Space}\x{1c}-\x{1f}&&[^\n]]"
    fenced = rf"(?dms)^{blank}*{bar}.*?(?:^{blank}*{bar}[^\n]*$|\z)"
    between, blocks = F.split(c, fenced), F.regexp_extract_all(c, F.lit(fenced), 0)
    trimmed = lambda t: F.regexp_replace(t, rf"(?dm){blank}+$", "")
    outside = F.transform(between, lambda t: F.regexp_replace(trimmed(t), rf"(?<=[^\p{{IsWhite_Space}}\x{{1c}}-\x{{1f}}]){blank}+(?={ws[:1]}^{ws[1:]})", " "))
    inside = F.transform(blocks, lambda t: F.regexp_replace(t, rf"(?dm)^(?!{blank}*{bar})([^\n]*?){blank}+$", "$1"))
    both = F.array_join(F.flatten(F.zip_with(outside, inside, lambda o, i: F.array(o, F.coalesce(i, F.lit(""))))), "")
    return F.regexp_replace(both, "\n{3,}", "\n\n")


def strip_tags(c: Column) -> Column:
    return strip_ws(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), f"{SPACE}+", " "))


def image_refs(c: Column) -> Column:
    """Markdown and HTML image references, each once, in order of first occurrence within its notation."""
    md = F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), 1)
    tags = F.regexp_extract_all(c, F.lit(r"<img[^>]+src=[\"']([^\"']+)[\"']"), 1)
    return F.array_distinct(F.concat(md, tags))


def front_matter(c: Column) -> Column:
    """Flat `key: value` pairs between `---` lines at the start."""
    block = F.regexp_extract(c, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[^:#\s][^:]*:"))
    one = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\"']|[\"']$", "")))
    return F.map_from_entries(F.array_sort(F.array_distinct(one)))


def without_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", "")


_FOLDED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_TO = "".join(unicodedata.normalize("NFD", x)[0] for x in _FOLDED)


def fold_term(c: Column) -> Column:
    """Equality of terms: no letter case, no Latin accents."""
    return F.translate(F.lower(c), _FOLDED, _TO)


def fold_word(t: str) -> str:
    """The same on the driver."""
    return t.lower().translate(str.maketrans(_FOLDED, _TO))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
