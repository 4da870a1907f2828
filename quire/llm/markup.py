"""Markup residue: HTML, Markdown, wiki and LaTeX turned into clean text that keeps its structure.

Each text is parsed into a tree of elements: HTML block elements nest, and what stands between them is split into
headings, lists, tables, code, formulas, quotes and paragraphs of whatever notation. Every element knows the sorts of
markup it was written in, and every subtree has a hash of its content. Site templates are removed by counting, per host,
the pages on which a subtree's hash occurs: subtrees that recur on many pages of their host are deleted. What is left is
rendered in one plain notation: `#` headings, `-` lists, `|` tables, fenced code, `$` formulas.

Defined results: null and blank texts have no markup and stay as they are; repeated rows are one page; a text without
host has no template; unclosed elements and fences end with the text; elements and quotes nested deeper than DEEPEST
belong to the one at that depth, with all their text; an empty table gives no rows; texts are processed whole; columns
beyond those named are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"(?m)^([ \t>]*)(`{3,}|~{3,})[^\n]*\n?(.*?)(?:^[ \t>]*\2[`~]*[ \t]*$\n?|\Z)", re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9:]*(?:\s+[^<>]*)?\s*/?>")
_ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_WIKI_TABLE = re.compile(r"(?m)^\s*\{\|.*?(?:^\s*\|\}[^\n]*|\Z)", re.S)
_WIKI_ROW = re.compile(r"(?m)^\s*\|(?:-[-\s]*$|\})|^\s*\|[^|\n]+\|\|")
_WIKI_LINK = re.compile(r"\[\[[^\[\]\n]+(?:\n[^\[\]\n]+)?\]\]")
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}]+\}\}")
_WIKI_HEAD = re.compile(r"(?m)^[ \t>]*(={2,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*$")
_WIKI_QUOTE = re.compile(r"'{2,5}(?=[^'\s])[^'\n]*(?:\n[^'\n]+)?'{2,5}")
_LATEX_ENV = re.compile(r"\\(?:begin|end)\{[a-zA-Z*]+\}|(?m:^[ \t>]*\\item\b)")
_LATEX_CMD = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{")
_DISPLAY = re.compile(r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{(equation|align|displaymath|math|gather)\*?\}.+?\\end\{\1\*?\}", re.S)
_INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])(?:[A-Za-z]|[^$\n]*[\\^_=][^$\n]*(?:\n[^$\n]+)?)(?<=[^\s\\])\$(?![\d$])")
_HEAD = re.compile(r"(?m)^[ \t>]*(?:#{1,6}[ \t]+\S|#{2,6}[^\s#])")
_SETEXT = re.compile(r"(?m)^[ \t>]*\S[^\n]*\n[ \t>]*(?:={3,}|-{3,})[ \t]*$")
_RULE = re.compile(r"(?m)^[ ]{0,3}(?:-{3,}|\*{3,}|_{3,})[ \t]*$")
_STRONG = re.compile(r"\*\*(?=[^\s*])[^*\n]+(?:\n[^*\n]+)?(?<=\S)\*\*|(?<!\w)__(?=[^\s_])[^_\n]+(?:\n[^_\n]+)?(?<=\S)__(?!\w)|~~(?=\S)[^~\n]+(?:\n[^~\n]+)?(?<=\S)~~")
_EMPH = re.compile(
    r"(?:(?<![*\\A-Za-z\d])\*(?=[^\s*])|(?<=\d)\*(?=[^\s*\d]))[^*\n]+(?:\n[^*\n]+)?(?<=[^\s*])\*(?!\*)|(?<![\w\\])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?!\w)")
_CODE = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\(([^()\s]+)(?:\s+\"[^\"]*\")?\)")
_ITEM = re.compile(r"^[ \t>]*[-*+][ \t]+\S")
_NUMBER = re.compile(r"^[ \t>]*(\d{1,3})[.)][ \t]+\S")
_PAGE = re.compile(r"^[ \t]*([-*+~—–·•])[ \t]*\d+[ \t]*\1[ \t]*$")
_QUOTE = re.compile(r"^[ \t]*>")
_PIPE = re.compile(r"^[ \t>]*\|.*\|[ \t]*$")
_PIPE_RULE = re.compile(r"(?m)^[ \t>]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$")
_ANY = re.compile(r"[<&\\{}\[`|*_#$~>=+]|''|(?m:^[ \t]*[-+*][ \t]|^[ \t]*-{3,}|^[ \t]*\d{1,3}[.)][ \t])")
_BLOCK = {"html", "body", "div", "nav", "header", "footer", "aside", "section", "article", "main", "table", "thead", "tbody", "tr", "ul", "ol", "li", "p",
          "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "form", "figure", "td", "th", "dl", "dt", "dd"}
_BLOCK_TAG = re.compile(r"<(/?)(" + "|".join(sorted(_BLOCK, key=len, reverse=True)) + r")\b([^<>]*?)(/?)>", re.I)


#: levels of nested elements that are told apart
DEEPEST = 200
HTML, MARKDOWN, WIKI, LATEX = 1, 2, 4, 8
SORTS = {"html": HTML, "markdown": MARKDOWN, "wiki": WIKI, "latex": LATEX}


def _listed(lines: list[str]) -> bool:
    """List items, not a wrapped line that happens to begin with a sign."""
    item = [bool(_ITEM.match(x)) and not _PAGE.match(x) for x in lines]
    num = [int(m[1]) if (m := _NUMBER.match(x)) else None for x in lines]
    for i, x in enumerate(lines):
        if item[i] and (i == 0 or not lines[i - 1].strip(" \t>") or item[i - 1] or (i + 1 < len(lines) and item[i + 1])):
            return True
        if num[i] is not None and i and num[i - 1] is not None and num[i] == num[i - 1] + 1:
            return True
    return False


def _quoted(lines: list[str]) -> bool:
    q = [bool(_QUOTE.match(x)) for x in lines]
    return any(q[i] and (i == 0 or not lines[i - 1].strip() or q[i - 1] or (i + 1 < len(lines) and q[i + 1])) for i in range(len(lines)))


def sorts(text: str) -> int:
    """Sorts of markup in an element's own source, which holds no fence."""
    out = 0
    if not _ANY.search(text):
        return out
    if _CODE.search(text):
        out |= MARKDOWN
        text = _CODE.sub(" ", text)
    if "<" in text:
        bare = _TAG.sub("", _COMMENT.sub("", text))
        if bare != text:
            out |= HTML
            text = bare
    if "&" in text and _ENTITY.search(text):
        out |= HTML
        text = _ENTITY.sub(" ", text)
    if "$" in text or "\\" in text:
        bare = _INLINE.sub(" ", _DISPLAY.sub(" ", text))
        if bare != text or "$$" in text or _LATEX_ENV.search(text) or _LATEX_CMD.search(text):
            out |= LATEX
        text = bare
        if "\\" in text:
            text = _LATEX_CMD.sub(" {", text)
    bare = _WIKI_TEMPLATE.sub(" ", _WIKI_LINK.sub(" ", _WIKI_TABLE.sub("\n", text)))
    if bare != text or _WIKI_HEAD.search(bare) or "''" in bare and _WIKI_QUOTE.search(bare) or "|" in bare and _WIKI_ROW.search(bare):
        out |= WIKI
        text = _WIKI_HEAD.sub("", bare)
    if not out & MARKDOWN:
        lines = text.split("\n")
        if (
            ("#" in text and _HEAD.search(text)) or (("===" in text or "---" in text) and (_SETEXT.search(text) or _RULE.search(text)))
            or (("**" in text or "__" in text or "~~" in text) and _STRONG.search(text)) or _LINK.search(text)
            or (("*" in text or "_" in text) and _EMPH.search(text)) or _listed(lines) or (">" in text and _quoted(lines))
            or ("|" in text and (_PIPE_RULE.search(text) or sum(bool(_PIPE.match(x)) for x in lines) >= 2))
        ):
            out |= MARKDOWN
    return out


def kinds(text: str) -> set[str]:
    """Sorts of markup of a text: those of the elements of its tree."""
    got = 0
    for top in parse(text):
        for n in top.walk():
            got |= n.marks
    return {k for k, bit in SORTS.items() if got & bit}


class Node:
    """An element: its kind, its own rendered text or its children, the hash of its content, and the sorts of markup that it
    alone was written in (`void` elements are markup that leaves nothing)."""

    __slots__ = ("kind", "text", "children", "hash", "marks")

    def __init__(self, kind: str, text: str = "", children: list["Node"] | None = None, marks: int = 0):
        self.kind, self.text, self.children, self.marks = kind, text, children or [], marks
        own = kind + "\0" + " ".join(text.split()) + "\0" + ",".join(format(c.hash & ((1 << 64) - 1), "x") for c in self.children)
        self.hash = xxhash.xxh3_64_intdigest(own.encode("utf-8", "surrogatepass")) - (1 << 63)

    def walk(self) -> Iterator["Node"]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += n.children


_COMMAND = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{|[{}]")


def unwrapped(s: str) -> str:
    """Without LaTeX commands around their argument, at any depth; a command that isn't closed stays."""
    out, open_, at = [], [], 0
    for m in _COMMAND.finditer(s):
        out.append(s[at : m.start()])
        at = m.end()
        if m[0] == "}":
            if not (open_ and open_.pop()[1]):
                out.append("}")
        elif m[0] == "{":
            open_.append((0, ""))
            out.append("{")
        else:
            open_.append((len(out), m[0]))
            out.append("")
    for i, command in open_:
        if command:
            out[i] = command
    return "".join(out) + s[at:]


def inline(s: str) -> str:
    """Running text without markup; formulas stay as such, and so does what is code."""
    kept: list[str] = []

    def code(m: re.Match) -> str:
        kept.append(m[0].strip("`"))
        return f"\0{len(kept) - 1}\0"

    def keep(m: re.Match) -> str:
        f = re.sub(r"\0(\d+)\0", lambda c: kept[int(c[1])], m[0])
        body = re.sub(r"^(?:\$\$?|\\\[|\\\(|\\begin\{[a-z*]+\})|(?:\$\$?|\\\]|\\\)|\\end\{[a-z*]+\})$", "", f).strip()
        kept.append(f"${body}$")
        return f"\0{len(kept) - 1}\0"

    s = s.replace("\0", "")
    if "`" in s:
        s = _CODE.sub(code, s)
    if "$" in s or "\\" in s:
        s = _INLINE.sub(keep, _DISPLAY.sub(keep, s))
    s = _COMMENT.sub("", s)
    s = re.sub(r"<br\s*/?>", "\n", s, flags=re.I)
    s = _TAG.sub("", s)
    if "&" in s:
        s = html.unescape(s)
    if "\\" in s:
        s = re.sub(r"~?\\(?:cite|ref|label|footnotemark)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", "", s)
        s = unwrapped(re.sub(r"\\(?:begin|end)\{[a-zA-Z*]+\}", "", s))
    s = _WIKI_TEMPLATE.sub("", s)
    s = _WIKI_LINK.sub(lambda m: m[0][2:-2].split("|")[-1], s)
    s = _LINK.sub(lambda m: m[1], s)
    s = re.sub(r"'{2,5}", "", s) if "''" in s else s
    for rule, n in ((_STRONG, 2), (_EMPH, 1)):
        s = rule.sub(lambda m, n=n: m[0][n:-n], s)
    s = re.sub(r"\0(\d+)\0", lambda m: kept[int(m[1])], s)
    return "\n".join(x.strip() for x in s.split("\n")).strip()


_LATEX_HEAD = re.compile(r"^\s*\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{(.*)\}\s*$", re.S)
_DEPTH = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}


def _leaves(s: str) -> list[Node]:
    """Elements of text that holds no block-level HTML."""
    out: list[Node] = []
    for part in re.split(r"(\$\$.+?\$\$|\\begin\{equation\*?\}.+?\\end\{equation\*?\}|^\s*\{\|.*?(?:^\s*\|\}[^\n]*|\Z))", s, flags=re.S | re.M):
        p = part.strip()
        if not p:
            continue
        if p.startswith("$$") or p.startswith("\\begin{equation"):
            out.append(Node("formula", inline(p), marks=sorts(p)))
            continue
        if p.startswith("{|"):
            rows = [[inline(c) for c in r.lstrip("|!").split("||")] for r in re.split(r"\n\s*", p)[1:] if r.strip().startswith(("|", "!")) and r.strip()[:2] not in ("|-", "|}")]
            out.append(Node("table", "\n".join("| " + " | ".join(r) + " |" for r in rows), marks=sorts(p)))
            continue
        for para in re.split(r"\n[ \t]*\n+", part):
            out += _paragraph(para)
    return out


_QUOTES = re.compile(r"^(?:[ \t]*>)+ ?")


def _paragraph(para: str, depth: int = 0) -> list[Node]:
    """Elements of text without empty lines. Each has the sorts of its own source; signs that only count among their
    neighbours (a list's, a heading's underline) are the first element's."""
    out: list[Node] = []
    run: list[str] = []
    kind = "paragraph"
    lines = para.split("\n")
    marks = sorts(para)
    own = (lambda src: sorts(src) & marks) if marks else (lambda src: 0)

    def flush() -> None:
        nonlocal run, kind
        t = "\n".join(run).strip()
        if t:
            got = own("\n".join(run))
            if kind == "list":
                out.append(Node("list", "\n".join("- " + inline(re.sub(r"^[ \t]*(?:[-*+]|\d{1,3}[.)]|\\item)[ \t]*", "", x)) for x in run), marks=got))
            elif kind == "table":
                rows = [[inline(c) for c in x.strip().strip("|").split("|")] for x in run if not _PIPE_RULE.match(x)]
                out.append(Node("table", "\n".join("| " + " | ".join(c.strip() for c in r) + " |" for r in rows), marks=got))
            elif kind == "quote":
                bare = [(re.sub(r"^[ \t]*> ?", "", x) if depth < DEEPEST else _QUOTES.sub("", x)) for x in run]
                out.append(Node("quote", "", [n for p in re.split(r"\n[ \t]*\n+", "\n".join(bare)) for n in _paragraph(p, depth + 1)], got))
            elif (x := inline(t)) or got:
                out.append(Node("paragraph" if x else "void", x, marks=got))
        run, kind = [], "paragraph"

    listed = _listed(lines)
    i = 0
    while i < len(lines):
        x = lines[i]
        s = x.strip()
        if m := re.match(r"^[ \t]*(#{1,6})[ \t]+(\S.*?)[ \t#]*$|^[ \t]*(#{2,6})([^\s#].*)$", x):
            flush()
            out.append(Node(f"h{len(m[1] or m[3])}", inline(m[2] or m[4]), marks=own(x)))
        elif m := _WIKI_HEAD.match(x):
            flush()
            out.append(Node(f"h{len(m[1])}", inline(m[2]), marks=own(x)))
        elif m := _LATEX_HEAD.match(x):
            flush()
            out.append(Node(f"h{_DEPTH[m[1]]}", inline(m[2]), marks=own(x)))
        elif s and i + 1 < len(lines) and re.match(r"^[ \t]*(={3,}|-{3,})[ \t]*$", lines[i + 1]) and not s.startswith("|"):
            flush()
            out.append(Node("h1" if "=" in lines[i + 1] else "h2", inline(s), marks=own(x + "\n" + lines[i + 1])))
            i += 1
        elif _RULE.match(x):
            flush()
            out.append(Node("void", marks=own(x)))
        elif s in ("\\begin{itemize}", "\\end{itemize}", "\\begin{enumerate}", "\\end{enumerate}"):
            flush()
            out.append(Node("void", marks=own(x)))
        else:
            now = ("list" if s.startswith("\\item") or (listed and (_ITEM.match(x) or _NUMBER.match(x)) and not _PAGE.match(x))
                   else "table" if _PIPE.match(x) else "quote" if _QUOTE.match(x) and (kind == "quote" or not run) else "paragraph")
            if now != kind and not (kind == "list" and now == "paragraph" and run and x[:1] in " \t"):
                flush()
                kind = now
            run.append(x)
        i += 1
    flush()
    if rest := marks & ~_all_marks(out):
        if out:
            out[0].marks |= rest
        else:
            out.append(Node("void", marks=rest))
    return out


def _all_marks(nodes: list[Node]) -> int:
    got = 0
    for top in nodes:
        for n in top.walk():
            got |= n.marks
    return got


def _blocks(s: str) -> list[Node]:
    """HTML block elements nest; an element that is never closed ends with its parent. Tags within code are code."""
    stack: list[tuple[str, list[Node]]] = [("", [])]
    at = 0

    def close() -> None:
        tag, kids = stack.pop()
        to = stack[-1][1]
        if tag in ("tr",):
            to.append(Node("row", "| " + " | ".join(flat(k).replace("\n", " ") for k in kids) + " |", marks=HTML | _all_marks(kids)))
        elif tag in ("td", "th"):
            to.append(Node("cell", "", kids, HTML))
        elif tag == "table":
            to.append(Node("table", "\n".join(n.text for k in kids for n in k.walk() if n.kind == "row"), marks=HTML | _all_marks(kids)))
        elif tag == "li":
            to.append(Node("item", flat(Node("x", "", kids)), marks=HTML | _all_marks(kids)))
        elif tag in ("ul", "ol"):
            to.append(Node("list", "\n".join("- " + k.text for k in kids if k.text), marks=HTML | _all_marks(kids)))
        elif re.fullmatch("h[1-6]", tag):
            to.append(Node(tag, flat(Node("x", "", kids)).replace("\n", " "), marks=HTML | _all_marks(kids)))
        else:
            to.append(Node(tag if kids else "void", "", kids, HTML))

    def flat(n: Node) -> str:
        return "\n".join(x for x in (n.text, *map(flat, n.children)) if x)

    def same(tag: str) -> set[str]:
        return {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}}.get(tag, set())

    code = [m.span() for m in _CODE.finditer(s)] if "`" in s and "<" in s else []
    for m in _BLOCK_TAG.finditer(s):
        while code and code[0][1] <= m.start():
            code.pop(0)
        if code and code[0][0] < m.start():
            continue
        stack[-1][1].extend(_leaves(s[at : m.start()]))
        at = m.end()
        tag = m[2].lower()
        if m[1] and any(t == tag for t, _ in stack[1:]):
            while stack[-1][0] != tag:
                close()
            close()
        elif m[1] or m[4] or len(stack) > DEEPEST:
            stack[-1][1].append(Node("void", marks=HTML))
        else:
            while len(stack) > 1 and stack[-1][0] in same(tag):
                close()
            stack.append((tag, []))
    stack[-1][1].extend(_leaves(s[at:]))
    while len(stack) > 1:
        close()
    return stack[0][1]


def parse(text: str) -> list[Node]:
    if not _ANY.search(text):
        return [Node("paragraph", p.strip()) for p in re.split(r"\n[ \t]*\n+", text) if p.strip()]
    out, at = [], 0
    for m in _FENCE.finditer(text):
        out += _blocks(text[at : m.start()])
        code = m[3]
        if m[1].strip():
            code = re.sub(r"(?m)^[ \t]*> ?", "", code)
        out.append(Node("code", code.strip("\n"), marks=MARKDOWN))
        at = m.end()
    return out + _blocks(text[at:])


def render(nodes: list[Node], drop: frozenset[int] = frozenset()) -> str:
    """Plain notation of what isn't dropped."""
    out: list[str] = []
    for n in nodes:
        if n.hash in drop:
            continue
        if re.fullmatch("h[1-6]", n.kind):
            out.append("#" * int(n.kind[1]) + " " + n.text)
        elif n.kind == "code":
            out.append(f"```\n{n.text}\n```")
        elif n.kind == "quote":
            out.append("\n".join("> " + x if x else ">" for x in render(n.children, drop).split("\n")))
        elif n.text:
            out.append(n.text)
        elif n.children:
            out.append(render(n.children, drop))
    return "\n\n".join(x for x in out if x)


_FACTS = "table_name string, row_id bigint, host string, element string, hash bigint, marks int"


def elements(rows: DataFrame) -> DataFrame:
    """rows: table_name, row_id, host, text. The distinct subtrees of each text: the hash of their content and, as bits of
    SORTS, the sorts of markup that their top element was written in."""
    names = [c.split()[0] for c in _FACTS.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, i, h, x in zip(*(c.to_pylist() for c in b.columns)):
                out += {(t, i, h, n.kind, n.hash, n.marks) for top in parse(x) for n in top.walk()}
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names)

    full = rows.where(F.col("text").isNotNull() & F.col("row_id").isNotNull())
    return full.select("table_name", "row_id", "host", "text").mapInArrow(run, _FACTS)


def written_in(facts: DataFrame) -> DataFrame:
    """table_name, row_id, kind: the sorts of markup of each text's elements, those of templates among them."""
    has = F.filter(F.array(*[F.when(F.col("marks").bitwiseAND(bit) != 0, F.lit(k)) for k, bit in SORTS.items()]), lambda k: k.isNotNull())
    return facts.where("marks <> 0").select("table_name", "row_id", F.explode(has).alias("kind")).distinct()


#: a subtree on so many pages recurs, however many pages its host has
MANY_PAGES = 100


def templates(facts: DataFrame, rows: DataFrame, least: int = 5, share: float = 0.1) -> DataFrame:
    """host, hash of subtrees on at least `least` pages and on `share` of all pages of their host or MANY_PAGES."""
    seen = facts.where("host is not null and element <> 'void'").select("host", "hash", "table_name", "row_id").distinct()
    per = seen.groupBy("host", "hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    hosts = rows.where("host is not null").groupBy("host").agg(F.count_distinct("table_name", "row_id").alias("of"))
    return per.join(hosts, "host").where(F.col("pages") >= F.least(share * F.col("of"), F.lit(MANY_PAGES))).select("host", "hash")


def convert(rows: DataFrame, least: int = 5, share: float = 0.1) -> DataFrame:
    """table_name, row_id, clean: the structured plain text without its host's templates."""
    facts = elements(rows)
    found = templates(facts, rows, least, share)
    # the templates of a row, not of its host: a row has few subtrees, a host may have many templates
    mine = facts.where("element <> 'void'").join(found, ["host", "hash"], "left_semi").groupBy("table_name", "row_id").agg(F.collect_set("hash").alias("drop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [None if x is None else render(parse(x), frozenset(d or ())) for x, d in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.string())], ["table_name", "row_id", "clean"])

    both = rows.select("table_name", "row_id", "text").join(mine, ["table_name", "row_id"], "left")
    return both.mapInArrow(run, "table_name string, row_id bigint, clean string")
