"""Chat exports: format, cleaning, rounds and a rule-based summary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Role marks of the two export formats.
A = {"user": r"^\*\*user\*\*\s*:", "assistant": r"^\*\*assistant\*\*\s*:", "system": r"^\*\*system\*\*\s*:"}
B = {"user": r"^#{1,3}\s+(?:[^\w\n]*\s)?(?:[\d:. T-]+\s)?[^\w\n]*User\b", "assistant": r"^#{1,3}\s+(?:[^\w\n]*\s)?(?:[\d:. T-]+\s)?[^\w\n]*Assistant\b"}
_A = {k: re.compile(v, re.I) for k, v in A.items()}
_B = {k: re.compile(v, re.I) for k, v in B.items()}
EMPTY = "（空对话）"
#: how an assistant begins before it answers: a nod and what comes next, a step it announces, or a word on the question
OPENING = re.compile(
    r"(?:好的|没问题|当然可以|抱歉|对不起|首先)[，,]\s*(?:我|让|这|之前)"
    r"|(?:让我|我先|我来)(?!们)"
    r"|(?:根据|关于)[您你我这].{0,8}?(?:查询|问题|要求|需求)"
    r"|你(?:说得|的理解)"
    r"|这确实|(?:这是.{0,6})?很?好的?(?:问题|观察|观点|想法)|这是.{0,8}问题")
# Fixed values, in order: summaries, tool calls, quoted results, fetched pages
DROPPED = (
    r"(?m)^#+\s*(?:对话)?(?:摘要|总结|概述)[：:].*(?:\n(?!\s*#).*)*",
    r"(?s)```json\s*\n(?:(?!\n```).)*?\"type\"\s*:\s*\"function\".*?\n```\s*\n?",
    r"(?s)工具调用[：:][^\n]*\n(?:[^\n]*\n)?```(?:json)?\n.*?\n```\s*\n?",
    r"搜索结果[：:][^\n]*\n(?:>[^\n]+\n){3,}",
    r"(?:拉取|抓取|读取)(?:的)?(?:网页|URL|页面)(?:内容)?[：:][^\n]*\n(?:>[^\n]+\n)+",
)


def chat_format(c: Column) -> Column:
    """A (bold roles), B (role headings) or unknown; both sides of one format win over a single side."""
    has = {f + k: c.rlike("(?im)" + v) for f, d in (("A", A), ("B", B)) for k, v in d.items()}
    return (F.when(has["Auser"] & has["Aassistant"], "A").when(has["Buser"] & has["Bassistant"], "B")
            .when(has["Auser"] | has["Aassistant"], "A").when(has["Buser"] | has["Bassistant"], "B").otherwise("unknown"))


def drop_noise(c: Column) -> Column:
    for p in DROPPED:
        c = F.regexp_replace(c, p, "")
    return c


def _role(line: str) -> str | None:
    s = line.strip()
    return next((r for d in (_A, _B) for r, p in d.items() if p.match(s)), None)


def clean_lines(text: str) -> str:
    """Without the system prompt, an assistant's opening line, and more than two empty lines in a row."""
    out: list[str] = []
    hidden, opening, blank = False, False, 0
    for line in text.split("\n"):
        role, bare = _role(line), line.strip()
        if role == "system":
            hidden = True
        elif hidden and (role or bare.startswith("##")):
            hidden = False
        if hidden:
            continue
        if opening and not role:
            if not bare:
                continue
            opening = False
            if OPENING.match(bare):
                continue
        opening = role == "assistant" or (opening and not role)
        blank = 0 if bare else blank + 1
        if blank <= 2:
            out.append(line)
    return "\n".join(out).strip()


def clean(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, format, cleaned."""

    @F.pandas_udf("string")
    def lines(s: pd.Series) -> pd.Series:
        return s.map(clean_lines, na_action="ignore")

    return df.select(key, chat_format(F.col(text)).alias("format"), lines(drop_noise(F.col(text))).alias("cleaned"))


def rounds(cleaned: DataFrame, key: str) -> DataFrame:
    """key, turn, role, content: one row per message; formats other than A are read as B."""
    kind = dict(cleaned.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, f, text in zip(b[key], b["format"], b["cleaned"]):
                marks, role, body, n = (_A if f == "A" else _B), None, [], 0
                for line in [*(text or "").split("\n"), None]:
                    s = "" if line is None else line.strip()
                    hit = next(((r, m.end()) for r in ("user", "assistant") if (m := marks[r].match(s))), None) if line is not None else ("", 0)
                    if hit is None:
                        body.append(line)
                        continue
                    content = "\n".join(body).strip()
                    if role and content:
                        rows.append((k, n, role, content))
                        n += 1
                    role, rest = hit[0], s[hit[1]:].strip().lstrip(":").strip()
                    body = [rest] if rest else []
            yield pd.DataFrame(rows, columns=[key, "turn", "role", "content"])

    return cleaned.select(key, "format", "cleaned").mapInPandas(run, f"`{key}` {kind}, turn int, role string, content string")


def topic_switches(turns: DataFrame, key: str) -> DataFrame:
    """User turns whose beginning differs from the user turn before."""
    u = turns.where("role = 'user'").withColumn("before", F.lag("content").over(Window.partitionBy(key).orderBy("turn")))
    return u.where(F.substring("content", 1, 30) != F.substring("before", 1, 30)).select(key, "turn", F.substring("content", 1, 80).alias("switch"))


def summaries(turns: DataFrame, chats: DataFrame, key: str) -> DataFrame:
    """key, summary: the first question and up to two switches of topic, at most 200 characters."""
    first = turns.where("role = 'user'").groupBy(key).agg(F.min_by("content", "turn").alias("first"))
    sw = topic_switches(turns, key)
    two = sw.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("turn"))).where("n <= 2").groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "switch"))), lambda s: F.concat(F.lit("→ "), F.substring(s["switch"], 1, 60))).alias("sw"))
    j = chats.select(key).distinct().join(first, key, "left").join(two, key, "left")
    s = F.array_join(F.concat(F.array(F.substring("first", 1, 100)), F.coalesce("sw", F.array().cast("array<string>"))), "；")
    s = F.when(F.col("first").isNull(), EMPTY).otherwise(s)
    return j.select(key, F.when(F.length(s) > 200, F.concat(F.substring(s, 1, 197), F.lit("..."))).otherwise(s).alias("summary"))
