"""Texts to vectors in batches, with what a model can't take in one piece rejected, cut off or averaged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import token_estimate
from quire.operators.vectors import weighted_mean

BATCH = 32
MODES = ("reject", "truncate", "average")


def estimate(text: str) -> int:
    """As token_estimate, on one text."""
    han = sum("㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿" for c in text)
    return han + (len(text) - han) // 3


def parts(text: str, limit: int) -> list[str]:
    """The text in order, in parts of at most `limit` estimated tokens, cut between graphemes."""
    out, now, han, other = [], [], 0, 0
    for m in regex.finditer(r"\X", text):
        g = m[0]
        h = int(len(g) == 1 and estimate(g) == 1)
        if now and han + h + (other + (len(g) if not h else 0)) // 3 > limit:
            out.append("".join(now))
            now, han, other = [], 0, 0
        now.append(g)
        han, other = han + h, other + (0 if h else len(g))
    return out + ["".join(now)] if now else out


def oversized(text: Column, limit: int) -> Column:
    return token_estimate(text) > limit


def embed_texts(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], limit: int = 8192, mode: str = "average", batch: int = BATCH) -> DataFrame:
    """key, embedding. A batch's vectors must be as many as its texts. mode: `reject` fails on a text over the limit,
    `truncate` takes its first part, `average` takes all parts and their mean weighted by length, scaled to length 1."""
    if mode not in MODES:
        raise ValueError(f"mode: one of {', '.join(MODES)}")
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            todo = []
            for k, t in zip(b[key], b[text]):
                cut = parts(t, limit) if estimate(t) > limit else [t]
                if len(cut) > 1 and mode == "reject":
                    raise ValueError(f"{key} {k}: about {estimate(t)} tokens, the limit is {limit}")
                todo += [(k, float(len(p)), p) for p in (cut[:1] if mode == "truncate" else cut)]
            for i in range(0, len(todo), batch):
                some = todo[i : i + batch]
                got = embed([p for _, _, p in some])
                if len(got) != len(some):
                    raise ValueError(f"{len(got)} vectors for {len(some)} texts")
                yield pd.DataFrame({key: [k for k, _, _ in some], "weight": [w for _, w, _ in some], "vector": [[float(x) for x in v] for v in got]})

    v = rows.select(key, text).where(F.col(text).isNotNull() & (F.trim(text) != "")).mapInPandas(run, f"`{key}` {kind}, weight double, vector array<double>")
    return weighted_mean(v, [key], "vector", "weight").select(key, F.transform("mean", lambda x: x.cast("float")).alias("embedding"))
