"""Text-quality statistics and their merging."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import ACCENTED, CYRILLIC, GREEK, LATIN, LETTER, count_matches, kangxi_count, pua_count

VERSION = "v1"
GATE = 0.05
HAN_LETTER = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
#: reported signals in order
SIGNALS = ["script_mix", "accented_latin", "hyphen_break", "cjk_halluc", "kangxi_radical", "pua"]


#: what a signal means and why it matters to who quotes the text
MEANING = {
    "script_mix": ("words of several scripts", "letters of another script stand within a word", "searches for the word miss it and names may be wrong"),
    "accented_latin": ("Latin accents in Cyrillic words", "a Cyrillic word holds an accented Latin vowel", "the accent may be a misread letter"),
    "hyphen_break": ("words cut at a line end", "a word was cut and never joined", "searches for the whole word miss it"),
    "cjk_halluc": ("Han runs in a text of another script", "runs of Han characters where the text has none", "they may have been made up in recognition"),
    "kangxi_radical": ("radicals for characters", "radical forms stand for the characters they look like", "searches for the character miss it"),
    "pua": ("private characters", "characters without a public meaning", "what they showed is lost"),
}
#: signals that are told as a share of the words too
OF_WORDS = ("script_mix", "accented_latin", "hyphen_break")
_OWN = ("criteria_version", "not_applicable", "chars", "words", "notes", "glossary", "unregistered", *SIGNALS)


def read_stats(stats_json: str | None) -> dict:
    """Statistics as stored; what isn't a JSON object counts as none."""
    try:
        got = json.loads(stats_json or "{}")
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def payload(stats: dict | None) -> dict:
    """A book's statistics for who reads it: counts, notes and an explanation of each signal that fired. Empty if they were
    never computed. Keys from outside are explained by the glossary they came with, or said to be unexplained."""
    if not stats or not stats.get("criteria_version"):
        return {}
    off = set(stats.get("not_applicable") or [])
    out = {"criteria_version": stats["criteria_version"], "counts": {k: stats[k] for k in ("chars", "words", *SIGNALS) if k in stats}}
    out |= {k: list(stats[k]) for k in ("not_applicable", "notes") if stats.get(k)}
    told = {k: dict(zip(("label", "what", "harm"), MEANING[k])) for k in SIGNALS if (stats.get(k) or 0) > 0 and k not in off}
    own = stats.get("glossary") or {}
    told |= {k: {"label": k, "what": own.get(k, "not registered; no explanation")} for k, v in stats.items() if k not in _OWN and (v or k in own)}
    return out | ({"glossary": told} if told else {})


def trust(stats: dict | None, parse_mode: str | None = None) -> str:
    """What a reader is told about a book's text: how it was read, what was found and what people noted. No signal isn't the
    same as no error, and not computed isn't the same as none."""
    p = payload(stats)
    if not p:
        return "not computed: the absence of counts says nothing about errors"
    how = {"txt": "text layer", "ocr": "recognised from images"}.get(parse_mode or "", parse_mode or "unknown way of reading")
    found, words = [], stats.get("words") or 0
    for k, g in p.get("glossary", {}).items():
        v = stats.get(k)
        if isinstance(v, int) and v > 0:
            found.append(f"{g['label']}: {v}" + (f" ({100 * v / words:.1f} % of the words)" if k in OF_WORDS and words else ""))
    lines = [f"{how}; " + ("; ".join(found) if found else "no signal, which covers the listed kinds of error alone")]
    lines += [f"note ({n.get('source', '?')}): {n.get('text', '')}" for n in (stats.get("notes") or [])]
    lines += [f"{k}: {g['what']}" + (f", so {g['harm']}" if "harm" in g else "") for k, g in p.get("glossary", {}).items()]
    if stats.get("unregistered"):
        lines.append("unexplained: " + ", ".join(sorted({str(u.get("key")) for u in stats["unregistered"]})))
    return "\n".join(lines)


def errata(c: Column) -> Column:
    """A struct of counts. Han runs are no error in a text that is Han anyway; the count is then 0 and listed as not
    applicable, which isn't the same as 0."""
    words = F.regexp_extract_all(c, F.lit(f"{LETTER}+"), 0)
    cyr = lambda w: w.rlike(f"[{CYRILLIC}]")
    lat = lambda w: w.rlike(f"[{LATIN}]")
    grk = lambda w: w.rlike(f"[{GREEK}]")
    mixed = F.size(F.filter(words, lambda w: cyr(w).cast("int") + lat(w).cast("int") + grk(w).cast("int") > 1))
    accented = F.size(F.filter(words, lambda w: cyr(w) & w.rlike(f"[{ACCENTED}]")))
    han = count_matches(c, f"[{HAN_LETTER}]")
    letters = count_matches(c, f"[{CYRILLIC}{LATIN}{GREEK}&&{LETTER}]") + han
    na = F.coalesce(han / F.when(letters > 0, letters), F.lit(0.0)) > GATE
    return F.when(c.isNotNull(), F.struct(
        F.lit(VERSION).alias("criteria_version"), F.length(c).alias("chars"), F.size(words).alias("words"), mixed.alias("script_mix"), accented.alias("accented_latin"),
        count_matches(c, rf"{LETTER}-[ \t]*\n[ \t]*{LETTER}").alias("hyphen_break"), kangxi_count(c).alias("kangxi_radical"), pua_count(c).alias("pua"),
        F.when(na, 0).otherwise(count_matches(c, f"[{HAN_LETTER}]{{2,}}")).alias("cjk_halluc"),
        F.when(na, F.array(F.lit("cjk_halluc"))).otherwise(F.array().cast("array<string>")).alias("not_applicable")))


def fired(e: Column) -> Column:
    """Names of the signals that occurred, in the order of the list."""
    return F.filter(F.array(*[F.when((e[s] > 0) & ~F.array_contains(e["not_applicable"], s), s) for s in SIGNALS]), lambda x: x.isNotNull())


def merge_stats(old: dict | None, new: dict | None, source: str, text: str | None = None, glossary: dict[str, str] | None = None) -> dict:
    """Statistics of a book with an annotation: counts and versions overwrite, notes add up (each source and text once),
    explanations join, and a key nobody explains is kept aside as unregistered."""
    out, own = dict(old or {}), {"criteria_version", "not_applicable", "chars", "words", *SIGNALS}
    if glossary:
        out["glossary"] = {**out.get("glossary", {}), **glossary}
    known = own | set(out.get("glossary", {}))
    odd = [{"key": k, "value": v, "source": source} for k, v in sorted((new or {}).items()) if k not in known]
    out |= {k: sorted(set(v or [])) if k == "not_applicable" else v for k, v in (new or {}).items() if k in known}
    if odd:
        out["unregistered"] = [*out.get("unregistered", []), *odd]
    remark = {"source": source, "text": text}
    if text and remark not in out.get("notes", []):
        out["notes"] = [*out.get("notes", []), remark]
    return out


def note(stats_json: Column) -> Column:
    """What a reader is told: not computed, the signals that fired, or clean (which isn't a guarantee). Broken JSON counts
    as not computed."""
    v = F.try_parse_json(F.coalesce(stats_json, F.lit("")))
    counts = F.concat_ws(", ", *[F.when(F.try_variant_get(v, f"$.{s}", "int") > 0, F.concat(F.lit(f"{s}: "), F.try_variant_get(v, f"$.{s}", "int"))) for s in SIGNALS])
    computed = F.try_variant_get(v, "$.criteria_version", "string").isNotNull()
    return F.when(~F.coalesce(computed, F.lit(False)), "not computed").when(counts != "", counts).otherwise("computed, no signal; other errors remain possible")
