"""The ways beyond a size limit give what the usual ways give."""

import random

import numpy as np

from quire.llm import leakage, scans
from tests.llm.test_llm import scan_case


def test_misread_words_by_a_join(spark, monkeypatch):
    df, titles = scan_case(spark)
    usual = {(r["row_id"], r["kind"]) for r in scans.noise(df, titles)[0].collect()}
    monkeypatch.setattr(scans, "MOST_SENT", 0)
    assert {(r["row_id"], r["kind"]) for r in scans.noise(df, titles)[0].collect()} == usual


def test_repair_by_a_join(spark, monkeypatch):
    df, titles = scan_case(spark)
    more = df.limit(1).selectExpr("table_name", "200L AS row_id", "book", "heading", "is_heading", "'the bot-\nan1st and MONASTCRY <i>b0tanist</i>' AS text")
    df = df.unionByName(more)
    usual = sorted(tuple(r) for r in scans.repair(df, titles).select("row_id", "repaired").where("text is not null").collect())
    monkeypatch.setattr(scans, "MOST_SENT", 0)
    assert sorted(tuple(r) for r in scans.repair(df, titles).select("row_id", "repaired").where("text is not null").collect()) == usual
    assert (102, "by another botanist and the monastery") in usual


def test_items_in_several_passes(spark, monkeypatch):
    words = ["alpha", "bravo", "cedar", "delta", "ember", "frost", "grove", "haven", "inlet", "joker", "knoll", "lunar", "maple", "noble", "ocean", "prism", "quill", "raven", "stone", "tulip"]
    texts = [" ".join(words[i:] + words[:i]) + f" marker{i}" for i in range(0, 20, 4)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in enumerate(texts)], "doc bigint, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item bigint, text string")
    usual = {tuple(r) for r in leakage.leaks(docs, "doc", "text", items, "item", "text").select("doc", "item").collect()}
    monkeypatch.setattr(leakage, "ITEMS_A_PASS", 2)
    assert {tuple(r) for r in leakage.leaks(docs, "doc", "text", items, "item", "text").select("doc", "item").collect()} == usual
    assert {(i, i) for i in range(5)} <= usual


def test_frequent_grams_in_parts(spark, monkeypatch):
    text = "one word and one word and one word and then another word and another word to end the very long passage of words"
    docs = spark.createDataFrame([(1, text), (2, "nothing of the sort"), (3, None), (4, "")], "doc bigint, text string")
    items = spark.createDataFrame([(1, text), (2, None)], "item bigint, text string")
    monkeypatch.setattr(leakage, "MOST_PLACES", 1)
    assert {tuple(r)[:2] for r in leakage.leaks(docs, "doc", "text", items, "item", "text").collect()} == {(1, 1)}


def test_band_equals_whole_alignment():
    rng = random.Random(3)
    for _ in range(500):
        a = [rng.randint(0, 8) for _ in range(rng.randint(1, 30))]
        b = [rng.randint(-1, 8) for _ in range(rng.randint(1, 20))] + [x if rng.random() > 0.1 else -1 for x in a[rng.randint(0, len(a) - 1):]] + [-1] * rng.randint(0, 5)
        whole = leakage.repeats(a, b, 0.4, 0.125)
        i = np.arange(len(a))
        assert leakage.repeats(a, b, 0.4, 0.125, np.maximum(0, i - len(a)), np.minimum(len(b), i + len(b))) == whole
        # a band that holds the passage's diagonal finds it, one beside it doesn't
        k = rng.randint(2, 9)
        far = [-1] * k + a
        assert leakage.repeats(a, far, 0.4, 0.125, i + k, i + k + 1) == 1.0
        assert leakage.repeats(a, [50 + x for x in range(k)] + list(range(100, 100 + len(a))), 0.4, 0.125, i, i + 1) == 0.0


def test_words_in_capitals_leak_too(spark):
    text = "Старый монастырь у моста хранил книги о травах и камнях, которые никто не читал с прошлого века"
    docs = spark.createDataFrame([(1, text.upper()), (2, text.title())], "doc bigint, text string")
    items = spark.createDataFrame([(7, text)], "item bigint, text string")
    assert {tuple(r)[:2] for r in leakage.leaks(docs, "doc", "text", items, "item", "text").collect()} == {(1, 7), (2, 7)}
