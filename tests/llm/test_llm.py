import random
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import leakage, markup, mixing, neighbours, scans, splitting
from quire.llm.glyphs import clean, looks
from quire.llm.tokens import TOKENIZER, count_tokens, encoding
from quire.llm.visual import consistent, same_looking_pairs, variants


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- visually identical text

SAME = [("ＡＢＣ１", "ABC1"), ("cafe\u0301", "café"), ("a\u200bb", "ab"), ("a\u00a0b", "a b"), ("раs", "pas"), ("ﬁn", "fin"), ("⽉金", "月金"), ("a‐b", "a-b"), ("so\u00adft", "soft"), ("Α", "A")]
DIFFERENT = [("a1", "a2"), ("Ab", "ab"), ("cafe", "café"), ("x2", "x²"), ("1", "①"), ("a b", "a  b"), ("a\nb", "a b"), ("a—b", "a-b")]


@pytest.mark.parametrize("a,b", SAME)
def test_looks_same(a, b):
    assert looks(a) == looks(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_looks_different(a, b):
    assert looks(a) != looks(b)


@given(st.text())
@settings(max_examples=300, deadline=None)
def test_looks_is_stable(s):
    assert looks(looks(s)) == looks(s) and clean(clean(s)) == clean(s)


def test_case_folds_only_when_asked():
    assert looks("Straße", True) == looks("STRASSE", True) and looks("В", True) == "b"


def test_pairs(spark):
    data = [(1, "abc x"), (2, "аbc x"), (3, "abc x"), (3, "abc x"), (4, "ａbc x"), (5, None), (6, ""), (7, " "), (8, "\u00a0"), (9, "other"), (None, "abc x")] + [(100 + i, "hot copy") for i in range(50)]
    df = spark.createDataFrame([(i, t, "c") for i, t in data], "id bigint, t string, form string")
    got = rows(same_looking_pairs(df.drop("form"), "id", "t"))
    norm = {i: looks(t) for i, t in data if t and t.strip() and i}
    raw = dict((i, t) for i, t in data)
    want = sorted((a, b) for a in norm for b in norm if a < b and norm[a] == norm[b] and raw[a] != raw[b])
    assert got == want == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert {r[0] for r in variants(df, "id", "t").select("id").collect()} == {1, 2, 3, 4}
    assert same_looking_pairs(df.limit(0), "id", "t").count() == 0
    assert rows(consistent(df.where("id in (2, 4, 5)").select("id", "t"), "t", "n").select("id", "n").where("n is not null")) == [(2, "аbc x"), (4, "abc x")]


# ---- markup

KINDS = [
    ("<b>x</b>", {"html"}), ("a <!-- c --> b", {"html"}), ("R&nbsp;D", {"html"}), ("# Head", {"markdown"}), ("a\n===", {"markdown"}), ("- a\n- b", {"markdown"}), ("x **b** y", {"markdown"}),
    ("![a](b.png)", {"markdown"}), ("```\n<b> $x$ \\emph{a}\n```", {"markdown"}), ("|a|b|\n|-|-|\n|1|2|", {"markdown"}), ("== H ==", {"wiki"}), ("'''x'''", {"wiki"}), ("[[a|b]]", {"wiki"}),
    ("{{c|d=1}}", {"wiki"}), ("{| x\n|-\n| a || b\n|}", {"wiki"}), ("\\emph{x}", {"latex"}), ("$x_1$", {"latex"}), ("$$a$$", {"latex"}), ("\\[ a \\]", {"latex"}), ("a.~\\cite{b}", {"latex"}),
    ("here a < b and b > c", set()), ("costs $5 and $7", set()), ("C:\\texts\\new\\frames", set()), ("chunk_seq_no #4", set()), ("see [3].", set()), ("- 12 -", set()), ("5 * 3 * 2 boxes", set()),
    ("~5 kg (x == y)", set()), ("R&D and Q&A", set()), ("{x, y} and 7 > 3", set()), ("C# [1]", set()), ("", set()), ("第3*页写道*：", {"markdown"}), ("of 5\n* 3 * 2", set()),
]


@pytest.mark.parametrize("text,want", KINDS)
def test_markup_kinds(text, want):
    assert markup.kinds(text) == want


def test_structure_is_kept():
    got = markup.render(markup.parse("<div><h2>T</h2><ul><li>a<li>b</ul><table><tr><td>1</td><td>2</td></tr></table></div>\n\nx \\emph{y} $z_1$ [l](u)\n\n```py\n<k>\n```\n\n== W ==\n'''q''' &amp; r"))
    assert got == "## T\n\n- a\n- b\n\n| 1 | 2 |\n\nx y $z_1$ l\n\n```\n<k>\n```\n\n## W\n\nq & r"


@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<td>", "<ul><li>", "```\n", "$$", "**", "# h\n", "\n\n", "text ", "|a|", "> q\n", "{|", "|}", "[[x]]", "&lt;", "\0", "é"]), max_size=30))
@settings(max_examples=200, deadline=None)
def test_markup_never_fails(parts):
    t = "".join(parts)
    markup.kinds(t), markup.render(markup.parse(t))


def test_templates_are_removed(spark):
    nav = "<nav><ul><li>Home<li>About</ul></nav>"
    data = [("t", i, "h", nav + f"<p>page {i}</p>") for i in range(8)] + [("t", 20, "other", nav + "<p>x</p>"), ("t", 21, None, nav), ("t", 22, "h", None), ("t", 23, "h", "")]
    df = spark.createDataFrame(data, "table_name string, row_id bigint, host string, text string")
    got = {r["row_id"]: r["clean"] for r in markup.convert(df, least=5, share=0.1).collect()}
    assert got[3] == "page 3" and got[20].startswith("- Home") and got[21] == "- Home\n- About" and got[22] is None and got[23] == ""
    assert markup.convert(df.limit(0)).count() == 0


def test_templates_of_large_hosts(spark):
    nav = "<nav><ul><li>Home<li>About</ul></nav>"
    data = [("t", i, "h", (nav if i < 100 else "<nav><ul><li>Few</ul></nav>" if i < 150 else "") + f"<p>page {i}</p>") for i in range(1200)]
    got = {r["row_id"]: r["clean"] for r in markup.convert(spark.createDataFrame(data, "table_name string, row_id bigint, host string, text string")).collect()}
    assert got[3] == "page 3" and got[120].startswith("- Few")


# ---- scans


def sure(lines):
    return {i for i, (_, s) in scans.page_lines(lines).items() if s}


@pytest.mark.parametrize("line", ["12", "- 3 -", "— 14 —", "[7]", "Page 3 of 9", "p. 4", "S. 8", "Стр. 2", "第 3 页", "第3页", "xiv", "•40•", "~ 9 ~"])
def test_page_numbers(line):
    assert sure(["text of the page", line, "more"]) == {1}


def test_columns_of_figures_are_no_page_numbers():
    assert sure(["sum:", "12", "14", "900"]) == set() and not scans.page_number("1933.") and not scans.page_number("mild")


def scan_case(spark):
    word = "The glossary of the monastery was surveyed by another botanist again."
    data = [("c", i, "b", "Chapter 3 Quiet harbour > x", False, word) for i in range(30)]
    data += [
        ("c", 100, "b", None, False, "The glos-\nsary of the\nQUIET HARBOUR   17\nmonastery was"), ("c", 101, "b", None, False, "a so-\ncalled gift of the so-called clerk"),
        ("c", 102, "b", None, False, "by another b0tanist and the monastcry"), ("c", 103, "b", None, False, "was\n[12]\nsurveyed"), ("c", 104, "b", None, False, None), ("c", 105, "b", None, False, " "),
        ("c", 106, "b", None, True, "Quiet harbour"), ("c", 107, None, None, False, "QUIET HARBOUR"), ("c", 108, "b", None, False, "The Botanist of Foo 3"), ("c", 100, "b", None, False, "The glos-\nsary of the\nQUIET HARBOUR   17\nmonastery was")]
    df = spark.createDataFrame(data, "table_name string, row_id bigint, book string, heading string, is_heading boolean, text string")
    return df, spark.createDataFrame([("b", "The Botanist of Foo"), ("b", None)], "book string, title string")


def test_noise(spark):
    got = rows(scans.noise(*scan_case(spark))[0])
    assert got == [("c", 100, "hyphen"), ("c", 100, "running"), ("c", 102, "misread"), ("c", 103, "page_number"), ("c", 108, "running")]


def test_repair(spark):
    df, titles = scan_case(spark)
    got = {r["row_id"]: r["repaired"] for r in scans.repair(df, titles).collect()}
    assert got[100] == "The glossary of the monastery was" and got[103] == "was surveyed" and got[102] == "by another botanist and the monastery" and got[104] is None
    assert scans.noise(df.limit(0), titles)[0].count() == 0


# ---- neighbours


def brute(ids, x, k, least=None):
    x = x.astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 7)
    out = {}
    for i in range(len(ids)):
        c = sorted(((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and (least is None or s[i, j] >= least)))[:k]
        out[ids[i]] = [j for _, j in c]
    return out


@pytest.mark.parametrize("least", [None, 0.5])
def test_knn_equals_brute_force(spark, least):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[50]  # a group of exact copies
    x[100] = x[99] * 3
    ids = [int(i) for i in rng.permutation(1000)[:300]]
    data = [(i, [float(y) for y in v], 0) for i, v in zip(ids, x)]
    bad = [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 8, 0), (2003, [float("nan")] * 8, 0), (2004, [1.0] * 7, 0), (ids[0], [9.0] * 8, 5), (ids[1], data[1][1], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(data + bad, "chunk_id bigint, e array<float>, ts int")
    got = {}
    for r in neighbours.knn(df, "chunk_id", "e", 5, 8, "ts", least, block=64).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"]))
    assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == {i: v for i, v in brute(ids, x, 5, least).items() if v}


@pytest.mark.parametrize("least", [None, 0.9])
def test_own_product_takes_no_place(least):
    """k-1 near copies, a k-th neighbour further below them than the products' error, and enough others to prune."""
    rng = np.random.default_rng(4)
    off = rng.normal(size=(60, 63))
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    sim = np.array([1.0] + [0.99] * 9 + [0.92] + [0.905] * 49)
    x = np.hstack([sim[:, None], np.sqrt(1 - sim**2)[:, None] * off]).astype(np.float32)
    ids = np.arange(60)
    row, other, _ = neighbours.tile(ids, x, ids, x, 10, least, False)
    assert set(other[row == 0].tolist()) == set(range(1, 11))


@pytest.mark.parametrize("copies", [9, 10, 11])
@pytest.mark.parametrize("least", [None, 0.9])
def test_groups_of_near_copies_in_every_mode(spark, copies, least):
    """Groups with one member fewer, as many and one more than k, far apart from each other: no bound may drop a neighbour."""
    rng = np.random.default_rng(copies)
    centre = rng.normal(size=(12, 24))
    x = np.vstack([c + 0.02 * rng.normal(size=(copies, 24)) for c in centre] + [c + 0.12 * rng.normal(size=(3, 24)) for c in centre]).astype(np.float32)
    ids = [int(i) for i in rng.permutation(1000)[: len(x)]]
    want = {i: v for i, v in brute(ids, x, 10, least).items() if v}
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in zip(ids, x)], "id bigint, e array<float>")

    def found(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"]))
        return {i: [n for _, n in sorted(v)] for i, v in out.items()}

    a = np.asarray(ids)
    row, other, sim = neighbours.tile(a, x, a, x, 10, least, False)
    one = {}
    for i, j, v in zip(row.tolist(), other.tolist(), sim.tolist()):
        one.setdefault(i, []).append((-v, j))
    assert {i: [j for _, j in sorted(v)] for i, v in one.items()} == want
    assert found(neighbours.knn(df, "id", "e", 10, 24, min_sim=least)) == want
    assert found(neighbours.knn(df, "id", "e", 10, 24, min_sim=least, block=40)) == want
    assert found(neighbours.knn(df, "id", "e", 10, 24, min_sim=least, block=40, queries=F.col("id") % 2 == 0)) == {i: v for i, v in want.items() if i % 2 == 0}


def test_knn_keeps_no_copies_per_block(spark, tmp_path):
    """What is shuffled and stored stays below five times the vectors, though they make 20 blocks, and no neighbour is lost."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    x[1000:] = x[:1000] + 0.05 * rng.normal(size=(1000, 64)).astype(np.float32)
    spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id bigint, e array<float>").write.parquet(str(tmp_path / "v"))
    df, sc = spark.read.parquet(str(tmp_path / "v")), spark.sparkContext._jsc.sc()

    def kept():
        sc.listenerBus().waitUntilEmpty(30_000)
        stored = sum(p.stat().st_size for p in Path(sc.getCheckpointDir().get().removeprefix("file:")).rglob("*") if p.is_file())
        return sc.statusStore().executorSummary("driver").totalShuffleWrite() + stored

    want = {i: [(i + 1000) % 2000] for i in range(2000)}
    for queries in (None, F.col("id") % 50 == 0):
        before = kept()
        got = neighbours.knn(df, "id", "e", 10, 64, min_sim=0.9, block=100, queries=queries).collect()
        assert kept() - before < 5 * x.nbytes
        assert {r["id"]: [r["neighbour_id"]] for r in got} == {i: v for i, v in want.items() if queries is None or i % 50 == 0}
        assert len(got) == (2000 if queries is None else 40)


def test_knn_of_a_crowd_of_near_copies(spark):
    """More rows reach `min_sim` than can be listed: each row is sought by its own tasks, and results are those of brute force."""
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(3, 16))[rng.integers(0, 3, 400)] + 0.05 * rng.normal(size=(400, 16))).astype(np.float32)
    ids = [int(i) for i in rng.permutation(1000)[:400]]
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in zip(ids, x)], "id bigint, e array<float>")
    assert neighbours._near(neighbours.blocks(neighbours.usable(df, "id", "e", None, 16), 16, 40, 10), 16, 400, 0.9) > 4 * 3
    got = {}
    for r in neighbours.knn(df, "id", "e", 3, 16, min_sim=0.9, block=40).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"]))
    assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == brute(ids, x, 3, 0.9)


@pytest.mark.parametrize("dims", [2, 8, 24, 64])
def test_short_products_are_never_below(dims):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(700, dims)) * np.linspace(1, 0.1, dims)
    x[350:] = x[:350] + 0.01 * rng.normal(size=(350, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = neighbours._short(x[:300], x[300:], 0.9)
    assert a.shape[1] <= dims + 1 and (a @ b.T - x[:300] @ x[300:].T).min() > -5e-6


def test_products_stay_exact_in_many_dimensions():
    x = np.ones((1, 2000))
    q, _ = neighbours._codes(x, 1 / 127)
    assert (q @ q.T)[0, 0] == 2000 * 127 * 127 and q.dtype == np.float64 and neighbours._codes(x[:, :64], 1 / 127)[0].dtype == np.float32


def test_knn_of_queries_and_nothing(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 41)], "id bigint, e array<float>")
    got = neighbours.knn(df, "id", "e", 3, 2, queries=F.col("id") % 20 == 0).collect()
    assert {r["id"] for r in got} == {20, 40} and len(got) == 6
    assert neighbours.knn(df.limit(0), "id", "e", 3, 2).count() == 0
    assert rows(neighbours.mutual(spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "id bigint, neighbour_id bigint"))) == [(1, 2)]


# ---- leakage

VOCAB = [a + b for a in ("mol", "ter", "fin", "gar", "sul", "pon", "dre") for b in ("aten", "ibor", "ulas", "emit", "orax", "ynde")]


def passage(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def test_leaks_found_and_decoys_left(spark):
    rng = random.Random(5)
    item = passage(rng, 60)
    fill = lambda n: " ".join(passage(rng, n))
    part = item[10:45]
    altered = [w if i % 9 else "zzzzz" for i, w in enumerate(part, 1)]
    docs = [
        (1, fill(40) + " " + " ".join(item) + " " + fill(30)), (2, fill(5) + " " + " ".join(altered).upper()), (3, fill(90)), (4, " ".join(item[:12]) + " " + fill(50)),
        (5, " ".join(rng.sample(item, 60))), (6, fill(9) + " <p>" + ", ".join(part) + "</p>"), (7, " ".join(w[:3] + "-\n" + w[3:] if i % 5 == 0 else w for i, w in enumerate(part))),
        (8, None), (9, ""), (10, " ".join(w if i % 3 else "qqqq" for i, w in enumerate(item))), (11, " ".join(part).replace("a", "а").replace(" ", "\u00a0")), (12, " ".join(part) + " " + fill(3000))]
    han = "松岭港的目录与临时手稿同属南桥州风车沿平岭镇修复海图在同一季节内冒着大雨晶体经反复发现终归入粗糙一类"
    docs += [(13, "前言。" + han[:30] + "，后记"), (14, han[:9] + "别的内容" * 9)]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, han), (5, han)], "item bigint, text string")
    got = rows(leakage.leaks(d.drop("item_id"), "doc_id", "text", e, "item", "text").select("doc_id", "item"))
    assert got == [(1, 1), (2, 1), (6, 1), (7, 1), (11, 1), (12, 1), (13, 4), (13, 5)]
    assert leakage.leaks(d, "doc_id", "text", e.limit(0), "item", "text").count() == 0 == leakage.leaks(d.limit(0), "doc_id", "text", e, "item", "text").count()


@given(st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_filter_loses_no_passage(seed):
    """The bands keep every passage that the alignment accepts."""
    rng = random.Random(seed)
    item = passage(rng, rng.randint(25, 80))
    n = rng.randint(int(len(item) * 0.5), len(item))
    a = rng.randint(0, len(item) - n)
    part = list(item[a : a + n])
    for i in range(4, n, 9):
        part[i] = rng.choice(["xyzzyx", part[i] + " " + "nadir", ""])
    text = " ".join(passage(rng, 30) + part + passage(rng, 30))
    indexes, ids = leakage._build(((1, " ".join(item)),), 0.4, 1 / 8)
    assert [x[:2] for x in leakage._find([(7, text)], indexes, ids, 0.4, 1 / 8)] == [(7, 1)]


@pytest.mark.parametrize("n", [33, 35, 37, 53, 57])
@pytest.mark.parametrize("more", [0, 1, 2, 9])
@pytest.mark.parametrize("added", [0, 1, 2])
def test_filter_keeps_the_full_budget(n, more, added):
    """Passages somewhat longer than the least, with every alteration that plain alignment accepts."""
    ws = [f"{a}{b}" for a in ("molat", "terib", "finul", "garem") for b in ("aten", "ibor", "ulas", "emit", "orax", "ynde", "ikol", "usab", "ofin", "eras", "apum", "ogin", "ulet", "imas", "edor")][:n]
    length = -(-2 * n // 5) + more
    part = list(ws[:length])
    altered = int((length + added) / 8) - added
    if altered < 0:
        pytest.skip("more than the budget")
    for i in range(altered + added):
        at = (i + 1) * length // (altered + added + 1)
        part[at] = f"qqqqqqq{i}" if i < altered else f"qqqqqqq{i} " + part[at]
    text = " ".join(["before"] * 30 + part + ["after"] * 30)
    item, doc = ({w: i for i, w in enumerate(ws)}[w] for w in ws), ({w: i for i, w in enumerate(ws)}.get(w, -1) for w in text.split())
    accepted = leakage.repeats(list(item), list(doc), 0.4, 1 / 8) >= 0.4
    indexes, ids = leakage._build(((1, " ".join(ws)),), 0.4, 1 / 8)
    assert [x[:2] for x in leakage._find([(7, text)], indexes, ids, 0.4, 1 / 8)] == [(7, 1)] * accepted


@given(st.lists(st.integers(0, 4), min_size=1, max_size=20), st.data())
def test_least_distinct(xs, data):
    n = data.draw(st.integers(1, len(xs)))
    assert leakage._least_distinct(xs, n) == min(len(set(xs[i : i + n])) for i in range(len(xs) - n + 1))


# ---- mixing


def test_budgets():
    assert mixing.budgets({"a": 100, "b": 100}, [("a", 1, 1), ("b", 1, 1)], 100) == {"a": 50, "b": 50}
    got = mixing.budgets({"a": 1000, "b": 10}, [("a", 0.5, 2), ("b", 0.5, 3), ("c", 0.1, 2)], 500)
    assert got["b"] == 30 and got["c"] == 0 and got["a"] == pytest.approx(470)


def test_mix(spark):
    rng = random.Random(1)
    data = [(i, "big" if i % 3 else "small" if i % 2 else "tiny", rng.randint(1, 40)) for i in range(3000)] + [(5000, None, 9), (5001, "untargeted", 9), (5002, "small", None), (5003, "small", 0)]
    df = spark.createDataFrame(data, "id bigint, source string, n bigint")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.5, 3), ("tiny", 0.2, 1), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    chosen, report = mixing.mix(df, "id", "source", "n", targets, total=20_000)
    r = {x["source"]: x for x in report.collect()}
    assert set(r) == {"big", "small", "tiny", "absent"} and r["absent"]["tokens"] == 0
    for s in ("big", "small", "tiny"):
        assert r[s]["actual_share"] == pytest.approx(r[s]["target_share"], abs=0.005) and r[s]["tokens"] <= r[s]["target_share"] * 20_000 + 1e-6
    caps = {"big": 1, "small": 3, "tiny": 1}
    got = chosen.collect()
    assert len({x["id"] for x in got}) == len(got) and all(x["copies"] <= caps[x["source"]] for x in got)
    less = {x["id"]: x["copies"] for x in mixing.mix(df, "id", "source", "n", targets, total=10_000)[0].collect()}
    more = {x["id"]: x["copies"] for x in got}
    assert all(more.get(i, 0) >= c for i, c in less.items())  # nested
    assert mixing.mix(df.limit(0), "id", "source", "n", targets)[0].count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "id bigint, t string")
    assert rows(count_tokens(df, "t", ["id"])) == [(1, len(encoding(TOKENIZER).encode_ordinary("hello world"))), (2, 0), (3, 0)]


# ---- splitting


@given(st.lists(st.integers(0, 6), min_size=1, max_size=80), st.data())
@settings(max_examples=100, deadline=None)
def test_range_max(values, data):
    t = splitting.RangeMax(np.array(values))
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    assert t.at(lo, hi) == max(range(lo, hi + 1), key=lambda i: (values[i], i))


@given(st.lists(st.sampled_from(["word ", "Satz. ", "句子。", "\n\n", "# Head\n", "**user**: x\n", "🧑‍💻", "e\u0301", "aaaaaaaa", "\n"]), min_size=1, max_size=150))
@settings(max_examples=60, deadline=None)
def test_pieces_cover_the_text(parts):
    text, e = "".join(parts), encoding(TOKENIZER)
    got = splitting.pieces(text, 40, 6, TOKENIZER)
    if len(e.encode_ordinary(text)) <= 40:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, n, _), (c, d, _, _) in zip(got, got[1:]):
        assert a < c <= b < d
    assert all(len(e.encode_ordinary(text[a:b])) == n <= 40 for a, b, n, _ in got)


def test_cuts_at_the_strongest_boundary():
    text = "one two three. " * 20 + "\n\n# Head\n" + "four five six. " * 20
    a, b, n, s = splitting.pieces(text, 100, 10, TOKENIZER)[0]
    assert s == splitting.HEADING and text[b:].startswith("# Head")


def test_split_long(spark):
    df = spark.createDataFrame([(1, "word " * 3000), (2, "short"), (3, None), (4, ""), (5, "字" * 900), (1, "word " * 3000)], "doc_id bigint, text string").withColumn("piece", F.lit("clash"))
    got = splitting.split_long(df, "doc_id", "text")
    assert {r[0] for r in got.select("doc_id").distinct().collect()} <= {1, 5} and got.where("n_tokens > 1024").count() == 0 and got.where("doc_id = 1 and piece = 0").count() == 2


def test_no_other_part_imports_this_one():
    from pathlib import Path

    root = Path(markup.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert not re.search(r"quire\.llm|from \.+llm", p.read_text()), p


# ---- scans: edges and sequences


def blocks(spark, data):
    return spark.createDataFrame([("b", *r) for r in data], "table_name string, row_id bigint, book string, heading string, is_heading boolean, text string, page int, margin boolean"), spark.createDataFrame(
        [], "book string, title string")


def test_lines_that_repeat_in_margins_run(spark):
    data = [(1, "k", None, False, "OF STONES AND RIVERS", 0, True), (2, "k", None, False, "Of Stones and Rivers  14", 1, True), (3, "k", None, False, "a lone line at the top", 2, True),
            (4, "k", None, False, "words before\nof stones and rivers\nwords after", 3, False), (5, "k", None, False, "an inner line", 4, False), (6, "k", None, False, "an inner line", 5, False),
            (7, "other", None, False, "Of stones and rivers", 0, True), (8, "k", None, True, "Of stones and rivers", 6, True), (9, "k", None, False, "x" * 300, 7, True), (9, "k", None, False, "x" * 300, 7, True),
            (10, None, None, False, None, None, None), (11, "k", None, False, "", None, None)]
    assert rows(scans.noise(*blocks(spark, data))[0]) == [("b", i, "running") for i in (1, 2, 3, 4, 9)]


def test_page_numbers_run_with_the_pages(spark):
    data = [(i, "k", None, False, f"{i + 13}", i, True) for i in range(3)]
    # two figures in the margin, of which one is in the sequence; figures in the middle of a page that happen to be
    data += [(20, "k", None, False, "20\n33", 20, True), (21, "k", None, False, "40\n34", 21, False), (22, "k", None, False, "123456", 22, True), (23, "k", None, False, "- 7 -", None, None)]
    got = scans.noise(*blocks(spark, data))[0]
    assert [r[1] for r in rows(got)] == [0, 1, 2, 20, 23]


def test_misread_words_of_running_lines_are_theirs(spark):
    many = [(i, "k", None, False, "the monastery stood there", i, False) for i in range(20)]
    data = many + [(50, "k", None, False, "The M0nastery", 30, True), (51, "k", None, False, "The Monastery", 31, True), (52, "k", None, False, "The m0nastery\nhad a m0nastery.", 32, True)]
    assert rows(scans.noise(*blocks(spark, data))[0]) == [("b", 50, "running"), ("b", 51, "running"), ("b", 52, "misread"), ("b", 52, "running")]


@pytest.mark.parametrize("line,value", [("xiv", 14), ("XL", 40), ("l2", 12), ("page 7 of 9", 7), ("[- 3 -]", 3), ("Page — 12", 12)])
def test_values_of_page_numbers(line, value):
    assert scans.page_number(line)[0] == value


def test_long_decoration_is_no_page_number():
    assert scans.page_number("-" * 200_000 + "y") is None and scans.page_number("12" + " " * 200_000 + "x") is None


def test_two_confusions_in_long_words():
    w = "donaudampfschifffahrtsgesellschaft"
    assert w in scans.undone(w.replace("o", "0").replace("u", "ii")) and w in scans.undone("d0naudampfschifffahrtsgesel1schaft") and not scans.undone("a1b2c3")


# ---- markup: elements


def test_sorts_are_those_of_elements():
    top = markup.parse("# Head\n\nplain\n\n<div>a $x_1$ `<b>` b</div>\n\n- one\n- two [[l]]")
    assert [(n.kind, n.marks) for n in top] == [("h1", markup.MARKDOWN), ("paragraph", 0), ("div", markup.HTML), ("list", markup.MARKDOWN | markup.WIKI)]
    assert [c.marks for c in top[2].children] == [markup.LATEX | markup.MARKDOWN]
    assert markup.kinds("<table><tr><td>so $x^2$</td><td>328</td></tr></table>") == {"html", "latex"} and markup.kinds("a </div> b") == {"html"} and markup.kinds("`<div>`") == {"markdown"}


def test_nesting_is_no_limit_to_text():
    n = 3000
    assert "core" in markup.render(markup.parse("<div>" * n + "core" + "</div>" * n)) and "core" in markup.render(markup.parse(">" * n + " core"))
    assert markup.inline("\\a{" * 50 + "core" + "}" * 50) == "core" and markup.inline("\\a{b {c} d} \\e{open") == "b {c} d \\e{open"


def test_facts_of_elements(spark):
    df = spark.createDataFrame([("t", 1, "h", "<p>x</p>"), ("t", 1, "h", "<p>x</p>"), ("t", 2, None, "# y"), ("t", 3, "h", None), ("t", 4, "h", ""), ("t", 5, "h", "plain")], "table_name string, row_id bigint, host string, text string")
    assert rows(markup.written_in(markup.elements(df))) == [("t", 1, "html"), ("t", 2, "markdown")]
    assert markup.written_in(markup.elements(df.limit(0))).count() == 0
