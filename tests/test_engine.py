import base64
import io
import json
import random
import re
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import tags as G
from quire.functions.text import collapse_whitespace, fold_kangxi, front_matter, image_refs, path_key, snippet, visible_len, windows_path
from quire.functions.tokenizer import index_terms, query_terms_col, raw_terms, salvage_terms, split_terms
from quire.operators.chat import chat_format, clean, clean_lines, rounds, summaries
from quire.operators.chunking import Chunker, seen_len, sections
from quire.operators.errata import errata, fired, note
from quire.operators.evaluation import auroc, health_states
from quire.operators.fulltext import postings, rank, rank_postings, write_postings
from quire.operators.ledger import match_manifest, reconcile
from quire.operators.parsed import box01, inline_text, is_footnote
from quire.operators.vectors import nearest
from quire.plans.search import Engine, existence_signal, fuse, per_book, reranked, roll_up, top
from quire.sources.config import Config
from quire.sources.files import UnsafeArchive, archive_members, bare_structure, binary_files, decoded, importable, inline_images, manifest_csv, manifest_jsonl, member_path, root_of


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


CORPUS = ["纯汉字文本", "JDBC接口测试", "第3章节", "a，b。C!", "plain words", "ἄλφα слово café", "🙂 ☃", "\ue000x", "字", "", "   ", "foo_bar2 x.y", "很长的 mixed 文本 with слово 和 more"]


def test_terms(spark):
    assert one(spark, "JDBC接口测试", index_terms) == ["JDBC", "接", "口", "测", "试", "接口", "口测", "测试"]
    assert split_terms("the 会话 的了") == (["会话"], ["the", "的了"]) and split_terms("the of") == (["the", "of"], ["the", "of"]) and split_terms(None) == ([], [])
    assert salvage_terms("a bcd 火山口 efgh ij 天文台观测") == ["天文台观测", "efgh", "bcd"]


@pytest.mark.parametrize("text", CORPUS)
def test_query_terms_are_index_terms(spark, text):
    index, query = one(spark, text, index_terms), one(spark, text, query_terms_col)
    assert set(query) <= set(index) and query == raw_terms(text)
    assert not any(re.search("[一-鿿]", t) and re.search("[^一-鿿]", t) for t in index)


def test_text_functions(spark):
    assert one(spark, "a  b\t\n   c   d  \n\n\n\n```\nx  y  \n```", collapse_whitespace) == "a b\n   c d\n\n```\nx  y\n```"
    assert one(spark, "⽉球", fold_kangxi) == "月球" and one(spark, "a\u200b b\u00a0", visible_len) == 2
    assert one(spark, " a \n b " * 200, snippet).startswith("a b a b") and one(spark, "/mnt/d/a/b.md", windows_path) == "D:\\a\\b.md"
    assert one(spark, "D:\\a\\\\b\\", path_key) == "/mnt/d/a/b" == one(spark, "/mnt/D/a/b", path_key)
    assert one(spark, "![x](a.png) <img src='b.jpg'> ![y](a.png)", image_refs) == ["a.png", "b.jpg"]
    assert one(spark, "---\ntitle: T\nk: 'v'\n---\nbody", front_matter) == {"title": "T", "k": "v"}


def test_tags(spark):
    assert G.for_query(" , ") is None and G.for_query("omnia") is None and G.for_query("a, b") == ["a", "b"]
    for bad in ("OMNIA,a", "a;b", "it's"):
        with pytest.raises(G.TagError):
            G.for_query(bad)
    with pytest.raises(G.TagError):
        G.for_write("a,b", single=True)
    assert "select" in G.reserved_words(spark) and G.for_write(" a , b ") == "a,b"
    assert one(spark, "a, b", lambda c: G.add_col(c, ["b", "c"])) == "a,b,c" and one(spark, None, lambda c: G.remove_col(c, ["b"])) == ""


TEXT = "# 目录\nskip\n## 第一章绪论\n## 第一节\n" + "句子一。" * 30 + "\n```\n# no heading\n```\n\n## Chapter 2\ntiny"


def test_sections_and_paths():
    s = sections(TEXT)
    assert [x.heading for x in s] == ["第一章绪论", "第一节", "Chapter 2"] and "# no heading" in s[1].body
    p = Chunker(500, 700, 100, 80).pieces(TEXT)
    assert p[0].path == "第一章绪论 > 第一节" and len(p) == 1
    assert [x.path for x in Chunker(500, 700, 100, 80, merge_across_chapters=False).pieces(TEXT)][-1] == "Chapter 2"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# h\n", "第2章 x\n", "para one. two! ", "长句子没有标点" * 9, "\n\n", "\n", "e\u0301", "🧑‍💻", "\ue000", "```\n", " "]), max_size=60))
def test_chunk_invariants(parts):
    text = "".join(parts)
    c = Chunker(60, 80, 10, 15)
    got = c.chunks(text)
    assert [x["chunk_seq"] for x in got] == list(range(1, len(got) + 1))
    for x in got:
        assert seen_len(x["content"]) <= 80 and 0 <= x["char_start"] <= x["char_start"] + x["char_len"] <= len(text)
        assert x["byte_len"] == len(text[x["char_start"]: x["char_start"] + x["char_len"]].encode()) and "\ue000" not in x["content"]


CHAT = "**system**: be nice\nmore\n**user**: Was ist das?\n\n**assistant**:\n\n好的，我来解释\nIt is a thing.\n\n\n\n\nend\n**user**: Something else"


def test_chat(spark):
    df = spark.createDataFrame([(1, CHAT), (2, "## User\nhi\n## Assistant\nho"), (3, "none"), (4, None)], "id int, text string")
    assert [r[0] for r in df.orderBy("id").select(chat_format(F.col("text"))).collect()] == ["A", "B", "unknown", "unknown"]
    turns = rounds(clean(df, "id", "text"), "id")
    assert sorted(tuple(r) for r in turns.where("id = 1").collect()) == [(1, 0, "user", "Was ist das?"), (1, 1, "assistant", "It is a thing.\n\n\nend"), (1, 2, "user", "Something else")]
    got = dict(map(tuple, summaries(turns, df, "id").collect()))
    assert got[1] == "Was ist das?；→ Something else" and got[3] == "（空对话）" and clean_lines("") == ""


def test_parsed(spark):
    assert inline_text([{"type": "text", "content": "a"}, "b", {"type": "equation", "content": "x"}, {"type": "table_body", "content": "t"}]) == "ab$x$"
    with pytest.raises(TypeError):
        inline_text([3])
    r = spark.range(1).select(box01(F.array(*map(F.lit, (59.5, 84.1, 595, 841))), "points", F.array(F.lit(595), F.lit(841))).alias("b"), box01(F.array(F.lit(1)), "share").alias("n")).first()
    assert [round(x, 3) for x in r["b"]] == [0.1, 0.1, 1, 1] and r["n"] is None
    rows = [("page_footnote", 0.4, "x"), ("footer", 0.9, "text"), ("text", 0.8, "a note"), ("text", 0.8, "12"), ("text", 0.4, "a note"), ("text", None, "a note")]
    got = spark.createDataFrame(rows, "t string, y double, s string").select(is_footnote(F.col("t"), F.col("y"), F.col("s"))).collect()
    assert [x[0] for x in got] == [True, False, True, False, False, False]


def test_errata(spark):
    e = one(spark, "nуть пахáть дву-\nсмыслен ⽉ \ue000 江南 слово и ещё слова для счёта букв вот так много их тут", errata)
    assert (e["script_mix"], e["accented_latin"], e["hyphen_break"], e["kangxi_radical"], e["pua"]) == (2, 1, 1, 1, 1)
    han = one(spark, "这是中文书", errata)
    assert han["cjk_halluc"] == 0 and han["not_applicable"] == ["cjk_halluc"] and one(spark, None, errata) is None
    assert one(spark, "nуть", lambda c: fired(errata(c))) == ["script_mix"]
    assert one(spark, "{}", note) == "not computed" == one(spark, "{", note) and one(spark, '{"criteria_version": "v1", "pua": 2}', note) == "pua: 2"


def test_ranking_and_fusion(spark):
    fts = spark.createDataFrame([(1, "a b b", 0), (2, "a c", 0), (3, "C c", 0), (3, "zzz", 1), (4, None, 0)], "chunk_id bigint, content_tokenized string, indexed_at int")
    got = {r[0]: r[1] for r in rank(fts, ["b", "c"], None).collect()}
    assert set(got) == {1, 2, 3} and got[3] > got[2]
    ft = spark.createDataFrame([(1, 2.0), (2, 1.0)], "chunk_id bigint, score double")
    vec = spark.createDataFrame([(1, 0.0), (3, 0.5), (4, 1.5)], "chunk_id bigint, distance double")
    f = {r["chunk_id"]: (r["score"], r["source"]) for r in fuse(ft, vec, 0.6, 0.4).collect()}
    assert f == {1: (1.6, "both"), 2: (1.0, "fulltext"), 3: (0.2, "vector"), 4: (0.0, "vector")}
    hits = spark.createDataFrame([("g", 0.5)] * 7 + [("h", 0.4)], "guid string, score double")
    assert sorted(tuple(r) for r in roll_up(hits).collect()) == [("g", 0.7, 7), ("h", 0.4, 1)]


def test_signal(spark):
    d = lambda xs: spark.createDataFrame([(x,) for x in xs], "distance double")
    r = existence_signal(d([0.30, 0.35, 0.40, 0.45, 0.50, 0.60])).first()
    assert (r["corpus_books"], r["top1_distance"], r["gap"]) == (6, 0.3, 0.2) and r["z"] > 0
    assert existence_signal(d([0.3])).first()["z"] == 0 and existence_signal(d([])).first()["corpus_books"] == 0


@pytest.fixture(scope="module")
def engine(spark):
    book = spark.createDataFrame([("g1", "One", "b1", "x,y"), ("g2", "Two", "b2", None)], "guid string, title string, bucket string, tags string")
    chunk = spark.createDataFrame([(1, "g1", "volcano stone"), (2, "g1", "quiet river"), (3, "g2", "volcano river")], "chunk_id bigint, guid string, content string")
    fts = chunk.select("chunk_id", F.col("content").alias("content_tokenized"), F.lit(0).alias("indexed_at"))
    vec = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.7, 0.7], 0)], "chunk_id bigint, embedding array<float>, indexed_at int")
    return Engine(spark, {"book": book, "chunk": chunk, "fts": fts, "vec": vec}, embed=lambda q: [1.0, 0.0], dims=2)


def test_search(engine):
    r = engine.search("volcano")
    got = [(x["chunk_id"], x["source"]) for x in r.results.collect()]
    assert {g for g, _ in got} == {1, 2, 3} and r.meta["fallback"] is None and "rerank: no model" in r.meta["degraded"]
    assert {x["chunk_id"] for x in engine.search("volcano", bucket="b2").results.collect()} == {3}
    assert {x["chunk_id"] for x in engine.search("volcano", tags="x", fulltext_only=True).results.collect()} == {1}


def test_search_fallback_salvage_and_failure(engine):
    r = engine.search("nothing", fulltext_only=True)
    assert r.meta["fallback"] == "vector" and r.results.count() == 3
    broken = Engine(engine.spark, engine.t, embed=lambda q: 1 / 0, dims=2)
    r = broken.search("volc")
    assert r.meta["salvaged"] and {x["source"] for x in r.results.collect()} == {"like"} and any("division" in d for d in r.meta["degraded"])


def test_nearest_ignores_bad_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0])], "chunk_id bigint, embedding array<float>")
    assert [r[0] for r in nearest(v, [1.0, 0.0], 5, ts=None, dims=2).collect()] == [1]


def test_manifest_and_reconcile(spark):
    books = spark.createDataFrame([("g1", None, "/mnt/d/a.md", "T"), ("g2", None, "D:\\b.md", "T")], "guid string, content_md5 string, source_path string, title string")
    m = spark.createDataFrame([("r1", "G1", None, None, None), ("r2", "zz", None, "/mnt/d/b.md", None), ("r3", None, None, None, "T"), ("r4", None, None, None, None)],
                              "row string, guid string, content_md5 string, source_path string, title string")
    assert sorted(tuple(r) for r in match_manifest(m, books).collect()) == [
        ("r1", "g1", "guid", "matched"), ("r2", "g2", "source_path", "matched"), ("r3", None, "title", "refused"), ("r4", None, None, "unmatched")]
    files = spark.createDataFrame([("D:\\a.md",), ("D:\\c.md",)], "path string")
    assert sorted(tuple(r) for r in reconcile(files, books).collect()) == [("/mnt/d/b.md", "extra"), ("/mnt/d/c.md", "missing")]


def test_auroc(spark):
    df = spark.createDataFrame([(1.0, True), (0.5, False), (0.5, True), (0.1, False), (None, True)], "s double, l boolean")
    assert auroc(df, "s", "l").first()["auroc"] == 0.875


def zipped(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, c in members.items():
            z.writestr(n.replace("__", "/"), c)
    return b.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("x")
    (tmp_path / "d/a.zip").write_bytes(zipped(**{"w__markdown.md": "hi", "w__images__p.png": "p", "w__model_output.json": "{}"}))
    (tmp_path / "d/b.txt").write_bytes("中文内容".encode("gb18030"))
    (tmp_path / ".h.md").write_text("x")
    (tmp_path / "c.pdf").write_text("x")
    f = binary_files(spark, str(tmp_path))
    assert sorted(r["name"] for r in importable(f).select("name").collect()) == ["a.zip", "b.txt"]
    assert f.where("name = 'b.txt'").select(decoded("content")).first()[0] == "中文内容"
    assert sorted(r["member"] for r in archive_members(f).collect()) == ["images/p.png", "markdown.md"]
    for bad in ("../x", "/x", "a:b"):
        with pytest.raises(UnsafeArchive):
            member_path(bad)
    assert root_of(["markdown.md"]) == "" and root_of(["w/markdown.md", "w/x"]) == "w/" and root_of(["a/markdown.md", "b/x"]) is None


def test_manifests_and_config(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('# c\n{"match": {"guid": "g"}, "errata": {"pua": 2}}\n')
    r = manifest_jsonl(spark, str(p)).first()
    assert r["match"]["guid"] == "g" and r["errata"] == {"pua": 2}
    c = tmp_path / "m.csv"
    c.write_text("\ufeffguid,errata_pua,note\ng,3,n\n")
    r = manifest_csv(spark, str(c)).first()
    assert r["match"]["guid"] == "g" and r["errata"] == {"pua": 3} and r["note"] == "n"
    (tmp_path / "config.toml").write_text("[search]\nlimit = 3\n")
    cfg = Config.find(env="NOPE", root=str(tmp_path))
    assert cfg.get("search.limit") == 3 and cfg.get("search.x.y", 7) == 7
    with pytest.raises(ValueError):
        Config({}, ("db",))


def test_inline_images(spark):
    good = base64.b64encode(b"pixels").decode()
    df = spark.createDataFrame([(1, f"![a](data:image/png;base64,{good}) ![b](data:image/png;base64,@@@)"), (2, None)], "id int, text string")
    images, docs = inline_images(df, "id", "text")
    assert bytes(images.first()["bytes"]) == b"pixels" and "base64" not in docs.where("id = 1").first()["text"].split("](")[1]


def test_streaming_import(spark, tmp_path):
    from quire.streaming.ingest import watch_folder

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "one.md").write_text("# Chapter 1\n" + "A sentence. " * 40)
    for n in (1, 2):
        watch_folder(spark, str(src), str(out), str(tmp_path / "cp"), once=True).awaitTermination(120)
        b = spark.read.parquet(f"{out}/book")
        assert b.count() == n and b.select("status").distinct().collect()[0][0] == "done"
        have = spark.read.parquet(f"{out}/chunk").groupBy("guid").count()
        assert b.join(have, "guid").where("count <> expected_chunks").count() == 0
        (src / "two.txt").write_text("plain text")


def test_every_query_has_a_schema(spark):
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and json.dumps(sorted(q))
    assert e.entry(spark).count() > 0


def test_rerank_decides_order_and_books(spark):
    hits = spark.createDataFrame([("g", 1, 0.9, "x"), ("g", 2, 0.5, "xxxx"), ("g", 3, 0.4, "xxxxxxxx"), ("h", 4, 0.6, "xxx")], "guid string, chunk_id bigint, score double, content string")
    seen = []

    def model(q, texts):
        return [float(len(t)) for t in texts]

    r = reranked("q", hits, model, most=2)
    assert sorted(x["chunk_id"] for x in r.collect()) == [1, 2, 4] and not seen
    j = hits.join(r.select("chunk_id", "score_rerank"), "chunk_id", "left")
    got = [(x["chunk_id"], x["book_score"], x["book_hit_count"]) for x in per_book(j, 2, 10).collect()]
    assert got == [(2, 4.1, 3), (4, 3.0, 1), (1, 4.1, 3)]
    assert [x["chunk_id"] for x in top("q", hits, model, 2, "chunk_id", "content").collect()] == [3, 2]
    assert [x["chunk_id"] for x in per_book(hits, 1, None).collect()] == [1, 4]


@pytest.mark.parametrize("line", ["好的，  我来解释", "让我先看看", "我来为你整理一下", "根据您的问题", "你的理解是正确的", "这是一个复杂的问题", "很好的问题，", "抱歉，之前说错了", "这确实一个难题"])
def test_openings(line):
    assert clean_lines(f"**assistant**:\n{line}\nThe answer.") == "**assistant**:\nThe answer."


@pytest.mark.parametrize("line", ["好的房子在河边", "我们先看", "问题在于数据", "让我们看数据", "The answer"])
def test_no_openings(line):
    assert line in clean_lines(f"**assistant**:\n{line}\nmore")


def test_structure_files_of_any_size(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"pages": [' + ('{"x": "' + "y" * 1000 + '"},') * 70_000 + '1], "schema": "docvortex.middle"}')
    (tmp_path / "b.json").write_text('{"schema": "other"}'), (tmp_path / "c.json").write_text("{")
    assert [r["schema"] for r in bare_structure(binary_files(spark, str(tmp_path))).collect()] == ["docvortex.middle"]


def test_postings_equal_the_scan(spark, tmp_path):
    fts = spark.createDataFrame([(1, "a b b", 0), (2, "a c", 0), (3, "C c", 0), (3, "zzz", 1), (4, None, 0), (5, "", 0), (None, "a", 0)], "chunk_id bigint, content_tokenized string, indexed_at int")
    write_postings(postings(fts), str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p"))
    for mode in ("nl", "bm25"):
        want = sorted(map(tuple, rank(fts, ["b", "c", "a"], None, mode=mode).collect()))
        assert want and sorted(map(tuple, rank_postings(index, ["b", "c", "a"], None, mode=mode).collect())) == want
    assert rank_postings(index, [], None).count() == 0 and index.where("part = -1").count() == 4
    write_postings(postings(fts.limit(0)), str(tmp_path / "q"))


def test_states_of_health(spark):
    log = [("a", i, o) for i, o in enumerate([None, "bad", "bad", "refused", "bad", "ok", "bad", "bad", "bad", "bad", "ok"])] + [("b", 0, "ok")]
    df = spark.createDataFrame(log, "who string, at int, outcome string")
    got = health_states(df, "who", ["at"], F.col("outcome") == "bad", refused=F.col("outcome") == "refused").where("who = 'a'").orderBy("at").collect()
    assert [r["state"] for r in got] == ["unknown", "degraded", "degraded", "misconfigured", "degraded", "healthy", "degraded", "degraded", "degraded", "down", "healthy"]


def test_auroc_over_many_ranges(spark):
    rng = random.Random(5)
    data = [(rng.choice([rng.random(), 0.5, 0.25]), rng.random() < 0.4) for _ in range(400)]
    want = sum((a > b) + (a == b) / 2 for a, x in data if x for b, y in data if not y) / (sum(x for _, x in data) * sum(not x for _, x in data))
    df = spark.createDataFrame(data + [(None, True), (0.1, None)], "s double, l boolean")
    assert abs(auroc(df, "s", "l").first()["auroc"] - want) < 1e-6 and auroc(df.limit(0), "s", "l").first()["auroc"] is None
