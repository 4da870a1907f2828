import base64
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

import quire.plans.store as stores
from quire.cli import run
from quire.operators.errata import merge_stats, payload, read_stats, trust
from quire.operators.fulltext import rank, rank_postings
from quire.operators.images import best_reading, ocr, references, remap, resolve, with_ocr
from quire.plans.store import Store
from quire.sources.config import Config
from quire.sources.files import binary_files, refused


@pytest.fixture()
def store(spark, tmp_path):
    d = tmp_path / "shelf" / "geology"
    d.mkdir(parents=True)
    (d / "stones.md").write_text("# Chapter 1 Basalt\n" + "The basalt of the canal. " * 30 + "\n\n# Chapter 2\nGranite and  more granite here.")
    (d / "river.md").write_text("A river of granite.")
    at = str(tmp_path / "store")
    assert run(spark, [at, "import", str(tmp_path / "shelf"), "--bucket", "b", "--tags", "minerals"]) == (0, {"books": 2})
    return at, tmp_path


def test_life_of_a_store(spark, store):
    at, tmp = store
    assert run(spark, [at, "import", str(tmp / "shelf"), "--bucket", "b"])[1] == {"books": 0}
    books = {b["title"]: b for b in run(spark, [at, "list"])[1]}
    assert set(books) == {"stones", "river"} and books["river"]["tags"] == "minerals,geology" and books["river"]["chunks"] == 1
    code, got = run(spark, [at, "search", "granite", "--tags", "geology"])
    assert {r["title"] for r in got["results"]} == {"stones", "river"} and got["search_meta"]["degraded"]
    guid = books["stones"]["guid"]
    r = run(spark, [at, "read", guid.upper(), "1", "--context", "9"])[1]
    assert "" in r["chunks"][-1]["text"] and r["text_trust"].startswith("pua")
    assert run(spark, [at, "read", guid, "99"])[0] == 1
    assert run(spark, [at, "tag", guid, "--add", "rocks", "--remove", "minerals"])[1] == ["geology", "rocks"]
    assert run(spark, [at, "tag", "--audit"])[0] == 0
    assert {(t["tag"], t["n"]) for t in run(spark, [at, "tags"])[1]} == {("geology", 2), ("minerals", 1), ("rocks", 1)}
    m = tmp / "m.jsonl"
    m.write_text(json.dumps({"match": {"guid": guid}, "errata": {"pua": 9, "odd": 1}, "note": "n", "source": "import:a"}) + "\n")
    assert run(spark, [at, "annotate", "--from", str(m), "--yes"])[1]["counts"] == {"matched": 1}
    r = run(spark, [at, "read", guid, "1"])[1]
    assert "pua: 9" in r["text_trust"] and r["text_errata"]["counts"]["pua"] == 9 and r["text_errata"]["glossary"]["pua"]["label"] == "private characters" and "note (import:a): n" in r["text_note"]
    assert run(spark, [at, "annotate", "-g", guid])[0] == 2 and run(spark, [at, "annotate", "-g", "none", "-u"])[0] == 1
    assert run(spark, [at, "annotate", "-p", str(tmp / "shelf/geology/stones.md"), "-u", "by hand", "--replace", "-y"])[1]["counts"] == {"matched": 1}
    assert run(spark, [at, "read", guid, "1"])[1]["text_note"].startswith("not computed")
    assert run(spark, [at, "rm", "--guid", guid])[1]["removed"]["book"] == 1 and len(run(spark, [at, "list"])[1]) == 2
    assert run(spark, [at, "rm", "--guid", guid, "--yes"])[0] == 0 and len(run(spark, [at, "list"])[1]) == 1
    assert run(spark, [at, "rm"])[0] == 2 and run(spark, [at, "reset"])[0] == 1 and run(spark, [at, "reset", "--yes"])[0] == 0 and run(spark, [at, "buckets"])[1] == []


def test_chats_and_notes(spark, tmp_path):
    (tmp_path / "c").mkdir(), (tmp_path / "n").mkdir()
    (tmp_path / "c/a.md").write_text("**user**: Hello?\n**assistant**: Yes.")
    (tmp_path / "n/a.md").write_text("---\ntitle: T\n---\nbody")
    (tmp_path / "n/_b.md").write_text("hidden")
    at = str(tmp_path / "s")
    assert run(spark, [at, "chat", str(tmp_path / "c")])[1] == {"chats": 1} and run(spark, [at, "onenote", str(tmp_path / "n")])[1] == {"notes": 1}
    assert {b["table"] for b in run(spark, [at, "buckets"])[1]} == {"chat", "note"}
    assert run(spark, [at, "clean-chat", str(tmp_path / "c/a.md")])[1]["summary"] == "Hello?"


def test_payload_and_note():
    s = {"criteria_version": "v1", "words": 200, "hyphen_break": 3, "pua": 0, "cjk_halluc": 5, "not_applicable": ["cjk_halluc"], "mine": 2, "glossary": {"mine": "own"}, "notes": [{"source": "a", "text": "b"}]}
    p = payload(s)
    assert set(p["glossary"]) == {"hyphen_break", "mine"} and p["notes"] and payload({}) == {} == payload(None) and read_stats("[1]") == {} == read_stats("{")
    t = trust(s, "ocr")
    assert "words cut at a line end: 3 (1.5 % of the words)" in t and t.startswith("recognised from images") and "note (a): b" in t and trust({}).startswith("not computed")
    assert "no signal" in trust({"criteria_version": "v1"}, "txt")


def test_merge_stats():
    a = merge_stats({"pua": 1}, {"pua": 3, "odd": 2, "mine": 4}, "s", "text", {"mine": "why"})
    assert a["pua"] == 3 and a["mine"] == 4 and a["unregistered"] == [{"key": "odd", "value": 2, "source": "s"}]
    assert merge_stats(a, {}, "s", "text")["notes"] == [{"source": "s", "text": "text"}]


def test_images(spark):
    docs = spark.createDataFrame([(1, "![a](/res/h1)\n<details>\n<summary>i</summary>\n\nd\n</details>\n![b](h2.png) ![c](h3.png)")], "id int, text string")
    refs = references(docs, "id", "text")
    files = spark.createDataFrame([(1, "h2", "images/h2.png"), (9, "h3", "far/h3.png")], "id int, hash string, path string")
    got = resolve(refs, spark.createDataFrame([(1, "/res/h1", "images/x.jpg")], "id int, ref string, path string"), files, "id")
    assert sorted((r["path"], r["how"]) for r in got.collect()) == [("far/h3.png", "elsewhere"), ("images/h2.png", "beside"), ("images/x.jpg", "described")]
    assert remap(docs, got, "id", "text").first()["text"] == "![a](images/x.jpg)\n![b](images/h2.png) ![c](far/h3.png)"
    imgs = spark.createDataFrame([("m1", b"ok"), ("m2", b"bad"), ("m1", b"ok")], "md5 string, bytes binary")

    def reader(b):
        if b == b"bad":
            raise ValueError
        return b.decode()

    assert sorted(tuple(r) for r in ocr(imgs, reader).collect()) == [("m1", "ok"), ("m2", None)] and ocr(imgs, None).where("ocr_text is not null").count() == 0
    assert with_ocr("![a](x)\ntext ![a](x)", {"x": "read\nthis"}) == "![a](x)\n> 📝 OCR: read this\ntext ![a](x)"
    r = spark.createDataFrame([("i", 0, "en", 0, "a", 0.2), ("i", 1, "zh", 1, "c", 0.9), ("i", 1, "zh", 0, "b", 0.8)], "image string, language_order int, language string, line int, text string, confidence double")
    assert tuple(best_reading(r).first()) == ("i", "zh", "b\nc")


def zipped(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, c in members.items():
            z.writestr(n.replace("__", "/"), c)
    return b.getvalue()


def test_import_of_every_kind_of_file(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_bytes("天文台的观测记录。".encode("gb18030"))
    (d / "b.zip").write_bytes(zipped(**{"w__markdown.md": "# One\nA quarry of slate.", "w__images__p.png": "p"}))
    (d / "c.epub").write_bytes(zipped(**{"OPS__x.xhtml": "<p>An orchard &amp; a mill.</p>", "mimetype": "application/epub+zip"}))
    (d / "d.zip").write_bytes(b"no archive"), (d / "e.zip").write_bytes(zipped(**{"other.md": "x"})), (d / "f.zip").write_bytes(zipped(**{"..__x": "y"}))
    (d / "g.md").write_bytes(b"\xef\xbb\xbfmarked"), (d / "h.md").write_bytes("wide".encode("utf-16"))
    at = str(tmp_path / "s")
    assert run(spark, [at, "import", str(d), "--no-dir-tag"])[1] == {"books": 5}
    got = {r["content"].strip() for r in Store(spark, at).table("chunk").select("content").collect()}
    assert {"天文台的观测记录。", "An orchard & a mill.", "marked", "wide"} <= got and any("quarry of slate" in x for x in got)
    assert sorted((r["path"][-5:], r["problem"].split(":")[0]) for r in refused(binary_files(spark, str(d))).collect()) == [("d.zip", "broken"), ("e.zip", "no markdown.md"), ("f.zip", "unsafe")]


def test_adding_writes_only_what_is_added(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"))
    row = lambda *ids: spark.createDataFrame([(i, "a b") for i in ids], "chunk_id bigint, content_tokenized string")
    s.append("fts", row(1, 2))
    before = s.table("fts")
    first = s._state("fts")[1]
    s.append("fts", row(3))
    n, parts = s._state("fts")
    assert parts[:1] == first and spark.read.parquet(f"{s.path}/fts/{parts[1]}").count() == 1 and s.table("fts").count() == 3
    # a reader of the old state goes on; two writers upon one state: the later one is told
    assert before.count() == 2 and not s._commit("fts", n - 1, []) and s._state("fts")[0] == n
    s.change("fts", lambda t: t.where("chunk_id <> 2"))
    assert sorted(r[0] for r in s.table("fts").select("chunk_id").collect()) == [1, 3] and before.count() == 2
    assert s.vacuum() == 2 and s.table("fts").count() == 2
    monkeypatch.setattr(stores, "MOST_PARTS", 2)
    s.append("fts", row(7)), s.append("fts", row(8))
    assert len(s._state("fts")[1]) == 1 and s.table("fts").count() == 4


def test_many_missing_books_are_counted(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "NAMED", 2)
    r = Store(spark, store[0]).remove(spark.createDataFrame([(f"none{i}",) for i in range(5)], "guid string"), dry_run=True)
    assert r["missing_count"] == 5 and r["missing"] == ["none0", "none1"] and not any(r["removed"].values())


def test_search_of_all_kinds_of_documents(spark, tmp_path):
    for kind in "bcn":
        (tmp_path / kind).mkdir()
    (tmp_path / "b/book.md").write_text("# Slate\nThe quarry of slate.")
    (tmp_path / "c/chat.md").write_text("**user**: Where is the quarry?\n**assistant**: By the river, slate everywhere.")
    (tmp_path / "n/note.md").write_text("---\ntitle: Slate\n---\nslate slate quarry")
    vector = lambda t: [float(t.count("slate")) + 0.1, 1.0]
    s = Store(spark, str(tmp_path / "s"), embed=vector, rerank=lambda q, texts: [float(len(t)) for t in texts], dims=2)
    s.import_books(str(tmp_path / "b"), "shelf"), s.import_chats(str(tmp_path / "c")), s.import_notes(str(tmp_path / "n"), tags="own")
    r = s.search("slate quarry")
    got = {x["category"]: x for x in r.results.collect()}
    assert set(got) == {"book", "chat", "onenote"} and got["chat"]["source"] == "both" and got["onenote"]["source"] == "fulltext" and got["onenote"]["snippet"] == "slate slate quarry"
    assert [x["category"] for x in s.search("slate", category="onenote").results.collect()] == ["onenote"]
    assert [x["category"] for x in s.search("slate", tags="own").results.collect()] == ["onenote"] and s.search("slate", bucket="shelf").results.count() == 1
    with pytest.raises(ValueError):
        s.search("slate", category="mail")
    # the store's own index gives what a scan gives
    t = {n: s.table(n) for n in ("fts", "posting")}
    assert rank_postings(t["posting"], ["slate", "the"], None).collect() == rank(t["fts"], ["slate", "the"], None).collect()
    near = s.find_books("slate")
    assert [b["title"] for b in near["books"].collect()] == ["book"] and near["signal"].first()["corpus_books"] == 1 and s.find_books("slate", bucket="none")["books"].count() == 0
    assert run(spark, [s.path, "find-book", "slate"])[0] == 1
    s.remove(s.under(str(tmp_path / "b")))
    assert s.table("card").count() == s.table("posting").count() == 0


def test_settings_and_composed_titles(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/café.md").write_text("slate of the quarry"), (tmp_path / "b/plain.md").write_text("slate")
    s = Store(spark, str(tmp_path / "s"), config=Config({"search": {"stopwords": ["slate"], "default_tags": "kept"}, "chunking": {"max_per_book": 1}}))
    s.import_books(str(tmp_path / "b"), "shelf", tags="kept", directory_tag=False)
    assert {r["title"] for r in s.table("book").select("title").collect()} == {"café", "plain"}
    r = s.search("slate quarry")
    assert r.meta["query_terms"] == {"kept": ["quarry"], "pruned": ["slate"]} and r.results.count() == 1
    s.config.values["search"]["default_tags"] = "other"
    assert s.search("quarry").results.count() == 0 and s.search("quarry", tags="kept").results.count() == 1


def test_images_of_books(spark, tmp_path):
    png, gif = b"\x89PNG\r\n one", b"GIF89a two"
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.zip").write_bytes(zipped(**{"w__markdown.md": "before\n![x](images/p.png)\nafter", "w__images__p.png": png, "w__images__q.txt": "text"}))
    (d / "b.md").write_text("see ![y](data:image/gif;base64," + base64.b64encode(gif).decode() + ") here"), (d / "c.md").write_text("none")
    seen = []

    def reader(raw):
        return raw[-3:].decode()

    s = Store(spark, str(tmp_path / "s"), reader=reader)
    assert s.import_books(str(d), "shelf") == 3 and not seen
    got = {r["title"]: r["content"] for r in s.table("book").select("title", "content").collect()}
    md5 = hashlib.md5(gif).hexdigest()
    assert got["a"] == "before\n![x](images/p.png)\n> 📝 OCR: one\nafter" and got["b"] == f"see ![y](images/{md5}) here\n> 📝 OCR: two" and got["c"] == "none"
    assert sorted((r["suffix"], r["ocr_text"]) for r in s.table("image").collect()) == [(".gif", "two"), (".png", "one")]
    assert run(spark, [s.path, "images"])[1]["unused"] == 0
    s.remove(s.table("book").where("title = 'b'").select("guid"))
    assert run(spark, [s.path, "images", "--yes"])[1]["unused"] == 1 and s.table("image").count() == 1
    assert Store(spark, str(tmp_path / "t")).import_books(str(d), "shelf") == 3
