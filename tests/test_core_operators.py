import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quire.operators.drift import Shape, canonical_blocks, canonical_table, deep, deep_text, drift, fused_schema, shapes
from quire.operators.nested import child_table, flatten, merged_schema
from quire.operators.references import Entity, ForeignKey, guid_key, orphan_cascade, orphan_report

D = datetime


def rows(df):
    return sorted(tuple(r) for r in df.collect())


class TestReferences:
    def graph(self, spark, books, chunks, index, gone=()):
        b = spark.createDataFrame(books, "guid string, at timestamp_ntz, row_key string")
        c = spark.createDataFrame(chunks, "id bigint, guid string, at timestamp_ntz")
        i = spark.createDataFrame(index, "id bigint, at timestamp_ntz")
        g = spark.createDataFrame([(x,) for x in gone], "guid string")
        return orphan_cascade(
            [Entity("book", b, guid_key(F.col("guid")), F.col("at")), Entity("chunk", c, F.col("id"), F.col("at")), Entity("index", i, F.col("id"), F.col("at"))],
            [ForeignKey("chunk", "book", guid_key(F.col("guid")), g, salt=3), ForeignKey("index", "chunk", F.col("id"))])

    def test_states_and_inheritance(self, spark):
        t = [D(2024, 1, d) for d in range(1, 10)]
        got = self.graph(
            spark,
            [("{AB}", t[2], "x"), ("ab ", t[4], "x")],
            [(1, " aB", t[3]), (2, "AB", t[0]), (3, "zz", t[3]), (4, "gone", t[3]), (5, None, t[3]), (6, "", t[3]), (1, "ab", t[8]), (2, "AB", t[0])],
            [(1, t[5]), (2, t[5]), (3, t[1]), (9, t[1])], ["gone"])
        assert rows(got.select("table_name", "row_key", "ref_state", "orphan_kind")) == [
            ("chunk", "2", "late", "direct"), ("chunk", "3", "missing", "direct"), ("chunk", "4", "deleted", "direct"),
            ("index", "2", "inherited", "inherited"), ("index", "3", "late", "direct"), ("index", "9", "missing", "direct")]
        assert sum(r["orphans"] for r in orphan_report(got).collect()) == 6

    def test_empty_tables(self, spark):
        assert self.graph(spark, [], [], []).count() == 0
        assert rows(self.graph(spark, [], [(1, "a", D(2024, 1, 1))], []).select("row_key", "ref_state")) == [("1", "missing")]

    def test_cycle_reaches_its_fixpoint(self, spark):
        n = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, None), (5, 4)], "id bigint, up bigint")
        got = orphan_cascade([Entity("n", n, F.col("id"), F.lit(None).cast("timestamp_ntz"))], [ForeignKey("n", "n", F.col("up"))])
        assert rows(got.select("row_key", "orphan_kind")) == [("1", "direct"), ("2", "inherited"), ("3", "inherited")]

    def test_repeated_rows_count_once(self, spark):
        x = D(2024, 1, 1)
        assert self.graph(spark, [], [(1, "a", x)] * 5, [(1, x)] * 3).where("orphan_kind = 'direct'").count() == 1


SHAPE = Shape({"name": {"str"}, "n": {"int"}, "pages": {"list<obj>", "list<>"}},
              sub={"pages": Shape({"blocks": {"list<obj>", "list<>"}}, sub={"blocks": Shape({"type": {"str"}, "bbox": {"list<int>", "list<>"}, "index": {"int"}}, {"level": {"int"}})})})


def block(**kw):
    return {"type": "a", "bbox": [1, 2, 3, 4], "index": 0} | kw


def doc(blocks, **kw):
    return json.dumps({"name": "x", "n": 1, "pages": [{"blocks": blocks}]} | kw)


class TestDrift:
    def test_each_kind_of_change(self, spark):
        data = [(1, doc([block()])), (2, doc([block(bbox=[1.5, 2, 3, 4])])), (3, doc([{"kind": "a", "bbox": [1], "index": 0}])), (4, doc([{"type": "a", "bbox": [1]}])),
                (5, doc([block(score=0.5)])), (6, None), (7, '{"name": '), (8, json.dumps({"name": "x", "n": 1, "page_list": [{"blocks": [block()]}]})), (9, doc([block()], n="1")),
                (7, "x"), (1, doc([block()])), (10, "")] + [(20 + i, doc([block()])) for i in range(5)]
        got, aliases = drift(spark.createDataFrame(data, "id int, raw string"), "id", "raw", SHAPE)
        assert rows(got) == [(2, "pages[].blocks[].bbox", "retyped"), (3, "pages[].blocks[].type", "renamed"), (4, "pages[].blocks[].index", "missing"),
                             (5, "pages[].blocks[].score", "added"), (8, "pages", "renamed"), (9, "n", "retyped")]
        assert aliases[""] == {"page_list": "pages"} and aliases["pages[].blocks[]"] == {"kind": "type"}

    def test_empty(self, spark):
        got, _ = drift(spark.createDataFrame([], "id int, raw string"), "id", "raw", SHAPE)
        assert got.count() == 0

    def test_consistent_blocks(self, spark):
        data = [(1, doc([block(bbox="1,2,3,4")])), (2, doc([{"kind": ["b"], "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "index": "7", "zz": 1}])), (3, doc([{"kind": "c", "bbox": [1], "index": 1}]))]
        df = spark.createDataFrame([(i, r, "clash") for i, r in data], "file_id bigint, raw string, branch string")
        got = canonical_blocks(df, SHAPE, {"pages[].blocks[]": {"kind": "type"}}, "pages")
        assert rows(got.select("file_id", "block_type", "bbox", "block_index", "extra")) == [
            (1, "a", [1, 2, 3, 4], 0, "{}"), (2, "b", [1, 2, 3, 4], 7, '{"zz": 1}'), (3, "c", [1], 1, "{}")]
        assert json.loads(got.where("file_id = 2").first()["typed_branches"]) == {"bbox__obj": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "index__str": "7", "type__list": ["b"]}

    def test_consistent_table_keeps_everything(self, spark):
        from quire.queries.drift import V3, V4

        line = {"box": "1,2,3,4", "spans": [{"content": "words"}], "zz": 1}
        blk = {"type": "text", "bbox": [1, 2, 3, 4], "angle": "90", "index": 1, "lines": [line], "blocks": [{"type": "x"}], "merge_prev": 1, "odd": 2}
        v3 = json.dumps({"pdf_info": [{"page_idx": 0, "page_size": [10, 20], "preproc_blocks": [blk], "discarded_blocks": [], "dpi": 72}], "_backend": "b", "_new": 3, "_ocr_enable": True})
        v4 = json.dumps({"schema": "s", "metadata": {"file_suffix": "pdf", "producer": {"name": "p", "more": 1}, "document": {"languages": "en", "page_count": 10**30}},
                         "pages": [{"page_idx": 0, "blocks": [{"type": "text", "index": 0, "bbox": [0.5, 1], "content": "the \ud800 text"}]}, 7]})
        df = spark.createDataFrame([(1, v3), (2, "{")], "file_id bigint, raw string")
        got = {r["part"]: r.asDict() for r in canonical_table(df, V3, {"pdf_info[].preproc_blocks[].lines[]": {"box": "bbox"}}, "pdf_info").collect()}
        file, page, b = got["file"], got["page"], got["block"]
        assert (file["_backend"], file["_ocr_enable"], json.loads(file["extra"])) == ("b", True, {"_new": 3})
        assert (page["page_idx"], page["page_size"], json.loads(page["extra"])) == (0, [10, 20], {"dpi": 72})
        assert (b["angle"], b["merge_prev"], json.loads(b["blocks"]), json.loads(b["extra"])) == (90, True, [{"type": "x"}], {"odd": 2})
        assert json.loads(b["lines"]) == [{"bbox": [1, 2, 3, 4], "bbox__str": "1,2,3,4", "spans": [{"content": "words"}], "zz": 1}]
        assert json.loads(b["typed_branches"]) == {"angle__str": "90", "merge_prev__int": 1}
        df = spark.createDataFrame([(1, v4)], "file_id bigint, raw string")
        got = {r["part"]: r.asDict() for r in canonical_table(df, V4, {}, "pages").collect()}
        file, b = got["file"], got["block"]
        assert (file["metadata_file_suffix"], file["metadata_producer_name"], file["metadata_document_languages"], file["metadata_document_page_count"]) == ("pdf", "p", ["en"], None)
        assert json.loads(file["extra"]) == {"metadata.producer.more": 1} and json.loads(file["typed_branches"])["pages__list"][1] == 7
        assert json.loads(file["typed_branches"])["metadata.document.page_count__int"] == 10**30
        assert json.loads(b["content"]) == "the \ud800 text"
        assert "content" in canonical_blocks(df, V4, {}, "pages").columns

    def test_fused_schema_splits_conflicts(self, spark):
        df = spark.createDataFrame([(1, '{"a": 1, "b": 1}'), (2, '{"a": "x", "b": 1.5}')], "id int, raw string")
        got = {r["field"]: r["branches"] for r in fused_schema(shapes(df, "id", "raw")).collect()}
        assert sorted(got["a"]) == ["a__int", "a__str"] and got["b"] == ["b"]


    def test_fused_schema_of_any_depth(self, spark, monkeypatch):
        from quire.queries import drift as queries

        deep = '{"a": [' * 5 + '[{"x": 1}, {"x": "s"}]' + "]}" * 5
        df = spark.createDataFrame([(1, deep)], "file_id bigint, raw string")
        monkeypatch.setattr(queries, "spread_table", lambda *_: df)
        got = {r["path"]: sorted(r["branches"]) for r in queries.p1_fused_schema(spark, "").where("field = 'x'").collect()}
        assert got == {".".join(["a[]"] * 5) + "[]": ["x__int", "x__str"]}


    def test_files_nested_too_deep_for_recursion(self, spark):
        far = '{"name": "x", "n": 1, "odd": ' + "[" * 20_000 + "7" + "]" * 20_000 + ', "pages": [{"blocks": []}]}'
        df = spark.createDataFrame([(1, far), (2, far[:-1]), (3, "[" * 20_000)], "file_id bigint, raw string")
        got, _ = drift(df, "file_id", "raw", SHAPE)
        assert rows(got) == [(1, "odd", "added")]
        t = canonical_table(df, SHAPE, {}, "pages").where("part = 'file'")
        assert [r["extra"].count("[") for r in t.collect()] == [20_000]
        # the paths of levels are as long as the levels are deep, so flattening is tested on fewer
        some = '{"odd": ' + "[" * 1_500 + "7" + "]" * 1_500 + "}"
        assert flatten(spark.createDataFrame([(1, some)], "file_id bigint, raw string"), "file_id", "raw").count() == 1_501

    @pytest.mark.parametrize("v", [{"a": [1, 2.5, {"b": None}], "\ud800": "x\"y"}, [], {}, [[[]], {"a": {}}], True, "text"])
    def test_deep_text_and_back(self, v):
        assert deep_text(v) == json.dumps(v, sort_keys=True) and deep(deep_text(v)) == v

    @pytest.mark.parametrize("raw", ["", "[1,]", "{,}", '{"a" 1}', '{"a": 1,}', "[1 2]", "tru", "[1]]", '["\n"]', "01", "{1: 2}", '{"a": }'])
    def test_deep_refuses_what_is_no_json(self, raw):
        assert deep(raw) is None
        with pytest.raises(ValueError):
            json.loads(raw)

    def test_more_signatures_than_names(self, spark):
        # every object has names of its own: nothing but the declared fields is held on the driver
        data = [(i, doc([block(**{f"id_{i}_{j}": 0.5 for j in range(20)})])) for i in range(300)] + [(1000, doc([{"kind": "a", "bbox": [1], "index": 0}]))] * 3
        got, aliases = drift(spark.createDataFrame(data, "id int, raw string"), "id", "raw", SHAPE)
        assert got.where("change_kind = 'added'").count() == 6000 and aliases["pages[].blocks[]"] == {"kind": "type"}
        assert got.where("change_kind <> 'added'").count() == 1


class TestCopies:
    def test_earliest_readable_copy_counts(self, spark):
        data = [("d", '{"v": 3}', 3), ("d", '{"v": ', 1), ("d", '{"v": 2}', 2), ("d", '{"v": 2}', 5), ("e", "[]", 1), (None, "{}", 1), ("f", None, 1)]
        df = spark.createDataFrame(data, "k string, raw string, at int")
        got = flatten(df, "k", "raw", order="at").select("doc_key", F.col("fields")["v"].alias("v"))
        assert rows(got) == [("d", "2")]


class TestNested:
    DOC = {"t": 1, "a": [{"x": 1, "node_key": "q", "b": ["p", "", {"y": None}]}, {"x": 2.5, "o": {"z": True}}, [7]]}

    def test_parents_and_ordinals(self, spark):
        flat = flatten(spark.createDataFrame([("d", json.dumps(self.DOC), 1), ("d", json.dumps(self.DOC), 2), ("n", None, 1), ("e", "{", 1)], "k string, raw string, ordinal int"), "k", "raw")
        got = sorted((tuple(r) for r in flat.select("level_path", "node_key", "parent_key", "ordinal").collect()), key=str)
        assert got == sorted([("$", "d", None, 0), ("$.a[]", "d/a:0", "d", 0), ("$.a[]", "d/a:1", "d", 1), ("$.a[]", "d/a:2", "d", 2), ("$.a[][]", "d/a:2/:0", "d/a:2", 0),
                              ("$.a[].b[]", "d/a:0/b:0", "d/a:0", 0), ("$.a[].b[]", "d/a:0/b:1", "d/a:0", 1), ("$.a[].b[]", "d/a:0/b:2", "d/a:0", 2)], key=str)
        assert {r["node_key"]: r["ordinals"] for r in flat.collect()}["d/a:0/b:2"] == [0, 2]
        assert flatten(spark.createDataFrame([("d", json.dumps(self.DOC))], "k string, raw string"), "k", "raw", levels=r"\$\.a\[\]").count() == 3
        keys = {r[1] for r in got}
        assert all(r[2] is None or r[2] in keys for r in got)

    def test_typed_child_table_with_clashing_names(self, spark):
        flat = flatten(spark.createDataFrame([("d", json.dumps(self.DOC))], "k string, raw string"), "k", "raw")
        types = {r["field"]: r["spark_type"] for r in merged_schema(flat).where("level_path = '$.a[]'").collect()}
        assert types == {"x": "double", "node_key": "string", "o.z": "boolean"}
        t = child_table(flat, "$.a[]")
        assert "node_key_2" in t.columns and rows(t.select("ordinal", "x").where("x is not null")) == [(0, 1.0), (1, 2.5)]

    def test_more_fields_than_columns(self, spark, monkeypatch):
        from quire.operators import nested

        monkeypatch.setattr(nested, "MOST_FIELDS", 1)
        flat = flatten(spark.createDataFrame([("d", '{"a": [{"x": 1, "id7": "p"}, {"x": 2, "id8": "q"}]}')], "k string, raw string"), "k", "raw")
        t = child_table(flat, "$.a[]").orderBy("ordinal")
        assert [(r["x"], r["more_fields"]) for r in t.collect()] == [(1, {"id7": "p"}), (2, {"id8": "q"})]

    def test_child_tables_of_all_levels(self, spark):
        from quire.queries.nested import level_table

        lines = [{"bbox": [1], "spans": [{"content": "x", "score": 1}]}]
        blk = {"type": "t", "bbox": [0], "angle": 0, "index": 0, "lines": lines}
        usual = {"page_idx": 0, "page_size": [1], "preproc_blocks": [blk | {"blocks": [blk]}], "discarded_blocks": [blk]}
        other = {"page_idx": 0, "page_size": [1], "layout_blocks": [blk], "discarded_blocks": []}
        top = {"_version_name": "v", "_backend": "b", "_effort": "e", "_ocr_enable": True}
        data = [(i, json.dumps({"pdf_info": [usual]} | top)) for i in range(3)] + [(9, json.dumps({"pdf_info": [other]} | top))]
        df = spark.createDataFrame(data, "file_id bigint, raw string")
        got = rows(level_table(df, "book_middle", "span").select("doc_key", "branch", "level_path", "score"))
        assert [r for r in got if r[0] == "0"] == [("0", "discarded_blocks", "$.pdf_info[].discarded_blocks[].lines[].spans[]", 1), (
            "0", "preproc_blocks", "$.pdf_info[].preproc_blocks[].blocks[].lines[].spans[]", 1), ("0", "preproc_blocks", "$.pdf_info[].preproc_blocks[].lines[].spans[]", 1)]
        assert [r for r in got if r[0] == "9"] == [("9", "preproc_blocks", "$.pdf_info[].layout_blocks[].lines[].spans[]", 1)] and len(got) == 10
        n = sum(level_table(df, "book_middle", t).count() for t in ("file", "page", "block", "line", "span", "rest"))
        assert n == flatten(df, "file_id", "raw").count()
        v4 = spark.createDataFrame([(1, json.dumps({"pages": [{"page_idx": 0, "blocks": [{"type": "t", "content": [{"content": [{"content": "x"}]}]}]}]}))], "file_id bigint, raw string")
        assert rows(level_table(v4, "middle_json", "content").select("level_path", "content")) == [
            ("$.pages[].blocks[].content[]", None), ("$.pages[].blocks[].content[].content[]", "x")]

    def test_depth_and_empty(self, spark):
        deep = "[" * 400 + "1" + "]" * 400
        flat = flatten(spark.createDataFrame([("d", '{"a": ' + deep + "}")], "k string, raw string"), "k", "raw")
        assert flat.count() == 401 and flatten(spark.createDataFrame([], "k string, raw string"), "k", "raw").count() == 0


@pytest.mark.parametrize("guid", ["ab", " AB ", "{aB}", "\u3000{ab}\ufeff"])
def test_guid_key(spark, guid):
    assert spark.createDataFrame([(guid,)], "g string").select(guid_key(F.col("g"))).first()[0] == "ab"
