import pytest
from pyspark.sql import functions as F

from quire.operators.embedding import embed_texts, estimate, oversized, parts
from quire.operators.ledger import orphan_images


def test_parts():
    t = "字" * 25 + "abc" * 20 + "é" * 9
    got = parts(t, 10)
    assert "".join(got) == t and all(estimate(p) <= 10 for p in got) and parts("", 5) == []


def test_overflow(spark):
    def model(texts):
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "x" * 90), (3, None), (4, " ")], "id int, t string")
    assert [r["id"] for r in df.where(oversized(F.col("t"), 10)).collect()] == [2]
    for mode in ("average", "truncate"):
        got = {r["id"]: r["embedding"] for r in embed_texts(df, "id", "t", model, 10, mode, batch=2).collect()}
        assert set(got) == {1, 2} and sum(x * x for x in got[2]) == pytest.approx(1, abs=1e-6)
    with pytest.raises(Exception, match="limit is 10"):
        embed_texts(df, "id", "t", model, 10, "reject").collect()
    with pytest.raises(ValueError):
        embed_texts(df, "id", "t", model, 10, "other")


def test_orphan_images(spark):
    i = spark.createDataFrame([("a",), ("b",)], "md5 string")
    assert [r[0] for r in orphan_images(i, i.where("md5 = 'a'")).collect()] == ["b"]
