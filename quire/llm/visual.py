"""Texts that look the same but are made of different characters.

The normal form is computed once per distinct value of a batch; only its 128-bit hash and the raw text's hash travel.
Defined results: null and blank texts take no part; identical texts are no pair; of a record's copies each distinct text
counts; an empty table gives no rows; extra columns are ignored; texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.glyphs import clean, looks


def keys(df: DataFrame, key: str, text: str, fold_case: bool = False) -> DataFrame:
    """`key`, form (hash of the normal form), raw (hash of the text) of all texts that aren't blank."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column(1).dictionary_encode()
            forms, raws = [], []
            for t in d.dictionary.to_pylist():
                n = looks(t, fold_case)
                forms.append(xxhash.xxh3_128_digest(n.encode()) if n and not n.isspace() else None)
                raws.append(xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63))
            form, raw = pa.array(forms, pa.binary()).take(d.indices), pa.array(raws, pa.int64()).take(d.indices)
            keep = pc.is_valid(form)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), form.filter(keep), raw.filter(keep)], [key, "form", "raw"])

    return df.select(key, text).where(F.col(text).isNotNull() & F.col(key).isNotNull()).mapInArrow(run, f"{key} {kind}, form binary, raw bigint")


def variants(df: DataFrame, key: str, text: str) -> DataFrame:
    """Members of classes of at least two different texts that read the same: form, `key`, raw. Classes of nothing but
    exact copies, however large, end in the pre-aggregation."""
    k = keys(df, key, text).distinct()
    many = k.groupBy("form").agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi")).where("_lo <> _hi").select("form")
    return k.join(many, "form", "left_semi")


def same_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of records (a < b) whose texts differ only in characters that look the same."""
    v = variants(df, key, text)
    a, b = v.select("form", F.col(key).alias("_a"), F.col("raw").alias("_ra")), v.select("form", F.col(key).alias("_b"), F.col("raw").alias("_rb"))
    return a.join(b, "form").where("_a < _b and _ra <> _rb").select(F.col("_a").alias(f"{key}_a"), F.col("_b").alias(f"{key}_b")).distinct()


def consistent(df: DataFrame, text: str, to: str) -> DataFrame:
    """`df` with the consistent readable form of `text` in `to`; null stays null."""

    @F.pandas_udf("string")
    def form(s):
        d = s.drop_duplicates().dropna()
        return s.map(dict(zip(d, map(clean, d))))

    return df.withColumn(to, form(F.col(text)))
