"""The pipeline's stages on odd rows, clashing names and empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = ("score", "predicted", "row", "n_hit", "items", "spans", "n_words", "size", "copies", "component_id", "hilbert", "shard", "__drop", "p", "token")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    rows = [(90001, None, None, None), (90002, "", "en", "x"), (90003, " \n ", "en", None), (None, "a text without an id " * 5, "en", "x"), (None, "a text without an id " * 5, "en", "x"), (90004, "twice the same row " * 9, "en", "x"), (90004, "twice the same row " * 9, "en", "x"), (90005, "漢字だけの長い文" * 700, "ja", "x"), (90006, "word and other words " * 12_000, "en", "x")]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    both = docs.select("doc_id", "text", "lang", "source").unionByName(more)
    return both.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def test_stages_keep_names_and_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        n = out.count()
        assert n > 0, name
        if name == "sharding":
            assert {"doc_id", "shard", "slot"} <= set(out.columns)
            continue
        assert out.columns == docs.columns, name
        if name != "source_mixing":
            ids = [r.doc_id for r in out.select("doc_id").collect()]
            assert {90001, 90002, 90003, 90005} <= set(ids) and ids.count(None) >= 1, name
            assert n <= docs.count()
        assert {r[0] for r in out.select("score").distinct().collect()} == {"own score"}
        docs = out


def test_stages_on_empty_tables(spark, odd):
    empty = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
