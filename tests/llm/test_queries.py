"""The registered queries on the smallest tables: rows, columns, and SQL where there is some."""

import zlib

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus():
    from concordia.llm import queries

    return queries


@pytest.mark.parametrize("name", ["op4_jaccard_join", "op5_decontaminate", "op6_url_filter"])
def test_sql(spark, corpus, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = corpus.QUERIES[name](spark, SF)
    want = c.sql(corpus.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda x: sorted(tuple(map(str, r)) for r in x)
    assert rows(got.select(*names).collect()) == rows(want.select(*names).fetchall())


def test_folds_and_rows(spark, corpus):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, modulus, fold in (("op1_toxicity", 5, 0), ("op7_quality", 3, 1), ("op9_language", 3, 1)):
        got = corpus.QUERIES[name](spark, SF).collect()
        assert len(got) == n
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == fold) and 0 <= r.score <= 1 for r in got)
    for name in ("op2_media", "op3_mixing", "op8_sharding", "op10_pii"):
        assert corpus.QUERIES[name](spark, SF).count() == n


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
    got = corpus_pipeline.run(spark, SF)
    assert 0 < got.count() <= 3 * docs.count() and "shard" in got.columns
