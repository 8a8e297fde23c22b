"""The near-duplicate stage goes by five words and 0.8."""

import random

import corpus_pipeline


def test_stage_drops_near_copies_by_five_words(spark):
    r = random.Random(1)
    base = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    near = [f"new{i}" if i in (30, 80, 130, 180) else w for i, w in enumerate(base)]  # five-word similarity 176 / 216, three-word 186 / 210
    far = [f"new{i}" if i in (30, 60, 90, 120, 180) else w for i, w in enumerate(base)]  # 171 / 221
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near))], "doc_id long, text string")
    assert [x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [1]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(far))], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 2
