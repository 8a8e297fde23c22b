"""Rows with equal texts lie side by side, whatever their ids, sources and languages."""

import random

from concordia.llm import sharding


def test_copies_lie_together(spark):
    r = random.Random(2)
    rows = [(i, f"copy {i % 40}" if i % 3 else f"text {i} " * r.randint(1, 50), r.choice("ab"), r.choice(["s1", "s2", None])) for i in range(900)]
    rows += [(None, "copy 1", "a", "s2"), (950, None, "a", "s1"), (7, "", "b", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    placed = sorted((p.position, p.size, p.text_crc32) for p in sharding.order_documents(docs).collect())
    assert [p[0] for p in placed] == list(range(len(rows)))
    texts = [p[1:] for p in placed]
    changes = 1 + sum(a != b for a, b in zip(texts, texts[1:]))
    assert changes == len({(x[1] or "") for x in rows})
