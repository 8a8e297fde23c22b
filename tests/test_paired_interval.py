"""The paired bootstrap makes the reference's 10,000 draws and gives interval and verdict."""

import random

import numpy as np

from concordia.operators import metrics
from concordia.plans import queries


def test_resamples_are_draws_in_turn(spark):
    r = random.Random(4)
    rows = [(i, *(r.randint(0, 4) for _ in range(6))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, a_tp long, a_fp long, a_fn long, b_tp long, b_fp long, b_fn long")
    got = metrics.bootstrap_resamples(docs).collect()
    assert sorted(x.draw for x in got) == list(range(1, 10_001))
    c = np.array([x[1:] for x in rows])
    s = c[np.random.default_rng(1).integers(0, 60, (10_000, 60))].sum(1)
    want = 2 * s[:, 3] / (2 * s[:, 3] + s[:, 4] + s[:, 5]) - 2 * s[:, 0] / (2 * s[:, 0] + s[:, 1] + s[:, 2])
    i = metrics.interval(metrics.bootstrap_resamples(docs)).first()
    assert np.allclose([i.mean, i.low, i.high], [want.mean(), *np.percentile(want, (2.5, 97.5))], atol=0.01)
    assert i.verdict == "inconclusive"
    assert metrics.bootstrap_resamples(docs.limit(0)).count() == 0


def test_query(spark):
    i = queries.QUERIES["paired_interval"](spark, "/root/testdata/sf0.001").first()
    assert i.low < i.mean < i.high and i.verdict in ("better", "worse", "inconclusive")
