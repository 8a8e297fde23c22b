"""Runs of letters are read to their end."""

import random

import numpy as np

from concordia.llm import toxicity


def test_long_runs_are_read_to_their_end():
    run = "".join(random.Random(3).choice("abcdefgh") for _ in range(173))
    mask = (1 << 18) - 1
    of = lambda token: set(toxicity.grams([token], mask)[0].tolist())
    got = [of(t) for t in toxicity.tokens_of(f"one {run} two")]
    assert set().union(*got[1:-1]) == of(run) and len(got) > 3
    assert toxicity.tokens_of("a b-c 1") == ["a", "b-c", "1"] and toxicity.tokens_of(None) == []
    short = "-".join(["word"] * 20)
    assert toxicity.tokens_of(short) == [short]
    table = toxicity.np.zeros(mask + 1)
    table[toxicity.grams(["idiot"], mask)[0]] = 1.0
    margins = toxicity.SubwordModel(table, -1.0).scorer()
    found, plain, none = margins(["x" * 60 + "idiot" + "y" * 60, "x" * 125, None])
    assert found > plain == none == -1.0


def test_grams_of_many_tokens_are_those_of_each():
    tokens = ["don't", "a", "", "x1y2zzzz", "Größe", "\nabc", "abc\n", "abc", "日本語テキスト", "__", "a_b_cdef"]
    mask = (1 << 18) - 1
    flat, sizes = toxicity.grams(tokens, mask)
    each = [toxicity.grams([t], mask)[0].tolist() for t in tokens]
    assert sizes.tolist() == [len(x) for x in each]
    assert [sorted(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] == [sorted(x) for x in each]
    counts = dict(zip(tokens, sizes.tolist()))  # of <abc>: 3 of three letters, 2 of four, 1 of five; half-open runs have one mark less
    assert counts["abc"] == 6 and counts["\nabc"] == counts["abc\n"] == 3 and counts["a"] == 1 and counts[""] == counts["__"] == 0
    assert set(each[5]) < set(each[7]) and set(each[6]) < set(each[7])
