"""Small cases of preparation, evaluation, assembly and windows that SQL over the tables does not reach."""

import pytest
from pyspark.sql import functions as F

from concordia.functions import scalars
from concordia.operators import assembly as asm
from concordia.operators import evaluation as ev
from concordia.operators import preparation as prep
from concordia.operators import windows as win


def test_parsed_output():
    want = '[{"kanun_no": "1", "kanun_ad": "", "madde": "", "source_text": ""}]'
    for text in ('[{"kanun_no": " 1 "}]', '```json\n[{"kanun_no": 1}]\n```', 'so: [{"kanun_no": "1"}] end', '{"references": [{"kanun_no": "1", "madde": null}]}'):
        assert prep.parsed_output(text) == want, text
    for text in (None, "", "none", "[1, 2]", '{"a": 1}', "[{]"):
        assert prep.parsed_output(text) is None, text


def test_corrections_in_order():
    row = lambda law, article, name="": {"law_no": law, "law_name": name, "article": article, "source_text": "q"}
    fix = lambda **k: {"kind": "range", "law_no": "", "article": "", "new_law_no": None, "new_law_name": None, "new_article": None, "low": None, "high": None} | k
    rows, stale = asm.corrected([row("193", "3", "GVK"), row("193", "6"), row("213", "1"), row("213", "1")], [fix(law_no="193", low=3, high=6), fix(kind="remove", law_no="193", article="4"), fix(kind="replace", law_no="213", article="1", new_law_no="213", new_article="2"), fix(kind="remove", law_no="9", article="9")])
    assert [(r["law_no"], r["article"], r["law_name"]) for r in rows] == [("193", "3", "GVK"), ("193", "5", "GVK"), ("193", "6", ""), ("213", "2", "")] and stale == [3]


def test_versions(spark):
    events = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 5), ("a", 4, 2), ("b", 0, 1)], "key string, seq int, expected int")
    got = {(r.key, r.seq): r.accepted for r in asm.versioned(events).collect()}
    assert got == {("a", 0): True, ("a", 1): False, ("a", 2): True, ("a", 3): False, ("a", 4): True, ("b", 0): False}


def test_audit_states(spark):
    state = lambda rows, e=False: asm.green_audit(spark.createDataFrame(rows, "status string, changed boolean"), e).first().state
    assert state([("finalized", False), ("finalized", False)]) == "passed"
    assert state([("finalized", False), ("deferred", None)]) == "pending"
    assert state([("finalized", True), ("pending", None)]) == state([("finalized", False)], True) == "escalation_required"
    with pytest.raises(ValueError):
        asm.scoped_truth(spark.range(1), "other")
    with pytest.raises(ValueError):
        asm.names_of_policy("other")
    assert asm.policy_fingerprint("none") != asm.policy_fingerprint("ignore_vuk_213_article_413_v1")


def test_scope_waits_for_the_audit(spark):
    rows = [(1, "finalized", "RED", False, False), (2, "pending", "GREEN", False, False), (3, "pending", "GREEN", True, False)]
    records = spark.createDataFrame(rows, "doc_id long, status string, bucket string, audit boolean, escalated boolean")
    scope = lambda df: {r.doc_id: r.truth_source for r in asm.scoped_truth(df, "batch").collect()}
    assert scope(records) == {1: "expert", 2: None, 3: None}
    done = records.withColumn("status", F.when(F.col("audit"), "finalized").otherwise(F.col("status")))
    assert scope(done) == {1: "expert", 2: "consensus", 3: "expert"}
    assert scope(done.withColumn("escalated", F.lit(True))) == {1: "expert", 2: None, 3: "expert"}


def test_core_view_keeps_the_first_place(spark):
    rows = [(1, 0, "193", "", "5", "draft", "q"), (1, 1, "193", "", "", "", ""), (1, 2, "193", "", "5", "approved", ""), (1, 3, "193", "", "5", "approved", "q")]
    df = spark.createDataFrame(rows, "doc_id long, pos long, law_no string, law_name string, article string, status string, source_text string")
    got = sorted((r.pos, r.article, r.status, r.source_text) for r in ev.core_view(df).collect())
    assert got == [(0, "5", "approved", "q"), (1, "", "", "")]


def test_windows_of_a_text(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10))), (2, None), (3, "one two")], "doc_id long, text string")
    got = {(r.doc_id, r.ordinal): (r.start, r.end, r.native, r.body) for r in win.windowed(docs, 4, 1).collect()}
    assert got == {(1, 0): (0, 4, False, "w0 w1 w2 w3"), (1, 1): (3, 7, False, "w3 w4 w5 w6"), (1, 2): (6, 10, False, "w6 w7 w8 w9"), (3, 0): (0, 2, True, "one two")}


def test_scalars(spark):
    rows = spark.createDataFrame([("Sayı : B.07/12 - 5   12.03.2011 x", "abc" * 100), ("Sayı: 77 y", "  short  text "), ("none", "")], "a string, b string")
    got = [tuple(r) for r in rows.select(scalars.ruling_number(rows.a), scalars.snippet(rows.b, 5, 8), scalars.snippet(rows.b, 8, 5)).collect()]
    assert got[0][0] == "B.07/12 - 5" and got[1][0] == "77" and got[2][0] == "" and all(x[2] == "" for x in got)
    assert len(got[0][1]) == 22 and got[1][1] == "short text"


def test_selection_problems(spark):
    rows = [("a", 1, True, True), ("a", 2, True, False), ("b", 3, False, True), ("c", 4, True, True), ("d", 1, True, False)]
    df = spark.createDataFrame(rows, "g string, score int, fit boolean, chosen boolean")
    got = {r.g: r.problem for r in ev.selection_problems(df, F.col("fit"), (F.col("score"),), "g", F.col("chosen")).collect()}
    assert got == {"a": "outranked", "b": "not_eligible", "d": "not_one"}


def test_file_manifest(spark, tmp_path):
    import hashlib

    from concordia.operators import contracts as con

    for name in ("b.txt", "a.txt"):
        (tmp_path / name).write_text(name * 3)
    manifest = con.file_manifest(spark, str(tmp_path))
    want = {n: hashlib.sha256((n * 3).encode()).hexdigest() for n in ("a.txt", "b.txt")}
    assert {r.name: r.sha256 for r in manifest.collect()} == want
    lines = "\n".join(sorted(f"{h}  {n}" for n, h in want.items()))
    assert con.manifest_hash(manifest).first().hash == hashlib.sha256(lines.encode()).hexdigest()


def test_least_hashes_are_exact(spark):
    import hashlib

    from concordia.operators import sampling

    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 50 = 0 THEN 'small' WHEN id = 1 THEN NULL ELSE 'large' END AS s")
    got = sorted((r.s or "", r.turn, r.doc_id) for r in sampling.least_hashes(rows, 5, "s", "x").collect())
    by = {}
    for i in sorted(range(3000), key=lambda i: hashlib.sha256(f"x:{i}".encode()).hexdigest()):
        by.setdefault("small" if i % 50 == 0 else "" if i == 1 else "large", []).append(i)
    assert got == sorted((s, k + 1, i) for s, ids in by.items() for k, i in enumerate(ids[:5]))
