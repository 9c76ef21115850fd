"""Ordered diff, unified hunks and their application."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from patchcraft.functions import lcs
from patchcraft.operators import collect as CO
from patchcraft.operators import linediff as LD

SCHEMA = "pair_id string, old string, new string"


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(last[j], row[j - 1], last[j - 1] + (x == y)))
    return row[-1]


def random_pairs(n, seed, most=9, letters="abc"):
    rng = random.Random(seed)
    for _ in range(n):
        yield [rng.choice(letters) for _ in range(rng.randint(0, most))], [rng.choice(letters) for _ in range(rng.randint(0, most))]


@pytest.mark.parametrize("cells", [lcs.CELLS, 4, 30])
def test_matches_are_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(lcs, "CELLS", cells)
    for a, b in [*random_pairs(600, 1), *random_pairs(40, 2, 80, "abcdefgh"), *random_pairs(40, 3, 90, "ab")]:
        found = lcs.matches(a, b)
        assert len(found) == lcs_length(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p < r and q < s for (p, q), (r, s) in zip(found, found[1:]))


def test_blocks_cover_what_differs():
    assert lcs.blocks([], []) == [] and lcs.blocks([1, 2], [1, 2]) == []
    assert lcs.blocks([1, 2, 3], [1, 9, 3, 4]) == [{"a": 1, "la": 1, "b": 1, "lb": 1}, {"a": 3, "la": 0, "b": 3, "lb": 1}]


def test_large_versions_take_bounded_memory():
    rng = random.Random(5)
    a = [rng.randint(0, 3000) for _ in range(20_000)]
    b = a[5_000:] + a[:5_000]
    assert len(lcs.matches(a, b)) >= 15_000


def texts():
    rng = random.Random(8)
    fixed = [("", ""), ("a", "a\n"), ("a\nb", ""), ("", "x\n\ny"), ("\n", "\n\n"), ("a\r\nb\r\n", "a\nb\n"), (None, "a"), ("@@ -1 +1 @@\n-x\n+y\n", "@@ -1 +1 @@\n+y\n x\n"), ("long\n" * 3000, "long\n" * 2999 + "end\n")]
    made = []
    for a, b in [*random_pairs(150, 6, 14, "ab\t "), *random_pairs(60, 7, 60, "abcdefghijklmnop")]:
        made.append(("\n".join(a) + rng.choice(["", "\n"]), "\n".join(b) + rng.choice(["", "\n"])))
    return [(str(i), a, b) for i, (a, b) in enumerate(fixed + made)]


def test_scripts_hold_both_texts_and_are_minimal(spark):
    rows = texts()
    got = {}
    for r in LD.line_script(spark.createDataFrame(rows, SCHEMA)).orderBy("pair_id", "ord").collect():
        got.setdefault(r.pair_id, []).append(r)
    for key, old, new in rows:
        script = got[key]
        a, b = (old or "").split("\n"), (new or "").split("\n")
        assert [r.line for r in script if r.sign != "+"] == a and [r.line for r in script if r.sign != "-"] == b
        assert [r.old_no for r in script if r.sign != "+"] == list(range(1, len(a) + 1))
        assert [r.new_no for r in script if r.sign != "-"] == list(range(1, len(b) + 1))
        if len(a) < 100:
            assert sum(r.sign == " " for r in script) == lcs_length(a, b)


def test_moved_lines_are_removed_and_added(spark):
    df = spark.createDataFrame([("p", "x\na\nb\nc", "a\nb\nc\nx"), ("q", "a\nb", "a\nc")], SCHEMA)
    assert [tuple(r) for r in LD.moved_lines(LD.line_script(df)).collect()] == [("p", "x", 1)]


def _lines(text):
    return text.split("\n")[: -1 if text.endswith("\n") else None] if text else []


@pytest.mark.parametrize("context", [0, 1, 3])
def test_patches_apply_and_undo(spark, context):
    rows = [r for r in texts() if r[1] is not None]
    df = spark.createDataFrame(rows, SCHEMA).select("*", LD.text_lines("old").alias("old_lines"), LD.text_lines("new").alias("new_lines"))
    patched = LD.apply_patch(LD.with_patch(df, context=context))
    undone = LD.apply_patch(patched, lines="new_lines", out="undone", reverse=True)
    for r in undone.collect():
        assert r.old_lines == _lines(r.old) and r.new_lines == _lines(r.new)
        assert r.patched_lines == r.new_lines and r.undone == r.old_lines
        assert (r.patch == "") == (r.old_lines == r.new_lines)


def test_hunks_are_written_as_difflib_writes_them(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        a = [f"line {k}" for k in range(rng.randint(1, 60))]  # all lines differ, so one least script exists up to order in a block
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), f"new {rng.random()}")
        rows.append((str(i), "\n".join(a) + "\n", "".join(x + "\n" for x in b)))
    df = spark.createDataFrame(rows, SCHEMA).select("*", LD.text_lines("old").alias("old_lines"), LD.text_lines("new").alias("new_lines"))
    for r in LD.with_patch(df).collect():
        want = list(difflib.unified_diff(r.old_lines, r.new_lines, lineterm=""))[2:]
        assert r.patch.split("\n")[:-1] == want


def test_a_patch_that_does_not_fit_gives_null(spark):
    df = spark.createDataFrame([("a\nb\nc", "@@ -1,2 +1,2 @@\n a\n-x\n+y\n"), ("a\nx\nc", "@@ -1,2 +1,2 @@\n a\n-x\n+y\n"), ("a", "")], "old string, patch string")
    got = LD.apply_patch(df.withColumn("old_lines", LD.text_lines("old"))).collect()
    assert [r.patched_lines for r in got] == [None, ["a", "y", "c"], ["a"]]


def test_equal_line_numbers_of_unlike_lines_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(LD.F, "xxhash64", lambda x: F.length(x).cast("long"))
    df = spark.createDataFrame([("1", "aa\nbb\nc\nd", "bb\ncc\nd\ne")], SCHEMA).select("*", LD.text_lines("old").alias("old_lines"), LD.text_lines("new").alias("new_lines"))
    (r,) = LD.apply_patch(LD.with_patch(df)).collect()
    assert r.patched_lines == r.new_lines


def test_marked_changes_are_made_again_from_their_contents(spark):
    mark = "\\ No newline at end of file\n"
    rows = [
        ("r", "c1", 1, "A.java", "A.java", b"@@ -1 +1 @@\n-x\n" + mark.encode() + b"+x\n", b"x", b"x\n"),  # nothing but the end
        ("r", "c2", 1, "A.java", "A.java", b"@@ -1 +1,2 @@\n-x\n" + mark.encode() + b"+y\n+z\n", b"\xffx", b"y\nz\n"),
        ("r", "c3", 1, "A.java", "A.java", b"@@ -1 +1 @@\n-x\n" + mark.encode() + b"+y\n", None, b"y\n"),  # by the marker's rules
        ("r", "c4", 1, "A.java", "A.java", b"@@ -1 +1 @@\n-x\n+y\n", b"other", b"contents"),
    ]
    df = spark.createDataFrame(rows, "repo string, commit_id string, ord int, a_path string, b_path string, patch binary, a_blob binary, b_blob binary")
    got = {r.commit_id: r.text for r in CO.change_texts(df).collect()}
    assert got == {"c1": "", "c2": "@@ -1 +1,2 @@\n-x\n+y\n+z\n", "c3": "@@ -1 +1 @@\n-x\n+y\n", "c4": "@@ -1 +1 @@\n-x\n+y\n"}


def test_no_exchange(spark):
    df = spark.createDataFrame([("1", "a", "b")], SCHEMA).select("*", LD.text_lines("old").alias("old_lines"), LD.text_lines("new").alias("new_lines"))
    plan = LD.apply_patch(LD.with_patch(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
