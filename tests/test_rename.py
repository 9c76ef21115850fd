"""Rename detection on inline patches, one for each rule."""

import pytest

from patchcraft.operators import rename as R

# (patch_id, text, expected verdict or None for rejected, expected renames)
CASES = [
    # One name changed wherever it stands in two pairs, with context around and between them.
    ("loop variable",
     "@@ -40,6 +40,6 @@\n   // print the queue\n"
     "-  for (Job item : queue)\n+  for (Job task : queue)\n"
     "   {\n"
     "-    printer.send(item.title());\n+    printer.send(task.title());\n"
     "   }\n", "y", [("item", "task")]),
    # The same rename in many pairs counts once.
    ("many uses",
     "@@ -1,4 +1,4 @@\n"
     "-double w = read();\n+double width = read();\n"
     "-area = w * w;\n+area = width * width;\n"
     "-edge = 4 * w;\n+edge = 4 * width;\n"
     " show(area, edge);\n", "y", [("w", "width")]),
    # A changed package line rejects the patch, whatever else changes.
    ("package line",
     "@@ -1,2 +1,2 @@\n-package shop.cart;\n+package shop.basket;\n \n"
     "@@ -8 +8 @@\n-Cart c;\n+Cart d;\n", None, None),
    # Code added to a line is no rename.
    ("longer condition", "@@ -3 +3 @@\n-while (ready) step();\n+while (ready && left > 0) step();\n", None, None),
    # Words changed inside a literal with other delimiters.
    ("literal", "@@ -3 +3 @@\n-ask(\"name? first\");\n+ask(\"name: first, last\");\n", None, None),
    # A rename beside a line of prose that differs in length.
    ("prose",
     "@@ -5,2 +5,2 @@\n-Clock now = utc();\n+Clock here = utc();\n"
     "-note = \"late\";\n+note = \"late by an hour, or more\";\n", None, None),
    # An identifier against a sign.
    ("wildcard", "@@ -2 +2 @@\n-import tools.Hammer;\n+import tools.*;\n", None, None),
    ("block", "@@ -1 +1 @@\n x\n-int b;\n-use(b);\n+int a;\n+use(a);\n y\n", "y", [("b", "a")]),
    ("block at end", "@@\n-int b;\n-use(b);\n+int a;\n+use(a);\n", "y", [("b", "a")]),
    ("conflict", "@@\n-x=b;\n+x=a;\n z\n-y=b;\n+y=c;\n", None, None),
    ("identical", "@@\n-b=1;\n+b=1;\n", "n", []),
    ("delimiter", "@@\n-foo.bar;\n+baz,qux;\n", None, None),
    ("context only", "@@\n x\n", "n", []),
    ("three renames", "@@\n-a+b+c;\n+d+e+f;\n", "skip", [("a", "d"), ("b", "e"), ("c", "f")]),
    ("moved line", "@@\n+x;\n y\n-x;\n", "n", []),
    ("unbalanced", "@@\n-x;\n", None, None),
    ("keyword", "@@\n-int a;\n+long a;\n", None, None),
    ("crlf", "@@\r\n-int b;\r\n+int a;\r\n", "y", [("b", "a")]),
    ("two olds one new", "@@\n-f(a, b);\n+f(c, c);\n", "y", [("a", "c"), ("b", "c")]),
    ("number led", "@@\n-x = 1a;\n+x = 2a;\n", None, None),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    df = spark.createDataFrame([("fixtures", pid, text) for pid, text, _, _ in CASES], "repo string, patch_id string, text string")
    out = R.rename_verdicts(df, keep_rejected=True).collect()
    return {r["patch_id"]: r for r in out}


@pytest.mark.parametrize("pid,text,verdict,renames", CASES, ids=[c[0] for c in CASES])
def test_case(verdicts, pid, text, verdict, renames):
    r = verdicts[pid]
    assert r["verdict"] == verdict, (pid, r["reject_reason"])
    if renames is None:
        assert r["renames"] is None
    else:
        assert [(x["old"], x["new"]) for x in r["renames"]] == renames


def test_rejected_rows_dropped_by_default(spark):
    df = spark.createDataFrame([("r", pid, text) for pid, text, _, _ in CASES], "repo string, patch_id string, text string")
    got = {r["patch_id"] for r in R.rename_verdicts(df).collect()}
    assert got == {pid for pid, _, v, _ in CASES if v is not None}


def test_message_and_counts(verdicts):
    assert verdicts["three renames"]["message"] == "a->d, b->e, c->f"
    assert verdicts["identical"]["message"] is None
    assert verdicts["three renames"]["n_renames"] == 3
