"""Comment edits: the line functions against a lexer that reads characters, and the verdicts."""

import random
import re

from patchcraft.operators import comments as CM

SCHEMA = "repo string, patch_id string, text string"


def code_of(lines, inside):
    """Reads a version character by character; (inside at its beginning, code, has comment) of each line."""
    out = []
    for line in lines:
        began, code, has, i = inside, "", inside, 0
        while i < len(line):
            if inside:
                end = line.find("*/", i)
                if end < 0:
                    i = len(line)
                else:
                    inside, i = False, end + 2
            elif line.startswith("//", i):
                has, code, i = True, code + " ", len(line)
            elif line.startswith("/*", i):
                has, code = True, code + " "
                end = line.find("*/", i + 2)
                inside, i = end < 0, len(line) if end < 0 else end + 2
            elif line[i] in "\"'":
                q, j = line[i], i + 1
                while j < len(line) and line[j] != q:
                    j += 2 if line[j] == "\\" and j + 1 < len(line) else 1
                code, i = code + line[i : min(j + 1, len(line))], min(j + 1, len(line))
            else:
                code, i = code + line[i], i + 1
        out.append((began, code.rstrip(" ") if has else line, has))
    return out


def test_states_against_a_lexer_of_characters(spark):
    rng = random.Random(4)
    pieces = ["/*", "*/", "//", '"', "'", "\\", "a", " ", "*", "/", "b c", "/**/", '"x"']
    rows = []
    for i in range(300):
        lines = ["@@ -1 +1 @@", " start();"]  # no sign in it: the hunk begins outside
        lines += [rng.choice("-+ ") + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 12))]
        rows.append(("r", str(i), "\n".join(lines)))
    exploded = spark.createDataFrame(rows, SCHEMA).selectExpr("repo", "patch_id", "posexplode(split(text, '\n', -1)) AS (pos, line)")
    got = {}
    for r in CM.comment_states(exploded).collect():
        got[r.patch_id, r.side, r.pos] = (r.inside, r.code, r.has_comment)
    for _, key, text in rows:
        lines = text.split("\n")
        for side in "-+":
            own = [(k, x) for k, x in enumerate(lines) if k and x[:1] in (side, " ")]
            signs = [re.search(r"/\*|\*/|//", re.sub(r"\"(?:[^\"\\]|\\.?)*(?:\"|$)|'(?:[^'\\]|\\.?)*(?:'|$)", "", x[1:])) for _, x in own]
            first = next((m for m in signs if m), None)
            if first and first[0] == "*/" or got[key, side, 1][0]:
                continue  # begins inside, which the next test covers
            for (k, _), want in zip(own, code_of([x[1:] for _, x in own], False), strict=True):
                assert got[key, side, k] == want, (text, side, k)


def verdicts(spark, *texts):
    df = spark.createDataFrame([("r", str(i), "@@ -1 +1 @@\n" + t) for i, t in enumerate(texts)], SCHEMA)
    found = {int(r.patch_id): r for r in CM.code_verdicts(df).collect()}
    return [(found[i].verdict, found[i].reason, found[i].message) for i in range(len(texts))]


def test_verdicts_do_not_count_comments(spark):
    got = verdicts(
        spark,
        "-int a; // old\n+int a; // new\n",
        " /**\n- * one\n+ * two\n+ * three\n  */\n int a;\n",
        "- * one\n+ * two\n  */\n int a;\n",  # begins inside
        "- * one\n+ * two\n",  # nothing but starred lines
        "+/* a\n+ b */\n int a;\n",
        "-int a; // a is old\n+int b; // b is new\n",
        '-f("// a", x);\n+f("// b", x);\n',  # strings are code
        "-int a;\n+int b;\n",
        " int a;\n",
        "-/* x */ int a;\n+int a;\n-c();\n+d();\n",
        "-int a; // p\n+int a; // q\n+int c;\n",
        "-/*/ int a; */\n+/*/ int b; */\n",
    )
    assert got == [
        ("n", "comment", None), ("n", "comment", None), ("n", "comment", None), ("n", "comment", None), ("n", "comment", None),
        ("y", None, "a->b"), ("y", None, "a->b"), ("y", None, "a->b"), ("n", None, None), (None, "not a rename", None), (None, "unbalanced", None), ("n", "comment", None),
    ]


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([("r", "1", ""), ("r", "2", "no hunk\n"), ("r", "3", "@@ -1 +1 @@\n-a" + "b" * 50_000 + " // x\n+a" + "b" * 50_000 + " // y\n")], SCHEMA)
    got = {r.patch_id: (r.verdict, r.reason) for r in CM.code_verdicts(df).collect()}
    assert got == {"1": ("n", None), "2": ("n", None), "3": ("n", "comment")}
    assert CM.code_verdicts(df.limit(0)).count() == 0


def test_one_exchange_for_the_windows_and_the_aggregation(spark):
    df = spark.createDataFrame([("r", "1", "@@\n-a\n+b")], SCHEMA)
    plan = CM.code_patches(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(repo") == 1 and plan.count("Exchange ") == 1
