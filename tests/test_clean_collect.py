"""Cleaning (sections, headers, encodings) and commit collection on inline rows."""

from pyspark.sql import functions as F

from patchcraft.functions import text as T
from patchcraft.operators import clean as C
from patchcraft.operators import collect as CO

NEW_FILE = (
    "diff --git a/app/Greeter.java b/app/Greeter.java\n"
    "new file mode 100755\nindex 000..aaa\n--- /dev/null\n+++ b/app/Greeter.java\n"
    "@@ -0,0 +1,2 @@\n+class Greeter {\n+}\n"
)
NO_HUNK_THEN_HUNK = (
    "diff --git a/app/Empty.java b/app/Empty.java\ndeleted file mode 100644\nindex bbb..000\n"
    "diff --git a/app/Full.java b/app/Full.java\nindex ccc..ddd 100644\n"
    "--- a/app/Full.java\n+++ b/app/Full.java\n@@ -4 +4 @@ class Full\n-int x;"
)
MD_ONLY = "diff --git a/README.md b/README.md\nindex 1..2 100644\n--- a/README.md\n+++ b/README.md\n@@ -1 +1 @@\n-a\n+b\n"


def _clean(spark, rows):
    df = spark.createDataFrame(rows, "patch_id string, text string")
    return {r["patch_id"]: r for r in C.clean_patches(df).collect()}


def test_sections(spark):
    out = _clean(spark, [("new", NEW_FILE), ("nohunk", NO_HUNK_THEN_HUNK), ("md", MD_ONLY),
                         ("plain", "@@ -1 +1 @@\n-a\n+b\n"), ("empty", "")])
    new = out["new"]["cleaned"]
    assert new.startswith("@@") and "+++" not in new and "---" not in new
    assert out["new"]["status"] == "trimmed" and out["new"]["lines_removed"] == 5
    assert out["nohunk"]["cleaned"] == "@@ -4 +4 @@ class Full\n-int x;"
    assert out["md"]["cleaned"] == "" and out["md"]["status"] == "deleted"
    assert out["plain"]["cleaned"] == "@@ -1 +1 @@\n-a\n+b\n" and out["plain"]["status"] == "unchanged"
    assert out["empty"]["status"] == "deleted"


def test_java_suffix_is_case_sensitive_for_sections(spark):
    upper = NEW_FILE.replace(".java", ".JAVA")
    out = _clean(spark, [("u", upper)])
    assert out["u"]["cleaned"] == ""


def test_strip_headers_and_newlines(spark):
    df = spark.createDataFrame([("a", "diff x\n--- a\n+++ b\n@@ -1 +1 @@\r\n-x\r+y\n")], "id string, t string")
    r = df.select(T.strip_headers("t").alias("s"), T.normalise_newlines("t").alias("n")).first()
    assert r["s"].startswith("@@ -1 +1 @@")
    assert "\r" not in r["n"] and r["n"].endswith("-x\n+y\n")


def test_decode_lenient(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\xc3\xa9"),)], "b binary")
    assert df.select(T.decode_lenient("b").alias("t")).first()["t"] == "abé"


def test_convert_encoding(spark):
    text = "Grüße, café"
    rows = [
        ("utf8", bytearray(text.encode("utf-8"))),
        ("latin1", bytearray(text.encode("latin-1"))),
        ("utf16", bytearray(b"\xff\xfe" + text.encode("utf-16-le"))),
    ]
    df = C.convert_encoding(spark.createDataFrame(rows, "id string, raw binary"))
    got = {r["id"]: (r["charset_used"], r["text_decoded"], r["converted"]) for r in df.collect()}
    assert got["utf8"] == ("UTF-8", text, False)
    assert got["latin1"] == ("ISO-8859-1", text, True)
    assert got["utf16"] == ("UTF-16LE", text, True)


def test_convert_encoding_of_broken_bytes(spark):
    pair = "a\U0001f600b"
    rows = [
        ("odd", bytearray(b"\xff\xfea\x00b")),
        ("alone", bytearray(b"\xfe\xff\xd8\x3d\x00a")),
        ("low first", bytearray(b"\xff\xfea\x00\x00\xdea\x00")),
        ("bom8", bytearray(b"\xef\xbb\xbfok\xff!")),
        ("good le", bytearray(b"\xff\xfe" + pair.encode("utf-16-le"))),
        ("good be", bytearray(b"\xfe\xff" + pair.encode("utf-16-be"))),
        ("good bom8", bytearray(b"\xef\xbb\xbf" + pair.encode())),
        ("empty", bytearray(b"")),
        ("none", None),
    ]
    df = C.convert_encoding(spark.createDataFrame(rows, "id string, raw binary"))
    got = {r["id"]: (r["charset_used"], r["text_decoded"], r["converted"]) for r in df.collect()}
    assert [got[i][0] for i in ("odd", "alone", "low first", "bom8")] == ["lenient"] * 4
    assert got["odd"][1] == "a\0b" and got["bom8"][1] == "ok!"
    assert got["good le"] == ("UTF-16LE", pair, True) and got["good be"] == ("UTF-16BE", pair, True)
    assert got["good bom8"] == ("UTF-8-BOM", pair, True)
    assert got["empty"] == ("UTF-8", "", False) and got["none"] == (None, None, None)


def test_eof_newline(spark):
    marker = "\\ No newline at end of file"
    only_newline = f"@@ -1 +1 @@\n-last\n{marker}\n+last\n"
    real_change = f"@@ -1 +1 @@\n-old\n{marker}\n+new\n{marker}\n"
    df = spark.createDataFrame([(only_newline,), (real_change,)], "t string")
    out = [r["x"] for r in df.select(CO.normalise_eof_newline("t").alias("x")).collect()]
    assert out == ["", "@@ -1 +1 @@\n-old\n+new\n"]


def _eof(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    return [r["x"] for r in df.select("i", CO.normalise_eof_newline("t").alias("x")).orderBy("i").collect()]


def test_eof_newline_in_runs(spark):
    m = "\\ No newline at end of file"
    at = "@@ -1 +1 @@"
    cases = [
        ([at, "-x", "-last", m, "+y", "+last"], [at, "-x", "+y", " last"]),
        ([at, "-last", m, "+last", "+more"], [at, " last", "+more"]),
        ([at, "-last", m, "+last", "+more", m], [at, " last", "+more"]),
        ([at, " a", "-last", "-more", "+last", m], [at, " a", " last", "-more"]),
        ([at, "-x", "-last", "-more", "+y", "+last", m], [at, "-x", "+y", " last", "-more"]),
        ([at, " a", "-b", " c", m], [at, " a", "-b", " c"]),
        ([at, "-same", "+same", at, "-z", "+last", m], [at, "-same", "+same", at, "-z", "+last"]),
        ([at, "-z", "+w", at, " k", "-last", m, "+last"], [at, "-z", "+w"]),
        ([at, "-last", " k", "+last", m], [at, "-last", " k", "+last"]),
        ([at, "-", "+", m], None),
    ]
    got = _eof(spark, *["\n".join(given) + "\n" for given, _ in cases])
    assert got == ["" if want is None else "\n".join(want) + "\n" for _, want in cases]


def test_eof_newline_of_a_long_run(spark):
    m = "\\ No newline at end of file"
    minus, plus = [f"-a{i}" for i in range(20000)], [f"+b{i}" for i in range(20000)]
    text = "\n".join(["@@ -1 +1 @@", *minus, "-last", *plus, "+last", m])
    assert _eof(spark, text) == ["\n".join(["@@ -1 +1 @@", *minus, *plus, " last"]) + "\n"]


def test_forks_with_the_same_commit_id(spark):
    commits = spark.createDataFrame([("r", "c", ["p"]), ("fork", "c", ["p"])], "repo string, commit_id string, parents array<string>")
    changes = spark.createDataFrame(
        [(repo, "c", 1, "A.java", "A.java", bytearray(f"@@ -1 +1 @@\n-a\n+{repo}\n".encode())) for repo in ("r", "fork")],
        "repo string, commit_id string, ord int, a_path string, b_path string, patch binary",
    )
    out = {r["repo"]: r["text"] for r in CO.collect_patches(commits, changes).collect()}
    assert out == {"r": "@@ -1 +1 @@\n-a\n+r\n", "fork": "@@ -1 +1 @@\n-a\n+fork\n"}


def test_collect_patches(spark):
    commits = spark.createDataFrame(
        [("r", "c1", ["p"]), ("r", "c2", []), ("r", "c3", ["p", "q"]), ("r", "c4", ["p"]), ("r", "c5", ["p"])],
        "repo string, commit_id string, parents array<string>",
    )
    ch = [
        ("c1", 2, "B.java", "B.java", b"@@ -1 +1 @@\r\n-b\r\n+bb\r\n"),
        ("c1", 1, "A.JAVA", "A.JAVA", b"@@ -1 +1 @@\n-a\n+aa\n"),
        ("c1", 3, "R.md", "R.md", b"@@ -1 +1 @@\n-m\n+n\n"),
        ("c2", 1, "A.java", "A.java", b"@@ -1 +1 @@\n-a\n+b\n"),
        ("c3", 1, "A.java", "A.java", b"@@ -1 +1 @@\n-a\n+b\n"),
        ("c4", 1, "R.md", "R.md", b"x"),
        ("c5", 1, "A.java", "A.java", b""),
    ]
    changes = spark.createDataFrame(
        [("r", c, o, a, b, bytearray(p)) for c, o, a, b, p in ch],
        "repo string, commit_id string, ord int, a_path string, b_path string, patch binary",
    )
    out = {r["commit_id"]: r for r in CO.collect_patches(commits, changes).collect()}
    assert set(out) == {"c1", "c4"}          # c2 root, c3 merge, c5 only an empty Java patch
    assert out["c1"]["text"] == "@@ -1 +1 @@\n-a\n+aa\n@@ -1 +1 @@\n-b\n+bb\n"
    assert out["c4"]["is_empty"] and out["c4"]["text"] == ""
