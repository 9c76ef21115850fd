"""Renames that follow an interface's method, on small commits."""

from patchcraft.operators import interfaces as IF


def _one(old, new):
    return f"@@ -1 +1 @@\n-{old}\n+{new}\n"


IFACE = "package p; // interface Fake { void no(); }\npublic interface Shape<T extends Comparable<T>> extends Base, java.util.List<Map<A, B>> {\n  int area(int a) throws IOException;\n  default void go() { area(1); return area(2); }\n}\n"


def test_declared_types(spark):
    src = IFACE + 'class Sq extends Poly implements Shape<T>, q.Other { String s = "class Not {"; void area(int a) { call(a); } }\n/* enum E { } */ enum Color { RED }\n'
    df = spark.createDataFrame([("r", src), ("r", None), ("r", ""), ("r", "no type here")], "repo string, source string")
    got = {r["name"]: (r["kind"], sorted(r["supers"]), r["methods"]) for r in IF.declared_types(df).collect()}
    assert got["Shape"] == ("interface", ["Base", "List"], ["area"])
    assert got["Sq"] == ("class", ["Other", "Poly", "Shape"], []) and got["Color"][0] == "enum" and "Fake" not in got and "E" not in got


def test_subtypes_of_deep_and_circular_types(spark):
    steps = [(f"T{i}", f"T{i + 1}") for i in range(6)] + [("T6", "T2"), ("X", "Y")]
    index = spark.createDataFrame([("r", a, b) for a, b in steps] + [("other", "T0", "Z")], "repo string, super string, sub string")
    got = {r["sub"] for r in IF.subtypes(spark.createDataFrame([("r", "T0")], "repo string, type string"), index).collect()}
    assert got == {f"T{i}" for i in range(7)}
    assert IF.subtypes(index.select("repo", index["super"].alias("type")).limit(0), index).count() == 0


def test_interface_verdicts(spark):
    area, size = _one("  int area(int a);", "  int size(int a);"), _one("int area(int a) { }", "int size(int a) { }")
    rows = [
        ("r", "c1", "Shape.java", area, IFACE),
        ("r", "c1", "Sq.java", size, "class Sq implements Shape { }"),
        ("r", "c1", "Deep.java", size, "class Deep extends Middle { }"),       # Middle's file is not in the commit
        ("r", "c1", "Free.java", size, "class Free { }"),
        ("r", "c1", "Both.java", size + _one("int x;", "int y;"), "class Both implements Shape { }"),
        ("r", "c1", "Unlike.java", _one("int area()", "int extent()"), "class Unlike implements Shape { }"),
        ("r", "c2", "Later.java", size, "class Later implements Shape { }"),   # another commit
        ("s", "c1", "Sq.java", size, "class Sq implements Shape { }"),         # another repository
        ("r", "c1", "Bad.java", _one("a.b", "a,b c"), "class Bad implements Shape { }"),
        ("r", "c1", None, size, None), ("r", "c1", "NoSource.java", size, None), ("r", "c1", "NoText.java", None, "class N { }"),
    ]
    changes = spark.createDataFrame(rows + rows[1:2], "repo string, commit_id string, path string, text string, source string").dropDuplicates(["repo", "commit_id", "path"])
    files = changes.select("repo", "source").unionByName(spark.createDataFrame([("r", "abstract class Middle implements Shape { }")], "repo string, source string"))
    got = {(r["repo"], r["commit_id"], r["path"]): (r["verdict"], r["n_renames"], r["n_caused"], r["message"], r["reason"]) for r in IF.interface_verdicts(changes, files).collect()}
    follows, own = ("ignored", 0, 1, None, "interface method"), ("y", 1, 0, "area->size", None)
    assert got == {
        ("r", "c1", "Shape.java"): own, ("r", "c1", "Sq.java"): follows, ("r", "c1", "Deep.java"): follows, ("r", "c1", "Free.java"): own,
        ("r", "c1", "Both.java"): ("y", 1, 1, "x->y", None), ("r", "c1", "Unlike.java"): ("y", 1, 0, "area->extent", None),
        ("r", "c2", "Later.java"): own, ("s", "c1", "Sq.java"): own, ("r", "c1", "NoSource.java"): own,
    }
