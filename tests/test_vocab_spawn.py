"""Vocabulary, exact pair sampling, spawning (with the relabel invariant), line diffs."""

from pyspark.sql import functions as F

from patchcraft.operators import diff as DF
from patchcraft.operators import rename as R
from patchcraft.operators import vocab as V
from samples import shuffled_records


def test_identifiers(spark):
    df = spark.createDataFrame([("int a_b = foo(x1, 9y, _z, for, déjà, verylongname1);",)], "text string")
    r = df.select(V.extract_identifiers("text").alias("i"), V.extract_short_identifiers("text").alias("s")).first()
    assert r["i"] == ["a_b", "foo", "x1", "_z", "déjà", "verylongname1"]
    assert r["s"] == ["a_b", "foo", "x1", "déjà"]


def test_vocabulary_has_all_seed_letters(spark):
    df = spark.createDataFrame([("r", "p", "@@\n-int b;\n+int a;\n")], "repo string, patch_id string, text string")
    words = {r["word"] for r in V.build_vocabulary(df).collect()}
    assert set("abcdefghijklmnopqrstuvwxyz") <= words and "int" not in words


def test_exact_dedup_keeps_lowest(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_copies"]) for r in V.exact_dedup(df, "text", "doc_id").collect()) == [(1, 2), (2, 1)]


def test_sample_pairs_exact(spark):
    vocab = spark.createDataFrame([(w,) for w in ["a", "b", "c", "d", "Up", "Vp", "Wp", "Xp", "keep"]], "word string")
    t = spark.createDataFrame([("t1", "b", "c", ["b", "c", "keep"]), ("t2", "Up", "Vp", ["Up", "Vp"])],
                              "template_id string, old string, new string, words array<string>")
    pairs = V.sample_pairs(vocab, t, 50).collect()
    assert len(pairs) == 100
    for p in pairs:
        assert p["pair_old"] != p["pair_new"]
        if p["template_id"] == "t1":
            assert {p["pair_old"], p["pair_new"]} <= {"a", "d"}
        else:
            assert {p["pair_old"], p["pair_new"]} == {"Wp", "Xp"}


def test_sample_pairs_none_when_class_exhausted(spark):
    vocab = spark.createDataFrame([(w,) for w in ["Up", "Vp", "Wp"]], "word string")
    t = spark.createDataFrame([("t", "Up", "Vp", ["Up", "Vp"])], "template_id string, old string, new string, words array<string>")
    assert V.sample_pairs(vocab, t, 5).count() == 0


def test_spawn_relabels_to_drawn_pair(spark):
    text = "@@ -1 +1 @@\n ctx(b);\n-int b = 1;\n-use(b);\n+int a = 1;\n+use(a);\n"
    patches = spark.createDataFrame([("r", "tpl", text)], "repo string, patch_id string, text string")
    templates = V.spawn_templates(patches)
    assert templates.count() == 1
    vocab = spark.createDataFrame([(w,) for w in ["p", "q", "r", "s", "t", "u"]], "word string")
    sp = V.spawn_patches(templates, V.sample_pairs(vocab, templates, 10))
    m = R.rename_map(sp.select("repo", "patch_id", "text"), keep_rejected=True)
    got = sp.join(m, ["repo", "patch_id"]).collect()
    assert len(got) == 10
    for r in got:
        assert [(x["old"], x["new"]) for x in r["renames"]] == [(r["pair_old"], r["pair_new"])]
        assert " ctx(b);" in r["text"]          # context lines untouched


def test_changed_lines_multiset(spark):
    v = spark.createDataFrame([("p", "a\nb\nb\nc", "b\nc\nd\nb\nb")], "pair_id string, old string, new string")
    got = sorted((r["sign"], r["line"], r["n"]) for r in DF.changed_lines(v).collect())
    assert got == [("+", "b", 1), ("+", "d", 1), ("-", "a", 1)]


def test_synthetic_edits_one_line(spark):
    docs = spark.createDataFrame([(1, "l1\nl2\nl3")], "doc_id long, text string")
    e = DF.synthetic_edits(docs, "doc_id", "text", variants=12).collect()
    for r in e:
        old, new = r["old"].split("\n"), r["new"].split("\n")
        assert len(new) - len(old) == {"delete": -1, "add": 1, "both": 0}[r["choice"]]


def test_changed_lines_of_rows_with_one_key_and_without(spark):
    rows = [("p", "a\nb\nc", "a\nx\nc"), ("p", "x\nq", "q"), (None, "a\nb", "a\nb"), ("o", None, "n"), ("e", "", "")]
    got = sorted((r["pair_id"] or "", r["sign"], r["line"], r["n"])
                 for r in DF.changed_lines(spark.createDataFrame(rows, "pair_id string, old string, new string")).collect())
    assert got == [("", "+", "a", 1), ("", "+", "b", 1), ("", "-", "a", 1), ("", "-", "b", 1), ("o", "+", "n", 1), ("p", "-", "b", 1)]


def test_shuffle_of_edits_does_not_grow_with_the_text(spark):
    text = "\n".join(f"line {i}" for i in range(300))
    edits = DF.synthetic_edits(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", variants=20)
    edits = edits.withColumn("pair_id", F.concat_ws(":", "doc_id", "variant"))
    assert 0 < shuffled_records(DF.changed_lines(edits)) <= 40


def test_sampling_mines_the_vocabulary_once(spark):
    mined = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(word):
        mined.add(1)
        return word

    words = spark.createDataFrame([(w,) for w in "abcdef"], "word string").select(counted.asNondeterministic()("word").alias("word"))
    t = spark.createDataFrame([("t", "b", "C", ["b", "c"]), ("t", "b", "C", ["d"])], "template_id string, old string, new string, words array<string>")
    pairs = V.sample_pairs(words.unionByName(spark.createDataFrame([("Up",)], "word string")), t, 20).collect()
    assert mined.value == 6
    assert len(pairs) == 40 and {p["pair_old"] for p in pairs} <= set("aef") and {p["pair_new"] for p in pairs} == {"Up"}
