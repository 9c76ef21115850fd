"""File sources/sinks round trips, streaming form, selection and the classifier."""

import os
import tempfile

from pyspark.sql import functions as F

from patchcraft.operators import model as M
from patchcraft.operators import select as S
from patchcraft.sources import files as FS
from patchcraft.sources import sinks as SK
from patchcraft.streaming import patch_stream as PS


def _write(folder, rel, text):
    p = os.path.join(folder, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8", newline="\n") as f:
        f.write(text)


def test_scan_patches_and_labels(spark):
    d = tempfile.mkdtemp(prefix="pc-scan-")
    _write(d, "yes/a b.diff", "@@\n-x\n+y\n")
    _write(d, "no/c.diff", "@@\n x\n")
    _write(d, "no/a+b.diff", "@@\n y\n")
    _write(d, "no/.hidden.diff", "@@\n")
    _write(d, "no/big.diff", "@@\n" + "x" * 3000)
    _write(d, "no/notes.txt", "ignored")
    df = FS.label_from_path(FS.scan_patches(spark, d, max_file_kb=2))
    got = sorted((r["patch_id"], r["label"], r["n_bytes"]) for r in df.collect())
    assert got == [("a b", 1, 9), ("a+b", 0, 6), ("c", 0, 6)]
    assert FS.scan_patches(spark, d).where("patch_id = 'big'").count() == 1      # no limit unless given


def test_verdict_round_trip(spark):
    d = tempfile.mkdtemp(prefix="pc-verdicts-")
    v = spark.createDataFrame(
        [("repoA", "1", "y", "b->a", 1), ("repoA", "2", "n", None, 0), ("repoB", "3", "skip", "a->b, c->d, e->f", 3)],
        "repo string, patch_id string, verdict string, message string, n_renames long",
    )
    SK.write_verdicts(v, os.path.join(d, "v"))
    back = FS.read_verdicts(spark, os.path.join(d, "v"))
    got = sorted((r["repo"], r["patch_id"], r["verdict"], r["message"]) for r in back.collect())
    assert got == [("repoA", "1", "y", "b->a"), ("repoA", "2", "n", None), ("repoB", "3", "skip", "a->b, c->d, e->f")]


def test_vocabulary_round_trip(spark):
    d = tempfile.mkdtemp(prefix="pc-vocab-")
    SK.write_vocabulary(spark.createDataFrame([("b",), ("a",), ("B",)], "word string"), os.path.join(d, "v"))
    assert sorted(r["word"] for r in FS.read_vocabulary(spark, os.path.join(d, "v")).collect()) == ["B", "a", "b"]


def test_selection(spark):
    patches = spark.createDataFrame(
        [("r", str(i), "@@\n", 10 if i < 8 else 9000) for i in range(10)], "repo string, patch_id string, text string, n_bytes long")
    verdicts = spark.createDataFrame([("r", "0", "y"), ("r", "1", "n"), ("r", "2", "skip")], "repo string, patch_id string, verdict string")
    sel = {(r["patch_id"], r["label"]) for r in S.select_by_verdict(patches, verdicts).collect()}
    assert sel == {("0", 1), ("1", 0)}
    neg = [r["patch_id"] for r in S.presumed_negatives(patches, verdicts, n=3).orderBy("patch_id").collect()]
    assert neg == ["1", "2", "3"]
    assert S.presumed_negatives(patches, verdicts).count() == 9                  # no limit unless given
    chosen = [r["patch_id"] for r in S.select_examples(patches, verdicts).collect()]
    assert sorted(chosen) == [str(i) for i in range(10)]                         # none twice


def test_stream_clean(spark):
    src = tempfile.mkdtemp(prefix="pc-stream-src-")
    out = tempfile.mkdtemp(prefix="pc-stream-out-")
    _write(src, "a.diff", "diff --git a/X.java b/X.java\nindex 1..2\n--- a/X.java\n+++ b/X.java\n@@ -1 +1 @@\n-int b = 10;\n+int a = 10;\n")
    _write(src, "b.diff", "diff --git a/R.md b/R.md\n@@ -1 +1 @@\n-x\n+y\n")
    q = PS.start_clean_stream(spark, src, os.path.join(out, "t"), checkpoint=os.path.join(out, "ck"))
    q.awaitTermination(120)
    got = {os.path.basename(r["path"]): r for r in spark.read.parquet(os.path.join(out, "t")).collect()}
    assert got["a.diff"]["status"] == "trimmed" and got["a.diff"]["tokens"][0] == "@"
    assert got["b.diff"]["status"] == "deleted"


def test_classifier_and_metrics(spark):
    rows = [(f"p{i}", i % 2, ["rename", "x"] if i % 2 else ["other", "y", "z"]) for i in range(60)]
    df = spark.createDataFrame(rows, "path string, label int, tokens array<string>")
    model, hist = M.train_classifier(df, df, iterations=(5,))
    pred = M.predict(model, df)
    rates = M.error_rates(pred).first()
    assert rates["n"] == 60 and rates["accuracy"] == 1.0
    assert {(r["label"], r["prediction"], r["n"]) for r in M.confusion_matrix(pred).collect()} == {(0, 0, 30), (1, 1, 30)}
    d = tempfile.mkdtemp(prefix="pc-model-")
    M.save_model(model, d, "v1")
    again = M.load_model(d, "v1")
    assert again is not None and M.load_model(d, "missing") is None
    assert M.error_rates(M.predict(again, df)).first()["accuracy"] == 1.0
    empty = M.error_rates(pred.where("false")).first()
    assert empty["n"] == 0 and empty["accuracy"] is None


def test_scan_dataset_flat_repo_folders(spark):
    d = tempfile.mkdtemp(prefix="pc-dataset-")
    _write(d, "repoA/1.diff", "@@\n-a\n+b\n")
    _write(d, "repoB/2.diff", "@@\n x\n")
    _write(d, "repoB/sub/3.diff", "@@\n")          # not a direct child: ignored
    _write(d, ".hidden/4.diff", "@@\n")            # dot folder: ignored
    got = sorted((r["repo"], r["patch_id"]) for r in FS.scan_dataset(spark, d).collect())
    assert got == [("repoA", "1"), ("repoB", "2")]
