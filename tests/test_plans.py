"""Physical plan shape: the shuffles each job is designed to have, and no more."""

import re

from pyspark.sql import functions as F

from patchcraft.operators import collect as CO
from patchcraft.operators import diff as DF
from patchcraft.operators import rename as R
from patchcraft.operators import tokens as TK
from patchcraft.operators import vocab as V
from patchcraft.sources import tables as TB
from samples import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(df) -> list[str]:
    return re.findall(r"Exchange (hashpartitioning\([^)]*\)|rangepartitioning\([^)]*\)|SinglePartition)", _plan(df))


def test_rename_uses_one_exchange(spark):
    p = spark.createDataFrame([("r", "1", "@@\n-int b;\n+int a;\n")], "repo string, patch_id string, text string")
    ex = _exchanges(R.rename_verdicts(p))
    assert len(ex) == 1 and ex[0].startswith("hashpartitioning(repo") and "patch_id" in ex[0]


def test_changed_lines_join_reuses_aggregate_partitioning(spark):
    v = spark.createDataFrame([("p", "a\nb", "b\nc")], "pair_id string, old string, new string")
    ex = _exchanges(DF.changed_lines(v))
    assert len(ex) == 2  # one per side for the pre-aggregation; the full outer join adds none


def test_dedup_shuffles_a_digest_not_the_text(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = _plan(V.exact_dedup(d, "text", "doc_id"))
    ex = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(ex) == 1 and "_sha" in ex[0] and "text" not in ex[0]


def test_token_ids_broadcasts_the_bounded_vocabulary(spark):
    df = spark.createDataFrame([("p", ["a", "b"])], "path string, tokens array<string>")
    vocab = TK.top_k_tokens(TK.token_frequency(df), k=10)
    plan = _plan(TK.token_ids(df, vocab, 4))
    assert "BroadcastHashJoin" in plan
    assert "TakeOrderedAndProject" in plan  # top-k, not a global sort


def test_single_split_table_is_spread_over_cores(spark):
    from samples import SF_SMALL
    from patchcraft.sources import tables as TB

    df = TB.read_table(spark, SF_SMALL, "documents")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_texts_of_one_row_group_are_dealt_by_size(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " * 200) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    size = TB._size(spark.read.parquet(str(tmp_path / "documents.parquet")))
    monkeypatch.setattr(TB, "SPREAD_BELOW", 1)
    for parts in (20, 40):  # as many parts as the size asks for, though one row group holds all rows
        monkeypatch.setattr(TB, "TEXT_PART", -(-size // parts))
        df = TB.read_texts(spark, str(tmp_path))
        n = df.rdd.getNumPartitions()
        assert n >= parts * 0.9
        most = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
        assert most < 400 * 4 / parts + 10
        assert sorted(map(tuple, df.collect())) == rows
    monkeypatch.setattr(TB, "TEXT_PART", size)  # small enough parts are left where they are
    assert TB.read_texts(spark, str(tmp_path)).rdd.getNumPartitions() == 1


def test_larger_side_is_not_dealt_to_the_partitions_of_the_smaller(spark):
    labels = TB.read_table(spark, SF_SMALL, "labels", spread=False)
    assert "RepartitionByExpression" not in labels._jdf.queryExecution().optimizedPlan().toString()


def test_changes_are_exchanged_before_they_are_gathered(spark):
    rows = [("r", "1", 2, "B.java", "B.java", b"@@\n+b\n"), ("r", "1", 1, "A.java", "A.java", b"@@\n+a"), ("r", "2", 1, "A.java", "A.java", b""),
            ("r", "3", 1, "a.md", "a.md", b"x"), ("r", "4", 1, "A.java", "A.java", None), (None, "5", 1, "A.java", "A.java", b"@@\n"), ("r", "6", 1, "a.md", "a.md", None)]
    df = CO.assemble_commit_patch(spark.createDataFrame(rows, "repo string, commit_id string, ord int, a_path string, b_path string, patch binary"))
    plan = _plan(df)
    assert len(_exchanges(df)) == 1 and plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")  # plans are printed from the top
    assert sorted((r["commit_id"], r["text"], r["n_java"]) for r in df.collect()) == [
        ("1", "@@\n+a\n@@\n+b\n", 2), ("3", "", 0), ("5", "@@\n", 1), ("6", "", 0)]


def test_patches_of_line_items_are_made_once(spark):
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    item = lambda key, q, part=1, supp=2, status="F", flag="N": (key, part, supp, 3, q, 0.1, 0.1, flag, status)
    rows = [item(1, 4.0), item(1, 4.0), item(2, 10.0, status="O"), item(3, 5.0), item(4, 30.0, flag="A"), item(5, 3.0), item(6, 14.0), item(7, 8.0), item(8, None, status=None),
            item(9, 8.0, supp=None), item(10, 8.0, part=None), item(11, 8.0, flag=None), item(None, 8.0)]
    made = TB.changes_from_lineitem(spark.createDataFrame(rows, schema))
    plan = CO.assemble_commit_patch(made)._jdf.queryExecution().optimizedPlan().toString()
    # Once a row in a generator: every rule that names the patch would make it again, in one method too large for the JVM to compile.
    assert plan.count("int z;") == 1 and plan.count("int f") == 2 and "array_sort" not in plan
    ids = {r["id"]: r["key"] for r in spark.createDataFrame([(k,) for k in range(1, 12)], "key long").selectExpr("key", "md5(cast(key as string)) id").collect()}
    got = sorted(((ids.get(r["commit_id"], 0), r["repo"] or "", bytes(r["patch"])) for r in made.collect()))
    h, mark, old, new = b"@@ -1 +1 @@\n", b"\\ No newline at end of file\n", b"int v1 = 2;\n", b"int v1 = 3;\n"
    plain, after = h + b"-" + old + b"+" + new, h + b"-" + new + b"+" + new + h + b"-int z;\n+" + old + mark
    assert got == sorted([
        (1, "repo-1", plain), (1, "repo-1", plain), (2, "repo-2", (h + b"-" + old + mark + b"+" + old).replace(b"\n", b"\r\n")),
        (3, "repo-3", h + b"-" + new + b"-" + old + mark + b"+int y;\n+" + old), (4, "repo-4", after), (5, "repo-0", b""), (6, "repo-1", plain + b"\xff"),
        (7, "repo-2", plain), (7, "repo-fork", plain.replace(b"int v", b"int f")), (8, "repo-3", after), (9, "repo-4", h + b"+" + new), (10, "repo-0", h),
        (11, "repo-1", plain), (0, "", plain),
    ])


def test_lines_of_patches_are_not_split_into_words(spark):
    text = "ab = abc;\n\nif ab2 ab_c ab\nx.abc+ab y"
    docs = spark.createDataFrame([(i, "s", text) for i in range(8)] + [(8, "s", "1 2"), (11, "s", None), (-1, "s", "ab")], "doc_id long, source string, text string")
    made = TB.patches_from_documents(docs)
    assert "[^\\p{L}\\p{N}_])" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r["patch_id"]: [l[1:] for l in r["text"].split("\n") if l[:1] == "+"] for r in made.where("text is not null").collect()}
    one = ["ab_1 = abc;", "if ab2 ab_c ab_1", "x.abc+ab_1 y"]
    assert got == {
        "0": one, "1": ["ab_1 = abc_1;", "if ab2 ab_c ab_1", "x.abc_1+ab_1 y"], "2": ["ab_1 = abc_1;", "if_1 ab2 ab_c ab_1", "x.abc_1+ab_1 y"],
        "3": ["ab_1 = abc;", "if ab2 ab_c ab_2", "x.abc+ab_1 y"], "4": [l + " " for l in one], "5": one + ["package a.c;"], "6": text.replace("\n\n", "\n").split("\n"), "7": one, "8": ["1 2"], "-1": ["ab"],
    }
