"""Tokeniser, n-grams, ranks and splits."""

from pyspark.sql import functions as F

from patchcraft.functions import text as T
from patchcraft.operators import dataset as D
from patchcraft.operators import tokens as TK
from samples import shuffled_records


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first()["x"]


def test_tokenise_newlines(spark):
    toks = _one(spark, T.tokenise("t"), "\nhello\nworld\n")
    assert toks == ["\n", "hello", "\n", "world", "\n"]
    assert all(t == "\n" or not (t.startswith("\n") or t.endswith("\n")) for t in toks)


def test_tokenise_punctuation(spark):
    assert _one(spark, T.tokenise("t"), "a_b fn(n)=1+2=3;") == \
        ["a_b", "fn", "(", "n", ")", "=", "1", "+", "2", "=", "3", ";"]


def test_standardise_numbers(spark):
    assert _one(spark, T.standardise_numbers("t"), "@@ -9,8 +9,8 @@") == "@@ -1,1 +1,1 @@"
    assert _one(spark, T.standardise_numbers("t"), "1.x 3. 12f 1.5.2 1_0 x1 0x1F 10L") == \
        "1x 1. 12f 1.1 1_0 x1 0x1F 10L"


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "tokens array<string>")
    got = [r["g"] for r in df.select(TK.ngrams("tokens").alias("g")).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_seeded_rank_matches_global_order(spark):
    import hashlib

    keys = [f"k{i}" for i in range(500)]
    df = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "path string, label int")
    got = {r["path"]: r["rank"] for r in D.seeded_rank(df, "path", digits=2).collect()}
    expect = sorted(keys, key=lambda k: (hashlib.md5(f"977:{k}".encode()).hexdigest(), k))
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == expect
    by = D.seeded_rank(df, "path", "s", by=["label"], bounded_groups=True).groupBy("label").agg(
        F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert all(r["m"] == r["n"] for r in by)


def test_split_dataset_invariants(spark):
    rows = [(f"r/{'yes' if i % 5 == 0 else 'no'}/{i}.diff", int(i % 5 == 0), ["x"] * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "path string, label int, tokens array<string>")
    s = D.split_dataset(df).collect()
    paths = [r["path"] for r in s]
    assert len(paths) == len(set(paths))                      # disjoint
    val = [r for r in s if r["split"] == "validation"]
    assert len(val) == 300 // 10
    assert len(s) == 300                                      # nothing is lost: what balancing leaves out is "unused"
    rest = [r for r in s if r["split"] in ("train", "test")]
    assert sum(r["label"] for r in rest) * 2 == len(rest)     # balanced
    train = [r for r in rest if r["split"] == "train"]
    assert len(train) == int(len(rest) / 5 * 4)
    st = D.stability_check(lambda: D.split_dataset(df)).first()
    assert st["stable"]


def test_split_fingerprint_of_many_rows(spark):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("path"), F.lit("train").alias("split"))
    one = D.split_fingerprint(rows).first()
    assert one["n_rows"] == 200_000 and int(one["fingerprint"]) > 2**63
    assert D.split_fingerprint(rows.repartition(7)).first() == one


def test_load_has_no_limit_unless_given(spark):
    df = spark.createDataFrame([("a", 1, "@@ x", 20_000), ("b", 0, "@@ y", 5), ("c", 0, "no", 5)], "path string, label int, text string, n_bytes long")
    assert D.load_examples(df).count() == 2 and D.load_examples(df, max_file_kb=10).count() == 1
    assert tuple(D.load_report(df, max_file_kb=10).first()) == (1, 1, 1)


def test_token_ids_keep_every_token_without_a_length(spark):
    df = spark.createDataFrame([("p", ["a", "b"] * 50), ("e", [])], "path string, tokens array<string>")
    vocab = TK.top_k_tokens(TK.token_frequency(df), k=1)
    got = {r["path"]: (r["ids"], r["n_unknown"]) for r in TK.token_ids(df, vocab).collect()}
    assert got == {"p": ([2, 1] * 50, 50), "e": ([], 0)}


def test_top_k_and_token_ids(spark):
    df = spark.createDataFrame([("p1", ["a", "b", "a"]), ("p2", ["c", "a"]), ("p3", [])], "path string, tokens array<string>")
    vocab = TK.top_k_tokens(TK.token_frequency(df), k=2)
    assert [(r["token"], r["rank"]) for r in vocab.orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    ids = {r["path"]: (r["ids"], r["n_unknown"]) for r in TK.token_ids(df, vocab, 4).collect()}
    assert ids["p1"] == ([2, 3, 2, 0], 0)
    assert ids["p2"] == ([1, 2, 0, 0], 1)
    assert ids["p3"] == ([0, 0, 0, 0], 0)


def test_token_ids_exchange_no_tokens(spark):
    rows = [("p", ["a", "b", None] * 100), ("q", ["x"]), ("q", []), ("q", ["b", "x", "a"]), (None, ["a"]), (None, ["b"]), ("e", []), ("n", None)]
    df = spark.createDataFrame(rows, "path string, tokens array<string>")
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "token string, rank long")
    lookup = vocab.select(F.col("token").alias("_tok"), (F.col("rank") + 1).cast("int").alias("_id"))
    told = lambda out: sorted((r["path"] or "", r["ids"], r["n_unknown"]) for r in out.collect())
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled_records(TK.token_ids(df, vocab)) <= 2 * len(rows)
        got = told(TK.token_ids(df, vocab))
        assert got == told(TK._joined_ids(df, lookup, None, "path", "tokens"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got[1:] == [("e", [], 0), ("p", [2, 3, 1] * 100, 100), ("q", [], 0), ("q", [1, 3, 1, 2], 2)] and sorted(got[0][1]) == [2, 3]
