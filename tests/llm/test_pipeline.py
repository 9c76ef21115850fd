import random
import re
from collections import defaultdict

from pyspark.sql import functions as F


def test_stages_keep_columns_and_remove_what_they_should(llm, docs):
    import corpus_pipeline as C

    stages = dict(C.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    sf = "/root/testdata/sf0.001"
    table = llm.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in table.collect()}

    kept = stages["quality_classifier"](llm, table, sf)
    assert kept.columns == table.columns
    labels = {r["doc_id"]: r for r in llm.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r["doc_id"] for r in kept.collect()}
    good = [i for i, r in labels.items() if r["quality"] == 1]
    assert sum(i in left for i in good) > 0.98 * len(good)

    exact = stages["exact_dedup"](llm, table, sf)
    texts = [re.sub("[\x20\x09-\x0d]", "", r["text"]) for r in exact.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub("[\x20\x09-\x0d]", "", t) for t in before.values()})

    cut = stages["suffix_array_dedup"](llm, exact, sf)
    assert cut.columns == table.columns and cut.count() == exact.count()
    seen = defaultdict(int)
    for r in cut.collect():
        assert r["n_chars"] == len(r["text"]) <= len(before[r["doc_id"]])
        for i in range(len(r["text"].encode()) - 199):
            seen[r["text"].encode()[i : i + 200]] += 0
    near = stages["simhash_near_dedup"](llm, table, sf)
    assert near.columns == table.columns and near.count() <= exact.count()


def test_run_packs_what_the_stages_keep(llm):
    import corpus_pipeline as C

    out = C.run(llm, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    per = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top")).collect()
    assert per and all(r["n"] == r["top"] <= 4096 for r in per)


def test_stages_on_odd_rows(llm, docs, corpus):
    import corpus_pipeline as C

    rows = docs.withColumn("n_chars", F.lit(1).cast("long"))
    for name, stage in C.STAGES[1:4]:
        rows = stage(llm, rows, "/root/testdata/sf0.001")
        assert set(rows.columns) == {"doc_id", "text", "lang", "kept", "fp", "row", "n_chars"}, name
    assert rows.where("doc_id is null").count() == 1
    assert stage(llm, rows.limit(0), "/root/testdata/sf0.001").count() == 0


def test_repeated_rows_and_rows_without_an_id_stay_once(llm):
    import corpus_pipeline as C

    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(90))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (3, d), (4, d), (5, d[:200] + "\n" + d[200:]), (5, None), (None, "")]
    for n in (2, 1):
        docs = llm.createDataFrame(rows * n, "doc_id long, text string").withColumn("lang", F.lit("xx")).withColumn("n_chars", F.length("text").cast("long")).repartition(3)
        for name, stage in C.STAGES[1:4]:
            docs = C.written(stage(llm, docs, None), name)
        squeezed = sorted(re.sub(r"\s", "", r["text"] or "") for r in docs.collect())
        assert squeezed == sorted(re.sub(r"\s", "", t) for t in (a, b, c, d, ""))


def test_quality_judges_rows_without_an_id(llm, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(100)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(100)), "xx") for i in range(100)] + [(None, "#$%& <|>* " * 60, "xx")] * 2
    llm.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = C.quality(llm, llm.createDataFrame(rows, "doc_id long, text string, lang string"), str(tmp_path))
    assert left.where("doc_id is null").count() == 0 and left.count() >= 96


def test_no_stage_broadcasts_a_table_that_grows(llm, docs, monkeypatch):
    import corpus_pipeline as C
    from patchcraft.llm import components, exact, kneser, simhash, suffix

    plans = []
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    write = C.written
    for module in (C, components, exact, kneser, simhash, suffix):
        monkeypatch.setattr(module, "written", lambda df, name: (seen(df), write(df, name))[1])
    sf = "/root/testdata/sf0.001"
    quality = C.quality(llm, docs, sf)
    for name, stage in C.STAGES[1:4]:
        seen(stage(llm, docs, sf))
    assert not any("Broadcast" in p for p in plans) and sum(p.count("SortMergeJoin") for p in plans) > 25
    # Of the first stage only the thresholds, a few rows of known size, go to all tasks.
    last = quality._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in last and "BroadcastHashJoin [pipeline_row_key" not in last
