"""Published batches, the sinks on them, and deduplication against earlier batches."""

import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from patchcraft.operators import seen as SE
from patchcraft.sources import files as FS
from patchcraft.sources import publish as P
from patchcraft.sources import sinks as SK

SCHEMA = "patch_id string, text string, repo string"


@pytest.fixture
def base():
    return tempfile.mkdtemp(prefix="pc-published-")


def patches(spark, n=30, repo="hot"):
    return spark.createDataFrame([(f"r{i % 3}" if i % 2 else repo, str(i), f"text {i}") for i in range(n)], "repo string, patch_id string, text string")


def ids(df):
    return sorted(r.patch_id for r in df.select("patch_id").collect())


def test_a_second_run_adds_nothing(spark, base):
    df = patches(spark)
    assert P.publish(df, base, "b1", "repo") is True
    assert P.publish(df, base, "b1", "repo") is False
    assert ids(P.read_published(spark, base, SCHEMA)) == ids(df) and P.published(spark, base) == ["b1"]
    P.publish(patches(spark, 4), base, "b2", "repo")
    both = P.read_published(spark, base, SCHEMA)
    assert both.count() == 34 and {r.batch for r in both.select("batch").collect()} == {"b1", "b2"}


def test_a_failed_run_leaves_nothing_readable(spark, base):
    broken = patches(spark).withColumn("text", F.when(F.col("patch_id") == "29", F.raise_error(F.lit("boom"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="boom"):
        P.publish(broken, base, "b1")
    assert P.published(spark, base) == [] and P.read_published(spark, base, SCHEMA).count() == 0
    assert P.publish(patches(spark), base, "b1") is True
    assert P.read_published(spark, base, SCHEMA).count() == 30


def test_staged_files_without_a_manifest_are_not_read(spark, base):
    P.publish(patches(spark), base, "b1")
    patches(spark, 5).write.parquet(f"{base}/data/b2-left-behind")
    assert P.read_published(spark, base, SCHEMA).count() == 30
    with pytest.raises(ValueError):
        P.publish(patches(spark), base, "../b3")


def test_rows_of_a_repository_lie_in_few_files(spark, base):
    df = patches(spark, 600).repartition(16)
    SK.write_patches(df, f"{base}/t")
    assert all(len(glob.glob(f"{base}/t/repo={r}/*.parquet")) == 1 for r in ("hot", "r0", "r1", "r2"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows become one task
    try:
        P.placed(df, "repo", "patch_id", rows_per_file=60).write.partitionBy("repo").parquet(f"{base}/s")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert 1 < len(glob.glob(f"{base}/s/repo=hot/*.parquet")) <= 5  # 300 rows, split by hash
    assert spark.read.parquet(f"{base}/s").count() == 600


@pytest.mark.parametrize("name", ["write_patches", "write_cleaned", "write_spawned"])
def test_sinks_by_batch(spark, base, name):
    sink, df = getattr(SK, name), patches(spark)
    for _ in range(2):
        sink(df, f"{base}/t", batch="one")
    assert ids(P.read_published(spark, f"{base}/t", SCHEMA)) == ids(df)
    sink(df.limit(0), f"{base}/t", batch="two")
    assert P.published(spark, f"{base}/t") == ["one", "two"] and P.read_published(spark, f"{base}/t", SCHEMA).count() == 30


def test_selection_and_verdict_sinks_by_batch(spark, base):
    chosen = patches(spark).withColumn("label", (F.col("repo") == "hot").cast("int"))
    verdicts = spark.createDataFrame([("r", "1", "y", "a->b", 1), (None, "2", "n", None, 0)], "repo string, patch_id string, verdict string, message string, n_renames long")
    for _ in range(2):
        SK.write_selection(chosen, f"{base}/s", batch="b")
        SK.write_verdicts(verdicts, f"{base}/v", batch="b")
    got = P.read_published(spark, f"{base}/s", SCHEMA + ", label int, label_dir string")
    assert {(r.label, r.label_dir, r["count"]) for r in got.groupBy("label", "label_dir").count().collect()} == {(1, "yes", 15), (0, "no", 15)}
    lines = P.read_published(spark, f"{base}/v", "value string, repo string", "text")
    assert {(r.repo, r.value) for r in lines.collect()} == {("r", "1||y|a->b"), (None, "2||n|")} or lines.count() == 2


def test_overwriting_sinks_still_replace(spark, base):
    SK.write_cleaned(patches(spark), f"{base}/c")
    SK.write_cleaned(patches(spark, 3), f"{base}/c")
    assert spark.read.parquet(f"{base}/c").count() == 3
    SK.write_vocabulary(spark.createDataFrame([("b",), ("a",)], "word string"), f"{base}/w")
    assert FS.read_vocabulary(spark, f"{base}/w").count() == 2


# --- deduplication against earlier batches


def rows(spark, n, seed):
    rng = random.Random(seed)
    found = [(i, rng.choice(["", None, *[f"t{k}" for k in range(25)]]), i % 2) for i in range(n)]
    return spark.createDataFrame(found + found[:3], "doc_id long, text string, label int")


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_batches_give_what_one_gives(spark, base, bits):
    df = rows(spark, 90, 1)
    at_once = SE.SeenTexts(spark, f"{base}/one", bits).unseen(df, "text", "doc_id")
    index = SE.SeenTexts(spark, f"{base}/many", bits)
    kept = []
    for k in range(3):
        part = df.where(F.floor(F.col("doc_id") / 30) == k)
        new = index.unseen(part, "text", "doc_id")
        kept += [tuple(r) for r in new.collect()]
        assert index.add(new, "text", f"b{k}") is True
        assert index.unseen(part, "text", "doc_id").count() == 0
    key = lambda r: (r[0], r[1] or "")
    assert sorted(kept, key=key) == sorted((tuple(r) for r in at_once.collect()), key=key)
    texts = [t for _, t, _ in kept]
    assert len(texts) == len(set(texts)) == df.select("text").distinct().count()


def test_adding_a_batch_twice_changes_nothing(spark, base):
    index = SE.SeenTexts(spark, base, 1 << 10)
    assert index.add(rows(spark, 20, 2), "text", "b") is True
    n = index.digests().count()
    assert index.add(rows(spark, 20, 3), "text", "b") is False and index.digests().count() == n


def test_the_filter_knows_every_digest(spark, base):
    index = SE.SeenTexts(spark, base, 1 << 10)
    index.add(rows(spark, 60, 4), "text", "b")
    bloom = index.filter().first()["bloom"]
    assert len(bloom) == 16
    set_bits = {64 * w + b for w, mask in enumerate(bloom) for b in range(64) if mask >> b & 1}
    places = index.digests().select(SE._places(1 << 10).alias("p")).collect()
    assert all(set(r.p) <= set_bits for r in places) and len(set_bits) <= 5 * len(places)


def test_nothing_in_nothing_out(spark, base):
    index = SE.SeenTexts(spark, base, 1 << 10)
    assert index.unseen(rows(spark, 5, 1).limit(0), "text", "doc_id").count() == 0
