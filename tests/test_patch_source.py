"""The data source of patch files: names, sizes, partitions and the stream."""

import os
import tempfile

import pytest

from patchcraft.sources import patch_source as PS


def _write(folder, rel, text):
    p = os.path.join(folder, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(text)


@pytest.fixture
def folder():
    d = tempfile.mkdtemp(prefix="pc-source-")
    _write(d, "_repo/_a b+c.diff", b"@@\n-x\n+y\n")
    _write(d, "_repo/yes/d.diff", "@@\n é\n".encode())
    _write(d, "plain/e.diff", b"")
    _write(d, "plain/bad.diff", b"\xff@")
    _write(d, "plain/big.diff", b"@@\n" + b"x" * 3000)
    _write(d, "top.diff", b"@@\n")
    _write(d, ".git/f.diff", b"@@\n")
    _write(d, "plain/.g.diff", b"@@\n")
    _write(d, "plain/notes.txt", b"@@\n")
    return d


def test_names_and_texts(spark, folder):
    got = {(r["repo"], r["patch_id"]): (r["text"], r["n_bytes"]) for r in PS.read_patches(spark, folder).where("n_bytes < 3000").collect()}
    assert got == {("_repo", "_a b+c"): ("@@\n-x\n+y\n", 9), ("yes", "d"): ("@@\n é\n", 7), ("plain", "e"): ("", 0),
                   ("plain", "bad"): ("�@", 2), (os.path.basename(folder), "top"): ("@@\n", 3)}
    direct = {r["patch_id"] for r in PS.read_dataset(spark, folder).select("patch_id").collect()}
    assert direct == {"_a b+c", "e", "bad", "big"}
    assert {r["patch_id"] for r in PS.read_patches(spark, folder, recursive="false").collect()} == {"top"}


def test_sizes_before_reading(spark, folder):
    limited = PS.read_patches(spark, folder, maxFileKb=2)
    assert "big" not in {r["patch_id"] for r in limited.collect()} and limited.count() == 5
    os.chmod(os.path.join(folder, "plain/big.diff"), 0)  # read, it would fail (but for root)
    reader = PS.PatchReader({"path": folder})
    assert list(reader.pushFilters([PS.LessThan(("n_bytes",), 3000), PS.GreaterThan(("n_bytes",), 2), PS.EqualTo(("repo",), "yes")])) == [PS.EqualTo(("repo",), "yes")]
    assert sorted(n for p in reader.partitions() for _, n in p.files) == [3, 7, 9]


def test_partitions_by_bytes(spark, folder):
    assert len(PS.PatchReader({"path": folder, "partitionBytes": "1"}).partitions()) == 6
    assert len(PS.PatchReader({"path": folder}).partitions()) == 1
    empty = tempfile.mkdtemp(prefix="pc-empty-")
    assert PS.read_patches(spark, empty).count() == 0


def test_stream_gives_each_file_once(spark, folder):
    PS.register(spark)
    state, out = tempfile.mkdtemp(prefix="pc-state-"), tempfile.mkdtemp(prefix="pc-out-")

    def run():
        stream = spark.readStream.format("patches").option("path", folder).load().select("patch_id")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(r["patch_id"] for r in spark.read.schema("patch_id string").parquet(out).collect())

    first = run()
    assert first == sorted(["_a b+c", "d", "e", "bad", "big", "top"])
    _write(folder, "_late/z.diff", b"@@\n")
    assert run() == sorted([*first, "z"])
