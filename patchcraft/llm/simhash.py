"""SimHash near-dedup by segment popcounts (operator 2).

Fingerprints differing in at most ``max_bits`` = 2 bits have segment popcount
vectors at Manhattan distance 2 or less: flipping a bit moves one coordinate
by one.  That lower bound is the candidate test; ``bit_count(xor)`` verifies.

The range join runs on a grid of popcount cells.  Every distinct fingerprint
enters its own cell and the cells one step away in one coordinate, so two
vectors at distance 2 or less meet in a cell half way, and no side has to probe
the whole ball of radius 2.  With 16 segments of 4 bits a vector is one long
with a nibble for each segment.

Cells of up to ``pair_cell`` fingerprints compare their members.  A fuller cell
(one large group of near copies) would need quadratic work, so its members are
embedded again with 64 segments of one bit, where the Manhattan distance *is*
the bit distance: fingerprints meet at a point one flip away, and each point
links its members to their smallest one.  Both ways are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exchanged, id_and_bytes, type_of, written
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
SEGMENTS, SEGMENT_BITS = 16, 4
#: A cell with more fingerprints is resolved through single-bit segments.
PAIR_CELL = 32
#: Shingle hashes whose bits are added up at once.
BLOCK = 1 << 15


def fingerprint(text: bytes, k: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """Majority bits of the XXH64 of the k-word shingles of lower-cased (A-Z) text; no word: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= k:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[k - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` of every row, ``fp`` the fingerprint as a signed long; null and empty texts get 0."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, k) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, f"doc_id {type_of(docs, id_col)}, fp long")


def segment_popcounts(fp: Column) -> Column:
    """The popcount of each 4-bit segment, in the nibble of the segment."""

    def half(x: Column) -> Column:  # of 32 bits, so that no sum leaves a signed long
        fives, threes = F.lit(0x55555555), F.lit(0x33333333)
        pairs = x.bitwiseAND(fives) + F.shiftrightunsigned(x, 1).bitwiseAND(fives)
        return pairs.bitwiseAND(threes) + F.shiftrightunsigned(pairs, 2).bitwiseAND(threes)

    return F.shiftleft(half(F.shiftrightunsigned(fp, 32)), 32).bitwiseOR(half(fp.bitwiseAND(F.lit(0xFFFFFFFF))))


def _near_cells(v: Column) -> Column:
    """The cell of a popcount vector and those one step away; a coordinate stays within 0 to 4."""
    cells = [v]
    for s in range(SEGMENTS):
        nibble = F.shiftrightunsigned(v, SEGMENT_BITS * s).bitwiseAND(F.lit(15))
        # xor replaces the nibble alone, so that no carry crosses into the next segment.
        for step, ok in ((1, nibble < SEGMENT_BITS), (-1, nibble > 0)):
            cells.append(F.when(ok, v.bitwiseXOR(F.shiftleft(nibble.bitwiseXOR(nibble + F.lit(step)).cast("long"), SEGMENT_BITS * s))))
    return F.array_compact(F.array(*cells))


def links(fps: DataFrame, pair_cell: int = PAIR_CELL) -> DataFrame:
    """Edges ``(a, b)`` over distinct fingerprints ``fps(fp)`` whose components are those of all pairs within 2 bits."""
    rows = fps.select("fp", segment_popcounts(F.col("fp")).alias("v")).select("fp", F.explode(_near_cells(F.col("v"))).alias("cell"))
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = written(rows.join(exchanged(sizes), "cell"), "cells")

    # At most ``pair_cell`` members come together here.
    small = shared.where(F.col("members") <= pair_cell).groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    one = small.select("fps", F.explode("fps").alias("a"))
    near = F.filter("fps", lambda b: (b > F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(b)) <= MAX_BITS))
    pairs = one.select("a", F.explode(near).alias("b"))

    full = shared.where(F.col("members") > pair_cell).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    points = full.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = points.join(exchanged(least), "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, pair_cell: int = PAIR_CELL) -> DataFrame:
    """One row for each input row: ``doc_id, fingerprint, component_id, kept``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` the smallest
    doc_id reachable over links of at most 2 differing bits; ``kept`` marks the
    row of that id.  Equal fingerprints are one node, so exact copies add no
    links.  Null, empty and blank texts have fingerprint zero and link like any
    other.  A null doc_id never becomes a component_id unless no other id is in
    the component.  Repeated rows share their answer.  Empty input: no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, k), "fingerprints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(firsts.select("fp"), pair_cell))
    classes = firsts.join(exchanged(roots.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(exchanged(ids), "root").select("fp", "component_id")
    return prints.join(exchanged(named), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
