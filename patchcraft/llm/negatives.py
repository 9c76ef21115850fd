"""Hard-negative mining by a secondary-sort shuffle of pair scores.

A row's score is its inner product with an anchor.  Scores travel packed into
byte keys of (anchor, descending score, kind, id); repartitionAndSortWithinPartitions
deals them by anchor and sorts them, and an iterator reads each partition once:
a positive opens a window of scores just below its own, a negative goes to the
windows that are open.  It holds the open windows of one anchor, never an
anchor's rows.

Not all pairs are packed.  Anchors are taken in chunks of a fixed size, the
only thing broadcast, and all rows pass by each chunk in batches, as a stated
query set against all rows.  A task keeps the best ``positives`` rows of each
anchor in what it has read, which is all that can be among the best of all.
Once an anchor's positives are known, a task keeps the first ``negatives`` rows
in each of its windows, for the same reason.  Nothing is capped: what a task
leaves out stands behind enough better rows of the same task.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .common import type_of, written
from .ranks import numbered

#: Components of the anchors of a chunk: with their windows all that is broadcast or on the driver at once.
CHUNK = 1 << 21
#: Rows and anchors of which a task makes the scores at once.
ROWS, ANCHORS = 8_192, 256

_KEY = struct.Struct(">IQBBQ")
_TOP, _BIAS = (1 << 63) - 1, 1 << 63


def pack(anchor: int, score: int, negative: bool, row_id: int | None) -> bytes:
    """A key whose byte order is by anchor, then higher scores, positives first, smaller ids, no id last."""
    return _KEY.pack(anchor, _TOP - score, negative, row_id is None, 0 if row_id is None else row_id + _BIAS)


def unpack(key: bytes) -> tuple[int, int, bool, int | None]:
    anchor, score, negative, no_id, row_id = _KEY.unpack(key)
    return anchor, _TOP - score, bool(negative), None if no_id else row_id - _BIAS


def windows(keys: Iterable[bytes], low: int, high: int, negatives: int) -> Iterator[tuple]:
    """(anchor, positive id, rank, negative id, positive score, negative score) from sorted keys.

    A negative counts for a positive if low * positive <= high * negative <=
    high * positive, up to ``negatives`` of them.
    """
    now, open_ = None, []
    for key in keys:
        anchor, score, negative, row_id = unpack(key)
        if anchor != now:
            now, open_ = anchor, []
        if not negative:
            open_.append([score, row_id, 0])
            continue
        open_ = [w for w in open_ if w[2] < negatives and low * w[0] <= high * score]
        for w in open_:
            if score <= w[0]:
                w[2] += 1
                yield anchor, w[1], w[2], row_id, w[0], score


def grid(vector: Column, cells: int) -> Column:
    """Each component x as floor(cells * x), long (beyond its range: its nearest bound); null if a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    top = float(2**62)
    cell = lambda x: F.floor(F.greatest(F.least(x.cast("double") * cells, F.lit(top)), F.lit(-top)))
    return F.when(fine, F.transform(vector, cell))


class Block:
    """Vectors as a matrix of integers; shorter ones end in zeros."""

    def __init__(self, vectors: pa.Array):
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.diff(vectors.offsets.to_numpy()).astype(np.int64)
        self.cells = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
        self.cells[np.arange(self.cells.shape[1]) < sizes[:, None]] = flat
        self.most = int(max(flat.max(initial=0), -flat.min(initial=0)))

    def scores(self, other: "Block", a: slice, b: slice) -> np.ndarray:
        """Exact inner products of own rows ``a`` with other's rows ``b``; those beyond a long take its nearest bound."""
        width = min(self.cells.shape[1], other.cells.shape[1])
        x, y = self.cells[a, :width], other.cells[b, :width]
        bound = width * self.most * other.most
        if bound < 1 << 53:
            kind = np.float32 if bound < 1 << 24 else np.float64
            return (x.astype(kind) @ y.astype(kind).T).astype(np.int64)
        return np.clip(x.astype(object) @ y.astype(object).T, -_TOP, _TOP).astype(np.int64)


def _best(scores: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` of ``places`` with the highest scores; of equal scores the first places."""
    own = scores[places]
    if len(own) > n:
        least = np.partition(own, len(own) - n)[len(own) - n]
        above = np.flatnonzero(own > least)
        tied = np.flatnonzero(own == least)[: n - len(above)]
        pick = np.concatenate([above, tied])
        places, own = places[pick], own[pick]
    return places[np.lexsort((places, -own))]


class Chunk:
    """Anchors with their vectors, labels and row numbers; once known, with the scores of their positives."""

    def __init__(self, rows: pa.Table):
        self.ids = rows["vec_id"].to_pylist()
        self.labels = rows["label"].to_numpy()
        self.row = rows["row"].to_numpy()
        self.block = Block(rows["cells"].combine_chunks())
        self.tops: list[list[int]] = [[] for _ in self.ids]


class Kept:
    """For each place (anchor, or anchor and window) the first ``n`` entries (score, id, row) by descending score, then id, none last."""

    def __init__(self, n: int):
        self.n, self.held = n, {}

    def add(self, place, entries: list[tuple]) -> None:
        old = self.held.get(place)
        if old:
            entries = sorted(old + entries, key=lambda e: (-e[0], e[1] is None, e[1] or 0, e[2]))[: self.n]
        self.held[place] = entries


class Part:
    """Rows by label, the first that are scored at once."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        self.ids, self.labels, self.row = rows["vec_id"].to_pylist(), rows["label"].to_numpy(), rows["row"].to_numpy()
        self.block = Block(rows["cells"].combine_chunks())
        self.by_id = np.empty(len(self.ids), np.int64)
        self.by_id[sorted(range(len(self.ids)), key=lambda p: (self.ids[p] is None, self.ids[p] or 0))] = np.arange(len(self.ids))

    def best(self, scores: np.ndarray, places: np.ndarray, n: int) -> list[tuple]:
        """The first ``n`` of ``places`` as (score, id, row), by descending score, then id."""
        own = scores[places]
        if len(own) > n:
            least = np.partition(own, len(own) - n)[len(own) - n]
            places = places[own >= least]
            own = scores[places]
        places = places[np.lexsort((self.by_id[places], -own))[:n]]
        return [(int(scores[p]), self.ids[p], int(self.row[p])) for p in places]


def _scored(batches: Iterator[pa.RecordBatch], chunk: Chunk) -> Iterator[tuple[Part, int, np.ndarray, int, int]]:
    """(part, anchor, scores of the part's rows, where the anchor's label begins and ends among them)."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = Part(pa.Table.from_batches([batch.slice(start, ROWS)]))
            for at in range(0, len(chunk.ids), ANCHORS):
                anchors = slice(at, at + ANCHORS)
                made = part.block.scores(chunk.block, slice(None), anchors).T
                first, last = (np.searchsorted(part.labels, chunk.labels[anchors], side) for side in ("left", "right"))
                for i, scores in enumerate(made):
                    yield part, at + i, scores, int(first[i]), int(last[i])


def _table(entries: Iterable[tuple]) -> pa.RecordBatch:
    columns = zip(*entries, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "score", "vec_id", "row"])


def best_same(batches: Iterator[pa.RecordBatch], chunk: Chunk, positives: int) -> Iterator[pa.RecordBatch]:
    """The best ``positives`` other rows of the same label for each anchor, in what the task reads."""
    kept = Kept(positives)
    for part, anchor, scores, first, last in _scored(batches, chunk):
        places = np.arange(first, last)
        places = places[part.row[first:last] != chunk.row[anchor]]
        if len(places):
            kept.add(anchor, part.best(scores, places, positives))
    if kept.held:
        yield _table((a, *e) for a, entries in kept.held.items() for e in entries)


def first_below(batches: Iterator[pa.RecordBatch], chunk: Chunk, low: int, high: int, negatives: int) -> Iterator[pa.RecordBatch]:
    """The first ``negatives`` rows of other labels in each window of each anchor, in what the task reads; a row once."""
    kept = Kept(negatives)
    for part, anchor, scores, first, last in _scored(batches, chunk):
        spans = [(-(-low * top // high), top) for top in chunk.tops[anchor]]
        spans = [(a, b) for a, b in spans if a <= b]
        if not spans:
            continue
        near = np.flatnonzero((scores >= min(spans)[0]) & (scores <= max(b for _, b in spans)))
        near = near[(near < first) | (near >= last)]
        for a, b in spans:
            inside = near[(scores[near] >= a) & (scores[near] <= b)]
            if len(inside):
                kept.add((anchor, b), part.best(scores, inside, negatives))
    found = {(anchor, *e) for (anchor, _), entries in kept.held.items() for e in entries}
    if found:
        yield _table(sorted(found, key=lambda e: e[0]))


_ENTRY = "anchor long, score long, vec_id long, row long"


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    cells: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    chunk_cells: int = CHUNK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds.

    Components count as floor(cells * x); a score is the integer inner product.
    An anchor's positives are its best other rows of the same label; for each,
    the first rows of other labels follow whose scores are ``low`` / ``high`` of
    the positive's to all of it (none for a positive below zero).

    Rows with a null label, a null vector, or a component that is null or not
    finite take no part.  A row without an id can be a positive or negative and
    comes last among equal scores.  Vectors of other lengths count as ending in
    zeros; an empty one scores 0 everywhere.  Repeated rows are rows of their
    own: each is an anchor, and one may be the other's positive.  Equal scores
    with equal ids are the same entry.  Components beyond 2**62 and scores
    beyond a long take the nearest bound.  Other columns play no part.  No
    rows, or no anchor, give no rows.
    """
    spark = rows.sparkSession
    taken = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), grid(F.col(vector_col), cells).alias("cells"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"), F.monotonically_increasing_id().alias("row"),
    ).where("label IS NOT NULL AND cells IS NOT NULL")
    taken = written(taken, "vectors")
    n, width = taken.where("is_anchor").agg(F.count(F.lit(1)), F.max(F.size("cells"))).first()
    anchors = written(numbered(taken.where("is_anchor").withColumn("all", F.lit("")), ["all"], ["vec_id", "row"]), "anchors")
    scored = taken.select("vec_id", "label", "cells", "row")
    size = max(1, chunk_cells // max(1, width or 0))
    schema = f"anchor_id {type_of(rows, id_col)}, positive_id {type_of(rows, id_col)}, rank int, negative_id {type_of(rows, id_col)}, positive_score long, negative_score long"
    done = [
        _of_chunk(scored, anchors.where(F.col("pos").between(at, at + size - 1)), positives, negatives, low, high, schema)
        for at in range(0, n, size)
    ]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def _of_chunk(scored: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int, schema: str) -> str:
    """Folder with the result of one chunk of anchors; the driver holds the chunk and its positives' scores."""
    spark = scored.sparkSession
    context = spark.sparkContext
    chunk = Chunk(anchors.select("vec_id", "label", "cells", "row").toArrow())
    sent = context.broadcast(chunk)
    some = scored.mapInArrow(lambda batches: best_same(batches, sent.value, positives), _ENTRY)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = written(some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"), "positives")
    for a, score in best.select("anchor", "score").distinct().collect():
        chunk.tops[a].append(score)
    ids = chunk.ids
    opened = context.broadcast(chunk)
    near = scored.mapInArrow(lambda batches: first_below(batches, opened.value, low, high, negatives), _ENTRY)

    keys = [df.rdd.map(lambda e, negative=negative: (pack(e.anchor, e.score, negative, e.vec_id), None)) for negative, df in ((False, best), (True, near))]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = context.union(keys).repartitionAndSortWithinPartitions(parts, lambda key: int.from_bytes(key[:4], "big"))
    mined = in_order.mapPartitions(lambda pairs: ((ids[w[0]], *w[1:]) for w in windows((key for key, _ in pairs), low, high, negatives)))
    path = shared_path(spark, "llm", f"negatives-{uuid.uuid4().hex}")
    spark.createDataFrame(mined, schema).write.parquet(path)
    sent.unpersist()
    opened.unpersist()
    return path
