"""Best-fit packing by hierarchical residual packing (operator 8).

Documents become pieces of at most ``capacity`` tokens.  A round packs each
partition on its own, largest item first, each into the fullest bin with room
(best fit).  The bins with the most room, one more than partitions meet in the
next round, go on to it as items; all others are emitted.  The rounds run over
fewer and fewer partitions, to one at the root.

That bounds every later task by the number of partitions that meet there,
whatever the lengths are, and costs next to nothing: after best fit at most one
bin of a partition is under half full, so two bins can only be joined if one
of them is such a bin, and for each of these as many bins go on that could take
it, those with the most room.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import type_of, written
from .words import encoder

CAPACITY = 4096
END_ID = 1
#: A bin with so few tokens free is always emitted.
SLACK = 8
#: Documents in a partition of the first round, on average, and partitions that share one of the next.
LEAF_PIECES, FAN_IN = 4_000, 8


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and END_ID, cut every ``capacity`` tokens."""

    def run(batches):
        encode = encoder(tokenizer).encode
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = encode(text) + end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).mapInArrow(
        run, f"doc_id {type_of(docs, id_col)}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins, as lists of places in ``sizes``: largest first, each into the bin with the least room that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []  # the rooms that some open bin has, ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect.bisect_left(rooms, sizes[i])
        if k < len(rooms):
            room = rooms[k]
            at = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        left = room - sizes[i]
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(at)
    return bins


def _round(items: DataFrame, capacity: int, slack: int, level: int, handed: int) -> DataFrame:
    """Packs the items of each ``part`` anew.

    ``items`` has a row for each piece: the item it is in (``origin, bin``),
    that item's ``fill`` and the piece's ``offset`` there.  The result has the
    new ``bin``, ``fill`` and ``offset``, and ``sequence_id`` where the bin is
    emitted: all but the ``handed`` ones with the most room.
    """

    def pack_part(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["origin", "bin", "doc_id", "piece", "ids_crc32"], kind="stable")
        item = frame.groupby(["origin", "bin"], sort=False).ngroup().to_numpy()
        sizes = frame["fill"].to_numpy()[np.unique(item, return_index=True)[1]].tolist()
        to, at, fills = [0] * len(sizes), [0] * len(sizes), []
        for k, content in enumerate(best_fit(sizes, capacity)):
            fill = 0
            for i in content:
                to[i], at[i] = k, fill
                fill += sizes[i]
            fills.append(fill)
        now = np.array(to, np.int64)[item]
        bin_fills = np.array(fills, np.int64)
        emitted = capacity - bin_fills <= slack
        emitted[np.argsort(bin_fills, kind="stable")[handed:]] = True
        fill, done = bin_fills[now], emitted[now] | (not handed)
        part = frame["part"].to_numpy()
        return frame.assign(
            origin=part, bin=now, fill=fill, offset=frame["offset"].to_numpy() + np.array(at, np.int64)[item],
            sequence_id=pd.Series(np.where(done, (level << 58) + (part << 28) + now, -1), index=frame.index),
        )

    return items.groupBy("part").applyInPandas(pack_part, items.withColumn("sequence_id", F.lit(0).cast("long")).schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, leaf_pieces: int = LEAF_PIECES, fan_in: int = FAN_IN) -> DataFrame:
    """``pieces(doc_id, piece, start, length, ids_crc32)`` with ``sequence_id`` and ``offset``; read twice, so write it first.

    Every round is written to the shared folder, so a lost executor repeats
    its own partitions with the same outcome.
    """
    parts = max(1, -(-pieces.count() // leaf_pieces))
    # The row's own number too, so that pieces that are alike in all else do not share a partition.
    number = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    items = pieces.select(
        F.pmod(number, F.lit(parts)).cast("long").alias("part"), F.lit(0).cast("long").alias("origin"),
        F.monotonically_increasing_id().alias("bin"), F.col("length").alias("fill"), F.lit(0).cast("long").alias("offset"), *pieces.columns,
    )
    emitted, level = [], 0
    while True:
        bins = written(_round(items, capacity, slack, level, fan_in + 1 if parts > 1 else 0), "bins")
        emitted.append(bins.where("sequence_id >= 0"))
        if parts == 1:
            break
        parts, level = -(-parts // fan_in), level + 1
        items = bins.where("sequence_id < 0").drop("sequence_id").withColumn("part", F.pmod("part", F.lit(parts)))
    placed = emitted[0]
    for more in emitted[1:]:
        placed = placed.unionByName(more)
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document's ids end with END_ID, so null and empty texts are one piece of
    one token.  Only documents over ``capacity`` tokens are cut.  Sequences
    hold whole pieces back to back from offset 0.  Rows that repeat a doc_id
    are packed on their own; a null doc_id stays null.  Empty input: no rows.
    """
    return pack(written(token_pieces(docs, tokenizer, capacity, id_col, text_col), "pieces"), capacity, **how)
