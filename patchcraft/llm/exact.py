"""Exact dedup over content-defined chunk recipes (operator 5).

A text, without its white space, is cut where the eight bytes before a place
hash to a boundary value, so equal texts get equal cuts and near copies share
most chunks.  Tasks read rows in blocks and give each distinct chunk of a block
once, by its SHA-256 and size, and each row as a list of places among the
block's chunks.  One table of all distinct chunks gives every chunk its
identifier; the identifiers go back to the blocks, where each row's places
become its recipe, the ordered list of identifiers.  Texts are equal when their
recipes are.  Only digests, identifiers and recipes move, never the texts; a
chunk or a text that a third of all rows have moves once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import exchanged, type_of, written

#: Least and greatest bytes of a chunk, and one boundary in so many places.
MIN_CHUNK, MAX_CHUNK, MEAN_CHUNK = 256, 16384, 1024
#: Bytes of text and rows that a block has, about; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 1 << 24, 1 << 15
_WHITE = b" \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WINDOW = 8


def boundaries(data: bytes) -> np.ndarray:
    """Places p at which the eight bytes before p hash to a boundary."""
    n = len(data) - _WINDOW + 1
    if n < 1:
        return np.empty(0, np.int64)
    words = np.empty(n, np.uint64)
    for r in range(min(_WINDOW, n)):
        count = (len(data) - r) // _WINDOW
        words[r :: _WINDOW] = np.frombuffer(data, "<u8", count, r)
    mixed = (words * _MIX) >> np.uint64(32)
    return np.flatnonzero(mixed % np.uint64(MEAN_CHUNK) == 0) + _WINDOW


def cut(size: int, places: list[int]) -> list[int]:
    """Ends of the chunks of a text of ``size`` bytes with boundaries at ``places`` (from its start, ascending)."""
    ends, last = [], 0
    for p in [*places, size]:
        while p - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if p - last >= MIN_CHUNK or (p == size and p > last):
            last = p
            ends.append(p)
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    out, last = [], 0
    for end in cut(len(data), [p for p in boundaries(data).tolist() if p <= len(data)]):
        out.append(data[last:end])
        last = end
    return out


def normalised(text: bytes) -> bytes:
    return text.translate(None, _WHITE)


def block_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``block, place, sha256, n_bytes, doc_id, n_code_points, text_sha256, chunks``.

    A row with ``sha256`` for each distinct chunk of a block: its place there
    and its size.  A row without for each input row: its place among the
    block's rows and, in ``chunks``, the places of its chunks in order (null
    and empty texts have none).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_code_points"), F.col("text").cast("binary").alias("body"))
    kinds = {
        "block": pa.int64(), "place": pa.int32(), "sha256": pa.binary(), "n_bytes": pa.int64(), "doc_id": to_arrow_schema(rows.select("doc_id").schema).field(0).type,
        "n_code_points": pa.int64(), "text_sha256": pa.string(), "chunks": pa.binary(),
    }

    def batch(number: int, n: int, **given) -> Iterator[pa.RecordBatch]:
        given |= {"block": pa.array(np.full(n, number)), "place": pa.array(np.arange(n, dtype=np.int32))}
        whole = pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(n, kind) for k, kind in kinds.items()], names=list(kinds))
        for i in range(0, n, 1 << 13):
            yield whole.slice(i, 1 << 13)

    def block(number: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, int], int] = {}
        whole, chunks = [], []
        for part in parts:
            for body in part.column("body"):
                data = normalised(body.as_py())
                whole.append(hashlib.sha256(data).hexdigest())
                places = [found.setdefault((hashlib.sha256(c).digest(), len(c)), len(found)) for c in chunks_of(data)]
                chunks.append(np.array(places, "<u4").tobytes())
        yield from batch(number, len(found), sha256=pa.array([k for k, _ in found], pa.binary()), n_bytes=pa.array([n for _, n in found], pa.int64()))
        fields = pa.Table.from_batches([p.select(["doc_id", "n_code_points"]) for p in parts]).combine_chunks().to_batches()[0]
        yield from batch(
            number, len(whole), doc_id=fields.column("doc_id"), n_code_points=fields.column("n_code_points"),
            text_sha256=pa.array(whole, pa.string()), chunks=pa.array(chunks, pa.binary()),
        )

    def run(batches):
        number, parts, total, count = TaskContext.get().partitionId() << 33, [], 0, 0
        for b in batches:
            start = 0
            for i, body in enumerate(b.column("body")):
                total, count = total + len(body.as_buffer()), count + 1
                if total >= BLOCK_BYTES or count >= BLOCK_ROWS:
                    yield from block(number, [*parts, b.slice(start, i + 1 - start)])
                    number, parts, total, count, start = number + 1, [], 0, 0, i + 1
            if start < b.num_rows:
                parts.append(b.slice(start))
        if parts:
            yield from block(number, parts)

    return rows.mapInArrow(run, (
        f"block long, place int, sha256 binary, n_bytes long, doc_id {type_of(rows, 'doc_id')}, n_code_points long, text_sha256 string, chunks binary"
    ))


def chunk_table(blocks: DataFrame) -> DataFrame:
    """``sha256, n_bytes, chunk, n_blocks`` of every distinct chunk of ``block_rows()``: its identifier, and how many blocks have it.

    Written, so that an identifier stays what it is when an executor is lost.
    """
    distinct = blocks.where("sha256 is not null").groupBy("sha256", "n_bytes").agg(F.count(F.lit(1)).alias("n_blocks"))
    return written(distinct.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def recipes(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """``block, list, doc_id, n_code_points, text_sha256, recipe``: the rows of ``block_rows()``.

    ``list`` numbers the different recipes of a block, whose first row has it
    in ``recipe``, the identifiers of its chunks in order; the others have
    null.  A block, whose size is bounded, is a group.
    """
    members = blocks.where("sha256 is null").select("block", "place", "doc_id", "n_code_points", "text_sha256", "chunks")
    named = blocks.where("sha256 is not null").select(F.col("block").alias("of"), F.col("place").alias("at"), "sha256", "n_bytes")
    answers = named.join(exchanged(chunks.select("sha256", "n_bytes", "chunk")), ["sha256", "n_bytes"]).select("of", "at", "chunk")

    def resolve(members: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = np.zeros(answers.num_rows, np.int64)
        chunk[answers.column("at").to_numpy()] = answers.column("chunk").to_numpy()
        # The block's places name its chunks, so equal places are equal identifiers there.
        lists: dict[bytes, int] = {}
        numbers, first = [], []
        for places in members.column("chunks").to_pylist():
            known = places in lists
            numbers.append(lists.setdefault(places, len(lists)))
            first.append(None if known else chunk[np.frombuffer(places, "<u4")])
        kept = [members.column(c) for c in ("doc_id", "n_code_points", "text_sha256")]
        return pa.table([members.column("block"), pa.array(numbers, pa.int32()), *kept, pa.array(first, pa.list_(pa.int64()))],
                        names=["block", "list", "doc_id", "n_code_points", "text_sha256", "recipe"])

    fields = f"block long, list int, doc_id {type_of(blocks, 'doc_id')}, n_code_points long, text_sha256 string, recipe array<long>"
    return members.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(resolve, fields)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without white space.  Of equal
    texts the row with the most code points stays, then the smallest doc_id; a
    null doc_id comes last.  Of rows that agree in all this one stays.  Null
    and empty texts form one group.  Texts of any length are read whole; other
    columns, whatever their names, stay out.  Empty input: no rows.
    """
    blocks = written(block_rows(docs, id_col, text_col), "chunk_blocks")
    found = recipes(blocks, chunk_table(blocks))
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "recipes")
    best = F.min(F.struct(-F.col("n_code_points"), F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))).alias("best")
    # Copies within a block are one row before recipes are compared, and the answer goes back the same way.
    lists = written(found.groupBy("block", "list").agg(best, F.count(F.lit(1)).alias("n"), F.first("recipe", ignorenulls=True).alias("recipe")), "lists")
    groups = lists.groupBy("recipe").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    back = lists.select("block", "list", "recipe").join(exchanged(groups), "recipe").select("block", "list", "best", "group_size")
    return found.drop("recipe").join(exchanged(back), ["block", "list"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"
    )
