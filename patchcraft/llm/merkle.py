"""Merkle manifest of a dataset by time-forward processing.

Each row is a leaf.  The leaves of a language, in the order of their ids, make
a binary tree; the roots of these trees, in the order of the languages, make
the tree of the dataset.

A tree is cut into blocks of 2**levels neighbours, each the leaves of one
subtree; the subtrees' roots are the leaves of the next round.  Inside a block
nodes are taken in the order of their labels from a priority queue, and each
sends its digest to its parent through the queue.  A label is (place of the
last leaf below the node, level), so a parent comes right after its last child
and the queue never holds more than a node for each level.  Between blocks the
messages are rows of Spark, sorted and spilled by its exchanges, keyed by the
parent's place: the external part of the queue.  The sweep back takes the nodes
in the reverse order: each sends its own proof to its children, with the other
child's digest put in front.  No task holds more than one block of a tree and
the driver gets one number, the size of the largest tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import type_of, written
from .ranks import numbered

#: Levels of a block unless given; a block has up to 2**LEVELS leaves.
LEVELS = 10


def node_digest(*children: str) -> str:
    """H of the concatenated hex digests."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    return (n - 1).bit_length() if n > 1 else 0


def _label(level: int, i: int, leaves: int) -> tuple[int, int]:
    return min((i + 1) << level, leaves) - 1, level


def sweep_up(leaves: list[str], levels: int) -> list[list[str]]:
    """The digests of each level, leaves first; exactly ``levels`` levels stand above them.

    The queue delivers each node's digest to its parent; a parent with one
    child is the digest of that child alone.
    """
    made: list[list[str]] = [[] for _ in range(levels + 1)]
    queue: list[tuple[tuple[int, int], int, str]] = []

    def send(level: int, i: int, digest: str) -> None:
        made[level].append(digest)
        if level < levels:
            heappush(queue, (_label(level + 1, i >> 1, len(leaves)), i, digest))

    for place, leaf in enumerate(leaves):
        send(0, place, leaf)
        while queue and queue[0][0][0] == place:
            label, i, digest = heappop(queue)
            children = [digest]
            while queue and queue[0][0] == label:
                children.append(heappop(queue)[2])
            send(label[1], i >> 1, node_digest(*children))
    return made


def sweep_down(made: list[list[str]], path: str) -> Iterator[tuple[int, str]]:
    """(place, path) of each leaf, last leaf first; ``path`` leads on from the block's root.

    A path has a step for each level: ``<`` or ``>`` with the sibling to the
    left or right, ``-`` where the node is alone.
    """
    leaves, top = len(made[0]), len(made) - 1
    queue = [((-(leaves - 1), -top), 0, path)]
    while queue:
        (_, level), i, path = heappop(queue)
        level = -level
        if not level:
            yield i, path
            continue
        below = made[level - 1]
        for child in (2 * i, 2 * i + 1):
            if child < len(below):
                other = child ^ 1
                step = "-" if other >= len(below) else ("<" if other < child else ">") + below[other]
                end, at = _label(level - 1, child, leaves)
                heappush(queue, ((-end, -at), child, step + path))


def steps(path: str) -> Iterator[tuple[str, str]]:
    """(side, sibling's digest) of each level of a path; an alone node's digest is empty."""
    at = 0
    while at < len(path):
        size = 0 if path[at] == "-" else 64
        yield path[at], path[at + 1 : at + 1 + size]
        at += 1 + size


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its path lead to."""
    for side, other in steps(path):
        leaf = node_digest(other, leaf) if side == "<" else node_digest(leaf, other)
    return leaf


def proof(path: str) -> list[str]:
    """The siblings of a path, from the leaf up."""
    return [other for _, other in steps(path) if other]


def _climb(block: pa.Table, levels: int) -> pa.Table:
    block = block.sort_by("pos")
    tree, pos, n = (block[c][0].as_py() for c in ("tree", "pos", "n"))
    top = sweep_up(block["digest"].to_pylist(), min(height(n), levels))[-1][0]
    return pa.table({"tree": [tree], "pos": [pos >> levels], "n": [-(-n >> levels)], "digest": [top]})


def _spread(block: pa.Table, levels: int) -> pa.Table:
    """The rows of a block with their paths: ``path`` comes in as the block root's and goes out as the row's."""
    block = block.sort_by("pos")
    made = sweep_up(block["digest"].to_pylist(), min(height(block["n"][0].as_py()), levels))
    paths = [""] * len(block)
    for i, path in sweep_down(made, block["path"][0].as_py()):
        paths[i] = path
    return block.set_column(block.column_names.index("path"), "path", pa.array(paths, pa.string()))


def _proved(block: pa.Table, levels: int) -> pa.Table:
    block = _spread(block, levels)
    paths, leaves = block["path"].to_pylist(), block["digest"].to_pylist()
    shown = block["shown"].to_pylist()
    folded = [fold(leaf if other is None else other, path) for leaf, other, path in zip(leaves, shown, paths, strict=True)]
    proofs = [proof(p) for p in paths]
    return pa.table(
        {
            "doc_id": block["doc_id"], "leaf": block["digest"], "subroot": block["subroot"], "root": block["root"],
            "proof": pa.array(proofs, pa.list_(pa.string())), "proof_sha256": [node_digest(*p) for p in proofs],
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([a == b for a, b in zip(folded, block["root"].to_pylist(), strict=True)], pa.bool_()),
        }
    )


def _by_block(nodes: DataFrame, levels: int, fn: Callable[[pa.Table, int], pa.Table], schema: str, paths: DataFrame | None = None) -> DataFrame:
    """``fn`` of each block, with the path and all else that the block's root has in ``paths(tree, pos, path, ...)``."""
    blocked = nodes.withColumn("block", F.shiftright("pos", levels))
    if paths is not None:
        blocked = blocked.join(paths.withColumnRenamed("pos", "block"), ["tree", "block"])
    return blocked.groupBy("tree", "block").applyInArrow(lambda block: fn(block, levels), schema)


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes(tree, pos, n, digest)`` and the nodes of each round above them; the last has one node a tree."""
    found, largest = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        up = _by_block(found[-1].select("tree", "pos", "n", "digest"), levels, _climb, "tree string, pos long, n long, digest string")
        found.append(written(up, "merkle_up"))
        largest = -(-largest >> levels)
    return found


def _down(rounds: list[DataFrame], levels: int, paths: DataFrame, carry: list[str]) -> DataFrame:
    """The paths of the nodes of the round above the first, from those of the last."""
    kept = ["tree", "pos", "path", *carry]
    for nodes in rounds[-2:0:-1]:
        placed = _by_block(nodes, levels, lambda block, k: _spread(block, k).select(kept), f"tree string, pos long, {', '.join(f'{c} string' for c in kept[2:])}", paths)
        paths = written(placed, "merkle_down")
    return paths


def _counted(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields: ``-`` for a null, else the value's UTF-8 byte count, a colon and the value."""
    return F.sha2(F.concat(*[_counted(c) for c in fields]).cast("binary"), 256)


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    tree_col: str = "lang",
    shown: Column | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """One row a document: ``doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified``.

    ``fields`` make the leaf; ``shown`` is the digest that a holder of the row
    shows instead of its leaf (null: the leaf).  ``proof`` lists the siblings
    from the leaf to the dataset's root; folding the shown digest with them
    gives ``folded_root``, which ``verified`` compares with ``root``.

    Nulls count as ``-`` in a leaf.  Rows without a language are a tree of
    their own, before all others; rows without an id come first in their tree.
    Rows with the same id are ordered by leaf; equal rows are equal leaves and
    get a place each.  Empty texts are values of length 0, long texts are
    hashed where they are read and never move.  Other columns play no part,
    whatever their names.  An empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("-"))
    leaves = docs.select(
        F.col(id_col).alias("doc_id"), tree.alias("tree"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
        (F.lit(None).cast("string") if shown is None else shown).alias("shown"), F.monotonically_increasing_id().alias("row"),
    )
    placed = written(numbered(written(leaves, "merkle_leaves"), ["tree"], ["doc_id", "digest", "row"]).drop("row"), "merkle_placed")
    rounds = _rounds(placed, levels)

    subroots = rounds[-1].select(F.col("tree").alias("name"), F.col("digest"), F.lit("").alias("tree"))
    tops = written(numbered(subroots, ["tree"], ["name"]), "merkle_subroots")
    above = _rounds(tops, levels)
    paths = above[-1].select("tree", "pos", F.lit("").alias("path"), F.col("digest").alias("root"))
    if len(above) > 1:
        paths = _down(above, levels, paths, ["root"])
        named = _by_block(tops, levels, lambda block, k: _spread(block, k).select(["name", "path", "digest", "root"]), "name string, path string, digest string, root string", paths)
    else:
        named = tops.select("name", F.lit("").alias("path"), "digest", F.col("digest").alias("root"))
    paths = written(named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"), "merkle_paths")

    paths = _down(rounds, levels, paths, ["subroot", "root"])
    proved = f"doc_id {type_of(docs, id_col)}, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"
    return _by_block(placed, levels, _proved, proved, paths)


def one_more(docs_fields: tuple[str, ...], count_col: str, where: Column) -> Column:
    """The digest of a row whose ``count_col`` is one higher, where ``where`` holds and the count is not null; else null."""
    more = (F.col(count_col).cast("decimal(20,0)") + 1).cast("string")
    changed = leaf_digest([more if f == count_col else F.col(f) for f in docs_fields])
    return F.when(where & F.col(count_col).isNotNull(), changed)
