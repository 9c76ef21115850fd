"""Pairs of removed and added lines in runs that are not k removals beside k additions.

``rename.align_runs`` pairs lines by their places, which needs as many
additions as removals, one kind after the other or in turns.  In any other run
(``-+-++``, or a line that was split) places say nothing: here the removed and
the added lines are aligned in order so that the words they share are most.
A run is the unit of work; the windows and the aggregate over runs reuse the
one exchange by patch.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pairing import best_pairs
from . import rename as R

#: Thousandths of their words that two lines share at least to pair.
LEAST = 500


def _aligned(least: int):
    @F.arrow_udf("array<struct<i:int,j:int,likeness:int>>")
    def align(olds: pa.Array, news: pa.Array) -> pa.Array:
        found = [best_pairs(a, b, least) for a, b in zip(olds.to_pylist(), news.to_pylist())]
        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("likeness", pa.int32())]))
        return pa.array([[{"i": i, "j": j, "likeness": s} for i, j, s in row] for row in found], kind)

    return align


def run_sides(patches: DataFrame) -> DataFrame:
    """``repo, patch_id, run_start, removed, added, plain``: the lines of every run as ``(pos, line)``, ascending.

    ``plain``: place pairs the lines, in a block of k and k or as removal and addition in turns.
    """
    changed = R.changed_lines_of(patches.select(*R.KEY, T.normalise_newlines("text").alias("text")))
    line = F.struct("pos", F.expr("substring(line, 2)").alias("line"))
    side = lambda sign: F.array_sort(F.collect_list(F.when(F.col("sign") == sign, line)))
    runs = R.change_runs(changed).groupBy(*R.KEY, "run_start").agg(
        side("-").alias("removed"), side("+").alias("added"), F.max("last_removed").alias("_last"), F.min("first_added").alias("_first")
    )
    turns = F.forall(F.zip_with("removed", "added", lambda a, b: b["pos"] == a["pos"] + 1), lambda x: x)
    plain = (F.size("removed") == F.size("added")) & ((F.col("_last") < F.col("_first")) | turns)
    return runs.select(*R.KEY, "run_start", "removed", "added", F.coalesce(plain, F.lit(False)).alias("plain"))


def pair_similar(patches: DataFrame, least: int = LEAST) -> DataFrame:
    """``repo, patch_id, run_start, n_removed, n_added, plain, pairs`` of every run of changed lines.

    ``pairs`` holds ``(old_pos, new_pos, old_line, new_line, likeness)`` in
    order.  A plain run pairs its j-th removal with its j-th addition
    (``likeness`` null).  Any other is aligned so that the sum of likeness
    (thousandths of words that are shared, ``least`` or more for a pair) is
    the greatest; lines without a partner stay alone.  Lines without a word
    are like none.  A patch without changed lines has no rows; a null text
    neither.
    """
    words = lambda side: F.transform(F.transform(side, lambda x: x["line"]), lambda l: F.filter(T.word_tokens(l), lambda w: ~w.rlike(r"^\s$")))
    none = F.array().cast("array<array<string>>")
    mixed = ~F.col("plain")
    sides = run_sides(patches).withColumns({"_old": F.when(mixed, words("removed")).otherwise(none), "_new": F.when(mixed, words("added")).otherwise(none)})
    aligned = sides.withColumn("_pairs", _aligned(least)("_old", "_new"))

    def pair(old, new, likeness):
        return F.struct(
            old["pos"].alias("old_pos"), new["pos"].alias("new_pos"), old["line"].alias("old_line"), new["line"].alias("new_line"), likeness.alias("likeness")
        )

    by_place = F.zip_with("removed", "added", lambda a, b: pair(a, b, F.lit(None).cast("int")))
    by_words = F.transform("_pairs", lambda p: pair(F.get("removed", p["i"]), F.get("added", p["j"]), p["likeness"]))
    return aligned.select(
        *R.KEY, "run_start", F.size("removed").alias("n_removed"), F.size("added").alias("n_added"), "plain",
        F.when(F.col("plain"), by_place).otherwise(by_words).alias("pairs"),
    )
