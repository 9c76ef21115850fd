"""Line-level differences between two versions of a text, and edit generation.

``changed_lines`` is a multiset difference.  Lines that both versions begin or
end with cancel in their row, before any exchange: what is shuffled grows
with the edits, not with the texts.  Of the lines between, each side is
aggregated to ``(pair, line) -> count`` before the shuffle, and one full outer
join on the same key (reusing both partitionings) yields the surplus on either
side.  Moved lines are therefore not reported (a longest-common-subsequence diff
would report them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def _made(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that come out of a one-row generator, so that no later one computes them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _alike(a: Column, b: Column) -> Column:
    """How many elements both arrays begin with."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")


def _line_counts(sides: DataFrame, key: str, lines: Column, name: str) -> DataFrame:
    middle = F.slice(lines, F.col("_head") + 1, F.size(lines) - F.col("_head") - F.col("_tail"))
    return sides.select(key, F.explode(middle).alias("line")).groupBy(key, "line").agg(F.count(F.lit(1)).alias(name))


def changed_lines(versions: DataFrame, key: str = "pair_id", old: str = "old", new: str = "new") -> DataFrame:
    """``key, sign, line, n``: ``-`` lines only in the old version, ``+`` only in the new, with multiplicity.

    Rows of one key count together.  Rows without a key have no other version:
    all their lines are reported.
    """
    none = F.array().cast("array<string>")
    sides = _made(
        versions.select(key, F.col(old).alias("_old"), F.col(new).alias("_new")),
        _a=F.coalesce(F.split("_old", "\n", -1), none), _b=F.coalesce(F.split("_new", "\n", -1), none),
    ).select(key, "_a", "_b")
    a, b, keyed = F.col("_a"), F.col("_b"), F.col(key).isNotNull()
    sides = _made(sides, _head=F.when(keyed, _alike(a, b)).otherwise(0))
    left = F.least(F.size(a), F.size(b)) - F.col("_head")
    sides = _made(sides, _tail=F.when(keyed, F.least(_alike(F.reverse(a), F.reverse(b)), left)).otherwise(0))

    a, b = _line_counts(sides, key, a, "n_old"), _line_counts(sides, key, b, "n_new")
    d = a.join(b, [key, "line"], "full_outer").select(
        key, "line", (F.coalesce("n_new", F.lit(0)) - F.coalesce("n_old", F.lit(0))).alias("d")
    )
    return d.where(F.col("d") != 0).select(
        key,
        F.when(F.col("d") > 0, "+").otherwise("-").alias("sign"),
        "line",
        F.abs("d").cast("long").alias("n"),
    )


def synthetic_edits(
    originals: DataFrame, key: str, text: str, variants: int = 20, seed: int | str = fixed.DEFAULT_SEED
) -> DataFrame:
    """Variants of each original with one line deleted, added or replaced.

    ``choice`` and the line position come from seeded md5 draws; a new line
    is 20 printable characters (hex of an md5).  Output: ``key, variant,
    choice, old, new``, ready for ``changed_lines``.
    """
    # Split once a document, not once a variant and branch.
    split = _made(originals.select(key, text), _lines=F.split(F.col(text), "\n", -1))
    v = split.select(key, text, "_lines", F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("variant"))
    lines = F.col("_lines")

    def draw(tag: str):
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("variant").cast("string"), F.lit(tag)))
        return F.conv(F.substring(h, 1, 12), 16, 10).cast("long")

    choice = F.element_at(F.array(F.lit("delete"), F.lit("add"), F.lit("both")), (draw("choice") % 3 + 1).cast("int"))
    n = F.size(lines)
    pos = (draw("line") % n + 1).cast("int")  # 1-based
    new_line = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("variant").cast("string"), F.lit("text"))), 1, 20)
    before = F.slice(lines, 1, pos - 1)
    after_incl = F.slice(lines, pos, n - pos + 1)
    after_excl = F.slice(lines, pos + 1, F.greatest(n - pos, F.lit(0)))
    edited = (
        F.when(F.col("choice") == "delete", F.concat(before, after_excl))
        .when(F.col("choice") == "add", F.concat(before, F.array(new_line), after_incl))
        .otherwise(F.concat(before, F.array(new_line), after_excl))
    )
    return v.withColumn("choice", choice).select(
        key, "variant", "choice", F.col(text).alias("old"), F.array_join(edited, "\n").alias("new")
    )
