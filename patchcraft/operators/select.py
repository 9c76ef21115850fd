"""Choosing labelled examples from verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

KEY = ["repo", "patch_id"]


def verdict_lines(verdicts: DataFrame) -> DataFrame:
    """Text export rows ``id||verdict[|old->new, …]`` per repository (second field unused)."""
    line = F.concat(
        F.col("patch_id"), F.lit("||"), F.col("verdict"),
        F.when(F.col("message").isNotNull(), F.concat(F.lit("|"), F.col("message"))).otherwise(F.lit("")),
    )
    return verdicts.where(F.col("verdict").isNotNull()).select("repo", "patch_id", line.alias("line"))


def parse_verdict_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``patch_id, verdict, message`` from exported rows (at most four ``|`` fields)."""
    parts = F.split(F.col(value), r"\|", 4)
    return lines.select(
        *[c for c in lines.columns if c != value],
        F.element_at(parts, 1).alias("patch_id"),
        F.element_at(parts, 3).alias("verdict"),
        F.try_element_at(parts, F.lit(4)).alias("message"),
    )


def select_by_verdict(patches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Patches with verdict ``y`` (label 1) or ``n`` (label 0); ``skip`` is in neither."""
    v = verdicts.where(F.col("verdict").isin("y", "n")).select(
        *KEY, F.when(F.col("verdict") == "y", 1).otherwise(0).alias("label")
    )
    return patches.join(v, KEY)


def presumed_negatives(
    patches: DataFrame,
    verdicts: DataFrame,
    max_bytes: int | None = None,
    n: int | None = None,
    exclude: tuple[str, ...] = ("y",),
    buckets: int = 1024,
) -> DataFrame:
    """Patches whose verdict is not in ``exclude``: presumed negatives (label 0).

    ``max_bytes`` keeps small patches only and ``n`` the first n by id of each
    repository; neither limits anything unless given.  The exact top-n ranks
    keys, never texts, in two steps, so a repository holding a third of all
    patches is not ranked in one task: inside each ``(repo, hash bucket)``,
    then among those candidates (at most ``n x buckets`` keys a repository).
    """
    excluded = verdicts.where(F.col("verdict").isin(*exclude)).select(*KEY)
    small = patches if max_bytes is None else patches.where(F.col("n_bytes") <= max_bytes)
    found = small.join(excluded, KEY, "left_anti")
    if n is not None:
        keys = found.select(*KEY, F.pmod(F.hash("patch_id"), F.lit(buckets)).alias("_bucket"))
        w1 = Window.partitionBy("repo", "_bucket").orderBy("patch_id")
        keys = keys.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n).select(*KEY)
        w2 = Window.partitionBy("repo").orderBy("patch_id")
        keys = keys.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= n).select(*KEY)
        found = found.join(keys, KEY, "left_semi")
    return found.withColumn("label", F.lit(0))


def select_examples(patches: DataFrame, verdicts: DataFrame, **kw) -> DataFrame:
    """Verdict-selected examples united with presumed negatives (``origin`` tells which).

    A patch with a ``y`` or ``n`` verdict is never presumed as well, so no
    patch comes out twice.
    """
    a = select_by_verdict(patches, verdicts).withColumn("origin", F.lit("verdict"))
    b = presumed_negatives(patches, verdicts, **{"exclude": ("y", "n")} | kw).withColumn("origin", F.lit("presumed"))
    return a.unionByName(b)
