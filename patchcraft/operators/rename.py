"""Rename detection: which patches only rename identifiers.

Plan shape (one shuffle):

1. Row-local cheap rejects on the whole text (balanced ``-``/``+`` counts, no
   package line); rejected patches and patches with no changed line are
   not split into lines (one dummy row each keeps them in the result).
2. ``posexplode`` of the surviving patches, keeping changed lines only.
3. Windows keyed by ``(repo, patch_id)`` (runs, alignment, pairing) and the
   final per-patch aggregate all reuse the single hash exchange on that key.

A single patch is the unit of work, so a repository holding a third of all
patches spreads over every task; only one enormous patch would stay in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T

KEY = ["repo", "patch_id"]


def with_cheap_checks(patches: DataFrame) -> DataFrame:
    """Adds ``n_removed``, ``n_added``, ``has_package`` and ``reject_reason`` (row-local).

    The text with its line ends made alike comes out of a one-row generator:
    the checks and the filter on them read it, none makes it again.
    """
    others = [c for c in patches.columns if c != "text"]
    return (
        patches.select(*others, F.inline(F.array(F.struct(T.normalise_newlines("text").alias("text")))))
        .withColumn("n_removed", T.count_lines_with_sign("text", "-"))
        .withColumn("n_added", T.count_lines_with_sign("text", "+"))
        .withColumn("has_package", T.has_package_line("text"))
        .withColumn(
            "reject_reason",
            F.when(F.col("n_removed") != F.col("n_added"), F.lit("unbalanced"))
            .when(F.col("has_package"), F.lit("package")),
        )
    )


def changed_lines_of(patches: DataFrame) -> DataFrame:
    """``posexplode`` into ``(repo, patch_id, pos, sign, line)`` keeping ``-``/``+`` lines."""
    return (
        patches.select(*KEY, F.posexplode(T.split_lines("text")).alias("pos", "line"))
        .withColumn("sign", T.line_sign("line"))
        .where(F.col("sign").isin("-", "+"))
    )


def change_runs(changed: DataFrame) -> DataFrame:
    """Maximal runs of adjacent changed lines (gaps and islands).

    Adds ``run`` (run id), ``run_start``, ``run_removed``, ``run_added``,
    ``last_removed`` and ``first_added`` (positions).
    """
    w_patch = Window.partitionBy(*KEY).orderBy("pos")
    runs = changed.withColumn("run", F.col("pos") - F.row_number().over(w_patch))
    w_run = Window.partitionBy(*KEY, "run")
    is_minus = F.col("sign") == "-"
    # One select, so the five run aggregates share a single Window operator.
    return runs.select(
        "*",
        F.min("pos").over(w_run).alias("run_start"),
        F.count_if(is_minus).over(w_run).alias("run_removed"),
        F.count_if(~is_minus).over(w_run).alias("run_added"),
        F.max(F.when(is_minus, F.col("pos"))).over(w_run).alias("last_removed"),
        F.min(F.when(~is_minus, F.col("pos"))).over(w_run).alias("first_added"),
    )


def align_runs(runs: DataFrame) -> DataFrame:
    """Order key ``akey``: a run of k removals then k additions (k > 1) is interleaved.

    The j-th removal is followed by the j-th addition; other lines keep their
    position.  End of input ends a run like any other line does.
    """
    k = F.col("run_removed")
    block = (k == F.col("run_added")) & (k > 1) & (F.col("last_removed") < F.col("first_added"))
    is_plus = (F.col("sign") == "+").cast("int")
    j = F.col("pos") - F.col("run_start") - is_plus * k
    return runs.withColumn(
        "akey", F.when(block, F.col("run_start") + 2 * j + is_plus).otherwise(F.col("pos"))
    )


def pair_lines(aligned: DataFrame) -> DataFrame:
    """Each ``+`` line meets the latest ``-`` line when no other ``+`` lies between.

    Adds ``is_pair``, ``old_line`` and ``new_line`` (without the sign).
    """
    w = Window.partitionBy(*KEY).orderBy("akey")
    return (
        aligned.select("*", F.lag("sign").over(w).alias("prev_sign"), F.lag("line").over(w).alias("prev_line"))
        .withColumn("is_pair", (F.col("sign") == "+") & (F.col("prev_sign") == "-"))
        .withColumn("old_line", F.when(F.col("is_pair"), F.expr("substring(prev_line, 2)")))
        .withColumn("new_line", F.when(F.col("is_pair"), F.expr("substring(line, 2)")))
    )


def compare_pairs(paired: DataFrame) -> DataFrame:
    """Word-level comparison of each pair.

    ``pair_ok``: same number of word tokens and every differing position holds
    two identifiers (first character a letter or ``_``) that are not keywords.
    ``diffs``: the differing positions as ``(akey, idx, old, new)``.
    """
    # Identical lines differ nowhere: they skip tokenising.
    differs = F.col("old_line") != F.col("new_line")
    words = [F.when(differs, T.word_tokens(c)).otherwise(F.array()).alias(w) for c, w in (("old_line", "old_w"), ("new_line", "new_w"))]
    paired = paired.select("*", F.inline(F.array(F.struct(*words))))
    old_w, new_w = F.col("old_w"), F.col("new_w")

    def difference(old: Column, i: Column) -> Column:
        """Null where the words are the same: a struct is made only of those that differ."""
        new = F.get(new_w, i)
        return F.when(old != new, F.struct(F.col("akey").alias("akey"), i.alias("idx"), old.alias("old"), new.alias("new")))

    diffs = F.filter(F.transform(old_w, difference), lambda z: z.isNotNull())

    def good(z):
        return (
            T.is_identifier(z["old"]) & T.is_identifier(z["new"])
            & ~T.is_keyword(z["old"]) & ~T.is_keyword(z["new"])
        )

    pair_ok = (F.size(old_w) == F.size(new_w)) & F.forall(F.col("diffs"), good)
    return (
        paired.withColumn("diffs", F.when(F.col("is_pair"), diffs))
        .withColumn("pair_ok", F.when(F.col("is_pair"), pair_ok))
        .drop("old_w", "new_w")
    )


def rename_map(patches: DataFrame, keep_rejected: bool = False) -> DataFrame:
    """Per patch: ``repo, patch_id, renames ARRAY<STRUCT<old,new>>, reject_reason``.

    ``renames`` is ordered by first occurrence.  A patch is rejected when it is
    unbalanced, declares a package, has a pair that differs in anything but
    identifiers, or maps one old name to two new names.  Rejected patches are
    dropped unless ``keep_rejected``; then ``renames`` is NULL.

    The input is read once: patches rejected by the row-local checks, and
    patches without a changed line, enter the exchange as one empty dummy
    line each instead of all their lines (and rejected ones are filtered out
    before it unless ``keep_rejected``).
    """
    checked = with_cheap_checks(patches.select(*KEY, "text"))
    if not keep_rejected:
        checked = checked.where(F.col("reject_reason").isNull())
    explode_all = F.col("reject_reason").isNull() & (F.col("n_removed") > 0)
    lines_or_dummy = F.when(explode_all, T.split_lines("text")).otherwise(F.array(F.lit("")))
    exploded = (
        checked.select(
            *KEY, F.col("reject_reason").alias("early_reason"), (~explode_all).alias("dummy"),
            F.posexplode(lines_or_dummy).alias("pos", "line"),
        )
        .withColumn("sign", T.line_sign("line"))
        .where(F.col("sign").isin("-", "+") | F.col("dummy"))
    )
    lines = compare_pairs(pair_lines(align_runs(change_runs(exploded))))
    per_patch = lines.groupBy(*KEY).agg(
        F.max("early_reason").alias("early_reason"),
        F.coalesce(F.bool_and("pair_ok"), F.lit(True)).alias("all_ok"),
        F.flatten(F.collect_list("diffs")).alias("diffs"),
    )
    ordered = F.array_sort(F.col("diffs"))
    renames = F.array_distinct(
        F.transform(ordered, lambda d: F.struct(d["old"].alias("old"), d["new"].alias("new")))
    )
    olds = F.array_distinct(F.transform(F.col("renames"), lambda r: r["old"]))
    labelled = (
        per_patch.withColumn("renames", renames)
        .withColumn(
            "reject_reason",
            F.when(F.col("early_reason").isNotNull(), F.col("early_reason"))
            .when(~F.col("all_ok"), F.lit("not a rename"))
            .when(F.size(olds) < F.size("renames"), F.lit("conflicting rename")),
        )
        .withColumn("renames", F.when(F.col("reject_reason").isNull(), F.col("renames")))
        .select(*KEY, "renames", "reject_reason")
    )
    if keep_rejected:
        return labelled
    return labelled.where(F.col("reject_reason").isNull())


def rename_verdicts(
    patches: DataFrame, max_renames: int = fixed.DEFAULT_MAX_RENAMES, keep_rejected: bool = False
) -> DataFrame:
    """``repo, patch_id, verdict, n_renames, renames, message``.

    0 renames -> ``n``; 1..max_renames -> ``y``; more -> ``skip``; rejected
    patches get no row (or a NULL verdict with ``keep_rejected``).
    """
    m = rename_map(patches, keep_rejected=keep_rejected)
    n = F.size("renames")
    return m.select(
        *KEY,
        F.when(F.col("renames").isNull(), F.lit(None))
        .when(n == 0, F.lit("n"))
        .when(n <= max_renames, F.lit("y"))
        .otherwise(F.lit("skip"))
        .alias("verdict"),
        F.when(F.col("renames").isNotNull(), n.cast("long")).alias("n_renames"),
        "renames",
        F.when(n > 0, T.rename_message("renames")).alias("message"),
        "reject_reason",
    )


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """How many ``y``/``skip``/``n`` (and rejected, if kept) per repository."""
    return verdicts.groupBy("repo", F.coalesce("verdict", F.lit("rejected")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("n_patches")
    )
