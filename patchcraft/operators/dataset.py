"""Examples: load, tokenise, reproducible ranks, hold-out, balance and split.

Random order is a seeded md5 of the example key, so every split is
reproducible across runs, engines and executor loss (a recomputed partition
gets the same ranks).  Exact global ranks never use a single-partition
window: rows are bucketed by a prefix of their hash, bucket sizes (a table
of at most 16**digits rows) give offsets, and ranks are computed inside
buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


# ------------------------------------------------------------------ loading
def load_examples(
    examples: DataFrame,
    max_file_kb: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """``path, label, n_bytes, tokens, n_tokens`` from ``path, label, text, n_bytes``.

    Content must begin with ``@@``: ``strict`` raises, otherwise such rows are
    left out.  No size limit unless ``max_file_kb`` (inclusive) is given;
    ``load_report`` counts what either rule leaves out.
    """
    df = examples if max_file_kb is None else examples.where(F.col("n_bytes") <= max_file_kb * 1024)
    starts = F.col("text").startswith(fixed.HUNK_PREFIX)
    if strict:
        df = df.withColumn(
            "text",
            F.when(starts, F.col("text")).otherwise(
                F.raise_error(F.concat(F.lit("patch must start with @@: "), F.col("path")))
            ),
        )
    else:
        df = df.where(starts)
    tokens = T.tokenise(T.standardise_numbers("text"))
    return df.select("path", "label", "n_bytes", tokens.alias("tokens")).withColumn(
        "n_tokens", F.size("tokens").cast("long")
    )


def load_report(examples: DataFrame, max_file_kb: int | None = None) -> DataFrame:
    """One row: ``n_loaded, n_too_large, n_bad_start`` of what ``load_examples`` does with the same limit."""
    large = F.lit(False) if max_file_kb is None else F.col("n_bytes") > max_file_kb * 1024
    starts = F.col("text").startswith(fixed.HUNK_PREFIX)
    return examples.agg(
        F.count_if(~large & starts).cast("long").alias("n_loaded"),
        F.count_if(large).cast("long").alias("n_too_large"),
        F.count_if(~large & ~starts).cast("long").alias("n_bad_start"),
    )


def join_tokens(tokens: Column | str) -> Column:
    return F.array_join(tokens if isinstance(tokens, Column) else F.col(tokens), " ")


def split_tokens(joined: Column | str) -> Column:
    return F.split(joined if isinstance(joined, Column) else F.col(joined), " ", -1)


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: ``n_yes, n_no, n_total``."""
    return df.agg(
        F.count_if(F.col(label) == 1).cast("long").alias("n_yes"),
        F.count_if(F.col(label) == 0).cast("long").alias("n_no"),
        F.count(F.lit(1)).cast("long").alias("n_total"),
    )


def max_sequence_length(df: DataFrame) -> DataFrame:
    return df.agg(F.max(F.size("tokens")).cast("long").alias("max_sequence_length"))


def cache_dataset(df: DataFrame) -> DataFrame:
    """Materialise now (persist + count).  Ranks are deterministic, so a lost
    cached block is recomputed to the same rows."""
    df = df.persist()
    df.count()
    return df


# ------------------------------------------------------------------ ranks
def seeded_rank(
    df: DataFrame,
    key: str,
    seed: int | str = fixed.DEFAULT_SEED,
    by: list[str] | None = None,
    rank_col: str = "rank",
    digits: int = 3,
    bounded_groups: bool | None = None,
) -> DataFrame:
    """Exact 1-based rank by ``(md5(seed:key), key)``, optionally within groups ``by``.

    The hash prefix of ``digits`` hex digits buckets rows; a group that holds
    a third of all rows is spread over 16**digits buckets.  Offsets come from
    the bucket-size table (bounded by groups x 16**digits rows), which is
    broadcast only when the number of groups is known to be small
    (``bounded_groups``; true without ``by``).
    """
    by = by or []
    h = T.seeded_hash(seed, key)
    df = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits))
    sizes = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0))).drop("_n")
    w_in = Window.partitionBy(*by, "_b").orderBy("_h", key)
    if bounded_groups if bounded_groups is not None else not by:
        offsets = F.broadcast(offsets)
    ranked = df.join(offsets, [*by, "_b"]).withColumn(
        rank_col, (F.col("_off") + F.row_number().over(w_in)).cast("long")
    )
    return ranked.drop("_h", "_b", "_off")


def holdout_take_skip(ranked: DataFrame, n_total: int, divisor: int = fixed.HOLDOUT_DIVISOR,
                      rank_col: str = "rank") -> tuple[DataFrame, DataFrame]:
    """First ``n // divisor`` ranked rows are the hold-out, the rest continue."""
    cut = n_total // divisor
    return ranked.where(F.col(rank_col) <= cut), ranked.where(F.col(rank_col) > cut)


def train_test_split(ranked: DataFrame, n_total: int, rank_col: str = "rank") -> tuple[DataFrame, DataFrame]:
    """First ``int(n / 5 * 4)`` ranked rows train, the rest test."""
    num, den = fixed.TRAIN_FRACTION
    cut = int(n_total / den * num)
    return ranked.where(F.col(rank_col) <= cut), ranked.where(F.col(rank_col) > cut)


def balance_classes(df: DataFrame, key: str = "path", label: str = "label",
                    seed: int | str = fixed.DEFAULT_SEED) -> DataFrame:
    """If one class exceeds the other by more than 10 %, keep the ``min`` first
    rows of each class in seeded order; otherwise keep everything."""
    counts = class_counts(df, label).first()
    n_yes, n_no = counts["n_yes"], counts["n_no"]
    if n_yes > n_no * fixed.BALANCE_TOLERANCE or n_no > n_yes * fixed.BALANCE_TOLERANCE:
        keep = min(n_yes, n_no)
        ranked = seeded_rank(df, key, f"{seed}:balance", by=[label], rank_col="_lrank",
                             bounded_groups=True)
        return ranked.where(F.col("_lrank") <= keep).drop("_lrank")
    return df


def first_by_hash(df: DataFrame, n: int, key: str, seed: int | str, digits: int = 3) -> Column:
    """True for the first ``n`` rows of ``df`` in the order of ``(md5(seed:key), key)``, as a row-local test.

    A histogram over the hash prefix (16**digits rows at most reach the
    driver) names the bucket in which the n-th row lies; only that bucket is
    ranked, to find the row itself.  Nothing else is sorted or exchanged.
    """
    h = T.seeded_hash(seed, key)
    if n <= 0:
        return F.lit(False)
    bucket = F.substring(h, 1, digits)
    left = n
    for b, size in sorted((r["b"], r["n"]) for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()):
        if left <= size:
            break
        left -= size
    else:
        return F.lit(True)
    ranked = df.where(bucket == b).select(h.alias("h"), F.col(key).alias("k")).withColumn(
        "r", F.row_number().over(Window.orderBy("h", "k"))
    )
    last = ranked.where(F.col("r") == left).first()
    return (h < last["h"]) | ((h == last["h"]) & (F.col(key) <= F.lit(last["k"])))


def split_dataset(examples: DataFrame, key: str = "path", seed: int | str = fixed.DEFAULT_SEED,
                  balance: bool = True, label: str = "label") -> DataFrame:
    """``examples`` with ``split``: validation, train, test or unused.

    Validation is the first tenth of the seeded order (taken before
    balancing); the rest is balanced, re-ordered with a second seed, and
    split 80 / 20.  Rows that balancing leaves out stay, as ``unused``;
    ``balance=False`` keeps them all.  Every row is placed by comparing its own
    hash with a few cuts, so no row is sorted or exchanged and the tokens are
    never cached; ``key`` and ``label`` alone are, while the cuts are found.
    """
    keys = examples.select(key, label).persist()
    try:
        is_validation = first_by_hash(keys, keys.count() // fixed.HOLDOUT_DIVISOR, key, seed)
        rest = keys.where(~is_validation)
        kept = F.lit(True)
        counts = class_counts(rest, label).first()
        n_yes, n_no = counts["n_yes"], counts["n_no"]
        if balance and (n_yes > n_no * fixed.BALANCE_TOLERANCE or n_no > n_yes * fixed.BALANCE_TOLERANCE):
            least, kept = min(n_yes, n_no), F.lit(False)
            for value in (0, 1):
                cut = first_by_hash(rest.where(F.col(label) == value), least, key, f"{seed}:balance")
                kept = kept | ((F.col(label) == value) & cut)
        used = rest.where(kept)
        num, den = fixed.TRAIN_FRACTION
        is_train = first_by_hash(used, int(used.count() / den * num), key, f"{seed}:order")
    finally:
        keys.unpersist()
    return examples.withColumn(
        "split",
        F.when(is_validation, "validation").when(~kept, "unused").when(is_train, "train").otherwise("test"),
    )


def split_fingerprint(splits: DataFrame, key: str = "path") -> DataFrame:
    """Order-free fingerprint of a split assignment: one row ``n_rows, fingerprint`` (a decimal number as text)."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key), F.col("split"))), 1, 12), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").cast("string")
    return splits.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("fingerprint"))


def stability_check(make_splits) -> DataFrame:
    """Evaluate the split twice, from the start, and compare order-free fingerprints.

    One row: ``n_rows, fingerprint, stable``.  ``split_dataset`` leaves nothing
    cached, so the second evaluation is not answered from the first.
    """
    a = split_fingerprint(make_splits()).withColumn("run", F.lit(1))
    b = split_fingerprint(make_splits()).withColumn("run", F.lit(2))
    return a.unionByName(b).agg(
        F.max("n_rows").alias("n_rows"),
        F.min("fingerprint").alias("fingerprint"),
        ((F.count_distinct("fingerprint") == 1) & (F.count_distinct("n_rows") == 1)).alias("stable"),
    )
