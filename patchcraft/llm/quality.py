"""Quality rules as a bitmask ledger (operator 1), with DataFrame functions only.

Every rule is evaluated once for each document: the ledger keeps the
measurements and one failure bit for each rule.  A policy is a versioned set
of rules, so applying one, changing one or asking what each rule alone is
responsible for (an ablation) reads the ledger and never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` (SQL over the measurements) is true.  Its place in RULES is its bit, so rules are only appended."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("capitals", "100 * n_capitals > 50 * word_chars"),
)

#: Versioned policies: the rules that a kept document has to pass.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": tuple(r.name for r in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def mask(policy: str) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def _row(df: DataFrame, **columns: Column) -> DataFrame:
    """The same rows with just these columns, each computed once: a one-row generator keeps Catalyst from substituting them into later uses."""
    one = F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))
    return df.select(F.inline(one))


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and MEASURES of every row, without a shuffle; the work on a text of n words is n log n."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = _row(docs, doc_id=F.col(id_col), text=text, words=F.array_remove(F.split(text, f"[{SPACE}]+"), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    at = F.when(F.size("words") > 2, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    counted = _row(
        words,
        doc_id=F.col("doc_id"),
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        n_symbols=F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"),
        n_capitals=F.regexp_count("text", F.lit("\\p{Lu}")).cast("long"),
        lines=lines,
        windows=F.transform(at, window),
    )
    # Places of the windows in the order of their hashes, for texts with equal windows only.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = _row(
        counted,
        **{c: F.col(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_capitals")},
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        placed=F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    same = F.filter("placed", lambda x, j: x["h"].eqNullSafe(F.get("placed", j - 1)["h"]) | x["h"].eqNullSafe(F.get("placed", j + 1)["h"]))
    starts = _row(sorted_, **{c: F.col(c) for c in sorted_.columns if c != "placed"}, starts=F.array_sort(F.transform(same, lambda x: x["i"])))
    # A window covers three words, fewer where the next one starts sooner.
    covered = F.aggregate(F.transform("starts", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("starts", j + 1) - p, F.lit(3)))), F.lit(0), lambda a, n: a + n)
    return starts.select("doc_id", *[covered.cast("long").alias(m) if m == "n_repeat_words" else F.col(m) for m in MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``doc_id``, MEASURES and ``failures``, a long with bit i set where RULES[i] fails.

    Null, empty and blank texts have no words and fail ``few_words`` alone.
    Repeated rows and null ids get a row each; empty input gives none.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measurements(docs, id_col, text_col).withColumn("failures", failures)


def passes(policy: str, failures: str = "failures") -> Column:
    """True where no rule of the policy fails."""
    return F.col(failures).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(entries: DataFrame, policy: str) -> DataFrame:
    """``rule, n_failed, n_only``: documents that fail each rule of a policy, and those that it alone keeps out.

    One pass of bitwise tests over the ledger; no text is read.  An empty
    ledger gives zeros.
    """
    all_bits = mask(policy)
    rules = [(i, r) for i, r in enumerate(RULES) if all_bits >> i & 1]
    # Few distinct bit sets are left after the first aggregation, 2 to the number of rules at most.
    sets = entries.groupBy(F.col("failures").bitwiseAND(F.lit(all_bits).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    sums = sets.agg(
        *[total(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias(f"failed_{i}") for i, _ in rules],
        *[total(F.col("bits") == F.lit(1 << i)).alias(f"only_{i}") for i, _ in rules],
    )
    return sums.select(F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"failed_{i}").alias("n_failed"), F.col(f"only_{i}").alias("n_only")) for i, r in rules])))
