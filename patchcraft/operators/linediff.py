"""Ordered line differences, unified hunks, and their application.

Both versions of a text stand in one row, so nothing is exchanged.  Common
beginnings and ends are cut off by built-in functions; what is left between
them goes to a small Python helper as 64-bit line numbers (no text leaves the
JVM) and comes back as edit blocks around a longest common subsequence.  The
lines between the blocks are compared again as text; should two different lines
of a pair share a number, the whole middle counts as changed, so a script is
right in any case.  Scripts, hunks and their application are array functions.

Intermediate arrays come out of one-row generators: later lambdas refer to
them by element, and a generator's output is not substituted back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import lcs

#: A stretch that differs: its first line (from 0) and number of lines in the old and in the new version.
BLOCKS = ArrayType(StructType([StructField(c, IntegerType()) for c in ("a", "la", "b", "lb")]))


@F.arrow_udf(BLOCKS)
def _blocks(a: pa.Array, b: pa.Array) -> pa.Array:
    found = [None if x is None or y is None else lcs.blocks(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())]
    return pa.array(found, pa.list_(pa.struct([(c, pa.int32()) for c in ("a", "la", "b", "lb")])))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed here and nowhere else."""
    one = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*[c for c in df.columns if c not in columns], F.inline(one))


def text_lines(text: Column | str) -> Column:
    """Lines of a text without their newlines; a missing last newline counts as present, an empty text has no line."""
    c = F.col(text) if isinstance(text, str) else text
    ended = F.when(c.endswith("\n"), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(ended, "\n", -1))


def with_blocks(df: DataFrame, old: str = "old_lines", new: str = "new_lines", out: str = "blocks") -> DataFrame:
    """``out``: the least stretches in which the two line arrays differ, ``a, la`` in the old one and ``b, lb`` in the new.

    Minimal: no script removes and adds fewer lines.  Null if either array is
    null; empty if they are equal.
    """
    a, b = F.col(old), F.col(new)

    def same(x: Column, y: Column) -> Column:
        """Number of equal elements at the beginning."""
        off = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(off == 0, F.size(x)).otherwise(off - 1).cast("int")

    df = _once(df, _head=same(a, b))
    rest = lambda c: F.slice(c, F.col("_head") + 1, F.size(c) - F.col("_head"))
    df = _once(df, _tail=F.when(a.isNotNull() & b.isNotNull(), same(F.reverse(rest(a)), F.reverse(rest(b)))))
    middle = lambda c: F.slice(c, F.col("_head") + 1, F.size(c) - F.col("_head") - F.col("_tail"))
    number = lambda c: F.transform(middle(c), lambda x: F.xxhash64(x))
    df = df.withColumn("_found", _blocks(number(a), number(b)))
    head = F.col("_head")
    moved = F.transform("_found", lambda e: F.struct((e["a"] + head).alias("a"), e["la"].alias("la"), (e["b"] + head).alias("b"), e["lb"].alias("lb")))
    df = _once(df, _found=moved)

    found = F.col("_found")
    end = F.struct(F.size(a).alias("a"), F.lit(0).alias("la"), F.size(b).alias("b"), F.lit(0).alias("lb"))
    before = lambda i, at, length: F.when(i == 0, 0).otherwise(found[i - 1][at] + found[i - 1][length])

    def kept(e: Column, i: Column) -> Column:
        p, q = before(i, "a", "la"), before(i, "b", "lb")
        return (F.slice(a, p + 1, e["a"] - p) == F.slice(b, q + 1, e["b"] - q)) & (e["a"] - p == e["b"] - q)

    checked = F.forall(F.transform(F.concat(found, F.array(end)), kept), lambda ok: ok)
    whole = F.array(F.struct(head.alias("a"), F.size(middle(a)).alias("la"), head.alias("b"), F.size(middle(b)).alias("lb")))
    return _once(df, **{out: F.when(checked, found).otherwise(F.when(found.isNotNull(), whole))}).drop("_head", "_tail", "_found")


def with_script(df: DataFrame, old: str = "old_lines", new: str = "new_lines", out: str = "script") -> DataFrame:
    """``out``: array of ``sign, old_no, new_no, line`` in order; line numbers from 1, null on the side that lacks the line."""
    df = with_blocks(df, old, new, "_blocks")
    a, b, e = F.col(old), F.col(new), F.col("_blocks")
    none = F.lit(None).cast("int")

    def entry(sign: str, old_no: Column, new_no: Column, line: Column) -> Column:
        return F.struct(F.lit(sign).alias("sign"), old_no.cast("int").alias("old_no"), new_no.cast("int").alias("new_no"), line.alias("line"))

    def step(block: Column, i: Column) -> Column:
        p = F.when(i == 0, 0).otherwise(e[i - 1]["a"] + e[i - 1]["la"])
        q = F.when(i == 0, 0).otherwise(e[i - 1]["b"] + e[i - 1]["lb"])
        kept = F.transform(F.slice(a, p + 1, block["a"] - p), lambda x, t: entry(" ", p + t + 1, q + t + 1, x))
        removed = F.transform(F.slice(a, block["a"] + 1, block["la"]), lambda x, t: entry("-", block["a"] + t + 1, none, x))
        added = F.transform(F.slice(b, block["b"] + 1, block["lb"]), lambda x, t: entry("+", none, block["b"] + t + 1, x))
        return F.concat(kept, removed, added)

    end = F.struct(F.size(a).alias("a"), F.lit(0).alias("la"), F.size(b).alias("b"), F.lit(0).alias("lb"))
    return _once(df, **{out: F.flatten(F.transform(F.concat(e, F.array(end)), step))}).drop("_blocks")


def line_script(versions: DataFrame, key: str = "pair_id", old: str = "old", new: str = "new") -> DataFrame:
    """``key, ord, sign, old_no, new_no, line``: the least edit script of every pair, kept lines included.

    Lines are what newlines separate, so joining the `` `` and ``-`` lines
    with newlines gives the old text, the `` `` and ``+`` lines the new one.
    A moved line is a ``-`` and a ``+``.  A null version has the script of an
    empty text.
    """
    split = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1)
    df = with_script(_once(versions.select(key, old, new), old_lines=split(old), new_lines=split(new)).drop(*({old, new} - {key})))
    return df.select(key, F.posexplode("script").alias("ord", "s")).select(key, "ord", "s.*")


def moved_lines(script: DataFrame, key: str = "pair_id") -> DataFrame:
    """``key, line, n_moved``: lines that a script removes in one place and adds in another, with how many."""
    changed = script.where("sign <> ' '").groupBy(key, "line").agg(
        F.least(F.count_if(F.col("sign") == "-"), F.count_if(F.col("sign") == "+")).alias("n_moved")
    )
    return changed.where("n_moved > 0")


def _span(start: Column, length: Column) -> Column:
    """First line from 1 and number of lines, as a hunk's header has them."""
    at = F.when(length == 0, start).otherwise(start + 1).cast("string")
    return F.when(length == 1, at).otherwise(F.concat(at, F.lit(","), length.cast("string")))


def with_patch(df: DataFrame, old: str = "old_lines", new: str = "new_lines", out: str = "patch", context: int = 3) -> DataFrame:
    """``out``: unified hunks from the old to the new lines, without file headers; empty for equal lines.

    Blocks whose contexts touch share a hunk: a hunk begins at each block that
    lies more than twice the context behind the one before it.
    """
    df = with_blocks(df, old, new, "_blocks")
    a, b, e = F.col(old), F.col(new), F.col("_blocks")
    apart = lambda k: (k == 0) | (e[k]["a"] - e[k - 1]["a"] - e[k - 1]["la"] > 2 * context)
    indexes = F.transform(e, lambda _, k: k)
    df = _once(df, _starts=F.filter(indexes, apart))
    starts = F.col("_starts")

    def hunk(k: Column, h: Column) -> Column:
        until = F.coalesce(F.get(starts, h + 1), F.size(e))
        first, last = e[k], e[until - 1]
        a0 = F.greatest(first["a"] - context, F.lit(0))
        a1 = F.least(last["a"] + last["la"] + context, F.size(a))
        b0, b1 = first["b"] - (first["a"] - a0), last["b"] + last["lb"] + (a1 - last["a"] - last["la"])
        signed = lambda sign, part: F.transform(part, lambda x: F.concat(F.lit(sign), x))

        def body(block: Column, i: Column) -> Column:
            behind = F.when(i == 0, a0).otherwise(e[k + i - 1]["a"] + e[k + i - 1]["la"])
            return F.concat(
                signed(" ", F.slice(a, behind + 1, block["a"] - behind)),
                signed("-", F.slice(a, block["a"] + 1, block["la"])),
                signed("+", F.slice(b, block["b"] + 1, block["lb"])),
            )

        header = F.concat(F.lit("@@ -"), _span(a0, a1 - a0), F.lit(" +"), _span(b0, b1 - b0), F.lit(" @@"))
        end = last["a"] + last["la"]
        return F.concat(F.array(header), F.flatten(F.transform(F.slice(e, k + 1, until - k), body)), signed(" ", F.slice(a, end + 1, a1 - end)))

    lines = F.flatten(F.transform(starts, hunk))
    text = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return _once(df, **{out: F.when(e.isNotNull(), text)}).drop("_blocks", "_starts")


_HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def with_hunks(df: DataFrame, patch: str = "patch", out: str = "hunks", reverse: bool = False) -> DataFrame:
    """``out``: the hunks of a unified patch as ``at`` (lines before it), ``have`` (lines it stands on), ``give`` (lines it leaves)."""
    pieces = F.filter(F.split(F.col(patch), "(?dm)^(?=@@ -)", -1), lambda p: p.startswith("@@ -"))
    own, other = ("+", "-") if reverse else ("-", "+")
    group = 3 if reverse else 1

    def hunk(piece: Column) -> Column:
        start = F.regexp_extract(piece, _HEADER, group).cast("int")
        length = F.regexp_extract(piece, _HEADER, group + 1)
        body = F.filter(F.split(piece, "\n", -1), lambda x, i: (i > 0) & (x != ""))
        side = lambda sign: F.transform(F.filter(body, lambda x: x.startswith(" ") | x.startswith(sign)), lambda x: F.substr(x, F.lit(2)))
        return F.struct(F.when(length == "0", start).otherwise(start - 1).alias("at"), side(own).alias("have"), side(other).alias("give"))

    return _once(df, **{out: F.transform(pieces, hunk)})


def apply_patch(df: DataFrame, patch: str = "patch", lines: str = "old_lines", out: str = "patched_lines", reverse: bool = False) -> DataFrame:
    """``out``: ``lines`` with the patch applied (or, reversed, undone); null where a hunk does not stand on the lines it names."""
    df = with_hunks(df, patch, "_hunks", reverse)
    a, h = F.col(lines), F.col("_hunks")
    fits = F.forall(h, lambda x: F.slice(a, x["at"] + 1, F.size(x["have"])) == x["have"])
    ends = lambda i: h[i]["at"] + F.size(h[i]["have"])

    def part(x: Column, i: Column) -> Column:
        behind = F.when(i == 0, 0).otherwise(ends(i - 1))
        return F.concat(F.slice(a, behind + 1, x["at"] - behind), x["give"])

    last = F.when(F.size(h) == 0, 0).otherwise(ends(F.size(h) - 1))
    whole = F.concat(F.flatten(F.transform(h, part)), F.slice(a, last + 1, F.size(a) - last))
    return _once(df, **{out: F.when(fits, whole)}).drop("_hunks")


def lines_text(lines: Column | str) -> Column:
    """The text of lines, each with its newline."""
    c = F.col(lines) if isinstance(lines, str) else lines
    return F.when(F.size(c) == 0, "").otherwise(F.concat(F.array_join(c, "\n"), F.lit("\n")))
