"""Commits and changed files -> one patch per commit.

Plan: filter commits (single parent) and changes (Java, both paths) where
they are read; exchange the changes' texts by commit and gather each
commit's there; join with commits on ``repo, commit_id`` reusing that
partitioning.  Forks share commit ids, so the repository is part of the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from . import linediff as LD


def commit_filter(commits: DataFrame) -> DataFrame:
    """Drop root commits and merges: keep exactly one parent."""
    return commits.where(F.size("parents") == 1)


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def is_java_change(a_path: str = "a_path", b_path: str = "b_path") -> Column:
    """Both paths present and the old path ends with ``.java`` in any case."""
    return _present(a_path) & _present(b_path) & F.lower(F.col(a_path)).endswith(".java")


def java_change_filter(changes: DataFrame) -> DataFrame:
    """Java changes with a non-empty patch."""
    return changes.where(is_java_change() & (F.octet_length("patch") > 0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(text: Column, place: Column) -> Column:
    return F.substr(text, F.lit(1), place - 1)


def _joined_below(head: Column, line: Column, added: Column) -> Column:
    """Old end without newline: the removed ``line`` is kept if a line of ``added``, the run to the end, is the same."""
    same = F.instr(added, F.concat(F.lit("\n+"), line, F.lit("\n")))
    kept = F.concat(head, _upto(added, same), F.lit("\n "), line, F.substr(added, same + F.length(line) + 2))
    return F.when(same > 0, kept).otherwise(F.concat(head, F.lit("\n-"), line, added))


def _joined_above(head: Column, line: Column) -> Column:
    """New end without newline: the added ``line`` is kept if a line of the removed run above is the same.

    Run ends are found on the reversed text, where a line's sign comes last.
    """
    other = F.regexp_instr(F.reverse(head), F.lit(r"(?dm)^[^\n]*[^-+\n]$"))
    block_at = F.when(other > 0, F.length(head) - other + 2).otherwise(F.lit(1))

    def in_block(at: Column) -> Column:
        return _let(F.substr(head, at), lambda block: _let(F.instr(F.concat(block, F.lit("\n+")), F.lit("\n+")), lambda plus: moved(at, block, plus)))

    def moved(at: Column, block: Column, plus: Column) -> Column:
        removed = F.concat(_upto(block, plus), F.lit("\n"))
        back = F.instr(F.reverse(removed), F.concat(F.lit("\n"), F.reverse(line), F.lit("-\n")))
        same = F.length(removed) - back - F.length(line) - 1
        kept = F.concat(
            _upto(head, at), _upto(removed, same), F.substr(block, plus), F.lit("\n "), line,
            F.substr(removed, same + F.length(line) + 2),
        )
        return F.when(back > 0, kept).otherwise(F.concat(head, F.lit("\n+"), line, F.lit("\n")))

    return _let(block_at, in_block)


def _without_marker(c: Column) -> Column:
    """``c`` begins with a newline and has the marker."""
    marker = "\n" + fixed.NO_EOF_NEWLINE_MARKER
    at = F.instr(c, F.lit(marker))
    further = F.regexp_replace(F.substr(c, at + len(marker)), r"\n" + fixed.NO_EOF_NEWLINE_MARKER.replace("\\", "\\\\"), "")
    rest = F.when(further.endswith("\n"), further).otherwise(F.concat(further, F.lit("\n")))

    def by_sign(before: Column, own: Column) -> Column:
        head, line, sign = _upto(before, F.length(before) - F.length(own)), F.substr(own, F.lit(2)), F.substr(own, F.lit(1), F.lit(1))
        return (
            F.when(sign == "-", _let(rest, lambda added: _joined_below(head, line, added)))
            .when(sign == "+", _let(head, lambda h: _joined_above(h, line)))
            .otherwise(F.concat(before, rest))
        )

    return _let(_upto(c, at), lambda before: _let(F.substring_index(before, "\n", -1), lambda own: by_sign(before, own)))


def _without_idle_hunk(t: Column) -> Column:
    """``t`` without its first newline, and without its last hunk if nothing is changed there."""
    back = F.instr(F.reverse(t), F.lit("- @@\n"))
    last = F.length(t) - back - 3
    idle = (back > 0) & ~F.substr(t, last).rlike(r"(?dm)^[-+]")
    left = F.when(idle, _upto(t, last + 1)).otherwise(t)
    return F.when(t.rlike(r"(?dm)^[-+]"), F.substr(left, F.lit(2))).otherwise(F.lit(""))


def normalise_eof_newline(text: Column | str) -> Column:
    """Treat a missing newline at end of file as present.

    Only text of one file that carries the marker is touched: markers go, and
    the marker's own line, if the run on the other side has the same line, is no
    change but a context line.  Pairs elsewhere stay.  The last hunk
    goes if no changed line is left in it; with none left at all the file
    contributes nothing.
    """
    c = F.col(text) if isinstance(text, str) else text
    fixed_text = _let(_let(F.concat(F.lit("\n"), c), _without_marker), _without_idle_hunk)
    return F.when(F.instr(c, fixed.NO_EOF_NEWLINE_MARKER) > 0, fixed_text).otherwise(c)


def has_marker(raw: Column | str = "patch") -> Column:
    """The patch says that a version lacks the newline at its end."""
    return F.instr(T.decode_lenient(raw), fixed.NO_EOF_NEWLINE_MARKER) > 0


def rediff(changes: DataFrame, where: Column, out: str = "rediffed") -> DataFrame:
    """``out``: unified hunks made again from ``a_blob`` and ``b_blob`` where ``where`` holds and both are there, else null.

    Both contents count as ending with a newline; a difference in nothing else
    leaves an empty patch.
    """
    wanted = where & F.col("a_blob").isNotNull() & F.col("b_blob").isNotNull()
    lines = lambda c: F.when(wanted, LD.text_lines(T.decode_lenient(c)))
    sides = changes.withColumns({"_old": lines("a_blob"), "_new": lines("b_blob")})
    return LD.with_patch(sides, "_old", "_new", out).drop("_old", "_new")


def change_texts(changes: DataFrame) -> DataFrame:
    """Per change: decoded, line-end normalised text; EOF newline fixed; ends with newline.

    A patch with the marker of a missing newline is made again where the
    change has both contents (``a_blob``, ``b_blob``); elsewhere the marker's
    rules are applied to the patch itself.
    """
    # Each text that later rules name comes out of a generator, so that none of them makes it again.
    once = lambda df, c, name: df.select("*", F.inline(F.array(F.struct(c.alias(name)))))
    kept = [c for c in changes.columns if c != "text"]
    changes = once(changes.select(*kept), T.normalise_newlines(T.decode_lenient("patch")), "_decoded")
    fixed_eof = normalise_eof_newline("_decoded")
    if {"a_blob", "b_blob"} <= set(changes.columns):
        changes = rediff(changes, has_marker(), "_rediffed")
        fixed_eof = F.coalesce(T.normalise_newlines("_rediffed"), fixed_eof)
    changes = once(changes, fixed_eof, "_fixed")
    fixed_eof = F.col("_fixed")
    ended = F.when(
        (F.length(fixed_eof) > 0) & ~fixed_eof.endswith("\n"), F.concat(fixed_eof, F.lit("\n"))
    ).otherwise(fixed_eof)
    return changes.select(*kept, ended.alias("text"))


def assemble_commit_patch(changes: DataFrame) -> DataFrame:
    """``repo, commit_id, text, n_java``: the commit's Java patches in change order.

    A commit appears when it has at least one change that is not "Java with
    an empty patch"; with no Java change its text is empty.  Ties on ``ord``
    are broken by path and text.  The patch of a commit is one row, so it is
    bound by what a row can hold (2 GB).
    """
    java = is_java_change()
    empty = F.octet_length("patch") == 0
    # Only Java changes are decoded.
    t = change_texts(changes.where(~(java & empty)).withColumn("patch", F.when(java, F.col("patch"))))
    # Exchanged before they are gathered: a scan task would sort and spill all its rows to gather the few of each commit.
    pieces = t.select("repo", "commit_id", F.when(java, F.struct("ord", "a_path", "text")).alias("_piece")).repartition("repo", "commit_id")
    per_commit = pieces.groupBy("repo", "commit_id").agg(F.collect_list("_piece").alias("_pieces"))
    ordered = F.sort_array("_pieces")  # array_sort compares by a function, called for each pair
    return per_commit.select(
        "repo", "commit_id",
        F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"),
        F.size("_pieces").cast("long").alias("n_java"),
    )


def collect_patches(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """``repo, commit_id, text, n_java, is_empty`` for single-parent commits."""
    patches = assemble_commit_patch(changes)
    kept = commit_filter(commits).select("repo", "commit_id")
    out = kept.join(patches, ["repo", "commit_id"])
    return out.select(
        "repo", "commit_id", "text", "n_java", (F.length("text") == 0).alias("is_empty")
    )
