"""Patches without their comments, and verdicts that do not count comment edits.

Between two lines a Java lexer has one bit of state: inside a block comment or
not.  So a line is a function of that bit to itself, one of four: it keeps the
bit, sets it, clears it or turns it.  Every line's function is found on its own
by built-in functions; the state in which a line begins is the composition of
the functions before it, which a window over the lines of a version gives: the
last function that sets or clears the bit, and the number of turns since then.
The old and the new version of a hunk are lexed apart, each from the state that
its first comment sign tells.

All windows and both aggregations are keyed by the patch and share one
exchange; rename detection goes on from there without another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from . import rename as R

KEY = R.KEY
_STRING = r"\"(?:[^\"\\]|\\.?)*+(?:\"|$)|'(?:[^'\\]|\\.?)*+(?:'|$)"
#: String or character literal, line comment, whole block comment, block comment without its end, or other text.
LEXEME = "(" + _STRING + r"|//.*|/\*.*?\*/|/\*.*|[^\"'/]+|/)"


def lexemes(line: Column) -> Column:
    """The pieces of a line that begins outside of comments; joined they are the line."""
    return F.regexp_extract_all(line, F.lit(LEXEME), F.lit(1))


def _is_comment(x: Column) -> Column:
    return x.startswith("//") | x.startswith("/*")


def _opens(x: Column) -> Column:
    """A block comment that goes on in the next line."""
    return x.startswith("/*") & ~(x.endswith("*/") & (F.length(x) >= 4))


def _code(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda x: F.when(_is_comment(x), " ").otherwise(x)), "")


def _lexed(lines: DataFrame) -> DataFrame:
    """Adds what a line is when it begins outside (``out_``) and inside (``in_``) of a comment, and where the comment's state goes.

    ``after_out``, ``after_in``: state behind the line.  ``stray``: the line
    has the end of a comment that began before the hunk, if no other sign came first.
    """
    body = F.when(F.col("line").rlike(r"^[-+ ]"), F.substr("line", F.lit(2))).otherwise("")
    end = F.instr(body, "*/")
    df = lines.withColumns({
        "out_lex": lexemes(body),
        "in_lex": F.when(end > 0, lexemes(F.substr(body, end + 2))).otherwise(F.array().cast("array<string>")),
        "closed": end > 0,
        "starred": body.rlike(r"^\s*(?:\*|$)"),
    })
    plain = F.array_join(F.transform("out_lex", lambda x: F.when(_is_comment(x) | x.startswith('"') | x.startswith("'"), " ").otherwise(x)), "")
    return df.withColumns({
        "after_out": F.exists("out_lex", _opens),
        "after_in": ~F.col("closed") | F.exists("in_lex", _opens),
        "stray": F.contains(plain, F.lit("*/")),
        "out_comment": F.exists("out_lex", _is_comment),
    })


def comment_states(lines: DataFrame) -> DataFrame:
    """``lines(repo, patch_id, pos, line)`` of whole patches to one row for each line and version that has it.

    Lines that belong to no version (headers) are in both and change no state.
    Adds ``side`` (``-`` or ``+``), ``inside`` (the line begins in a comment),
    ``code`` (the line's text without comments; the text itself if it has
    none) and ``has_comment``.
    """
    hunk = F.count_if(F.col("line").startswith(fixed.HUNK_PREFIX)).over(Window.partitionBy(*KEY).orderBy("pos"))
    sign = T.line_sign("line")
    sides = F.when(sign.isin("-", "+"), F.array(sign)).otherwise(F.array(F.lit("-"), F.lit("+")))
    df = _lexed(lines.withColumn("hunk", hunk).select("*", F.explode(sides).alias("side")))
    whole = Window.partitionBy(*KEY, "side", "hunk")
    upto = whole.orderBy("pos")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    out, inn = F.col("after_out"), F.col("after_in")
    told = F.col("stray") | F.col("after_out") | F.col("out_comment")
    df = df.select(
        "*",
        F.count_if(out & ~inn).over(upto).alias("turns"),
        # The hunk begins inside a comment if its first sign ends one, or has no sign and nothing but starred lines.
        F.coalesce(F.min_by("stray", F.when(told, F.col("pos"))).over(whole), F.bool_and("starred").over(whole) & F.bool_or(F.contains("line", F.lit("*"))).over(whole)).alias("began"),
    )
    fixed_by = F.last(F.when(out == inn, F.struct(out.alias("state"), F.col("turns").alias("turns"))), ignorenulls=True).over(before)
    df = df.withColumns({"fixed_by": fixed_by, "turned": F.coalesce(F.max("turns").over(before), F.lit(0))})
    odd = (F.col("turned") - F.coalesce("fixed_by.turns", F.lit(0))) % 2 == 1
    df = df.withColumn("inside", F.coalesce("fixed_by.state", "began") != odd)
    has = F.col("inside") | F.col("out_comment")
    code = F.when(F.col("inside"), _code(F.col("in_lex"))).when(F.col("out_comment"), _code(F.col("out_lex")))
    return df.select(
        *KEY, "pos", "line", "side", "inside", has.alias("has_comment"),
        F.when(has, F.rtrim(code)).otherwise(F.substr("line", F.lit(2))).alias("code"),
    )


def code_patches(patches: DataFrame) -> DataFrame:
    """``repo, patch_id, text, only_comments``: patches whose changed lines have no comments.

    Changed lines that are nothing but comment go; others keep their code.
    ``only_comments``: something is changed, and what is left of the removed
    lines is what is left of the added ones.  Rows of one patch are one group,
    which is bound by what a row can hold.
    """
    text = T.normalise_newlines("text")
    lines = patches.select(*KEY, F.posexplode(T.split_lines(text)).alias("pos", "line"))
    state = comment_states(lines)
    changed = T.line_sign("line").isin("-", "+")
    gone = F.col("has_comment") & (F.trim("code") == "")
    kept = F.when(changed & ~gone, F.struct("pos", F.concat("side", "code").alias("line")))
    context = F.when(~changed & (F.col("side") == "+"), F.struct("pos", "line"))

    def rest(side: str) -> Column:
        own = F.collect_list(F.when(changed & ~gone & (F.col("side") == side), F.struct("pos", "code")))
        return F.transform(F.array_sort(own), lambda x: x["code"])

    made = state.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.coalesce(kept, context))).alias("lines"),
        (F.bool_or(changed) & (rest("-") == rest("+")) & F.bool_or(changed & F.col("has_comment"))).alias("only_comments"),
    )
    return made.select(
        *KEY, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), F.coalesce("only_comments", F.lit(False)).alias("only_comments")
    )


def code_verdicts(patches: DataFrame, max_renames: int = fixed.DEFAULT_MAX_RENAMES) -> DataFrame:
    """``repo, patch_id, verdict, n_renames, message, reason`` of the patches' code.

    Comments play no part in any rule.  A patch that changes nothing but
    comments is ``n`` with the reason ``comment``; a rejected one has no
    verdict and its reason.
    """
    code = code_patches(patches)
    judged = R.rename_verdicts(code, max_renames, keep_rejected=True)
    joined = judged.join(code.select(*KEY, "only_comments"), KEY)
    only = F.col("only_comments")
    return joined.select(
        *KEY, F.when(only, "n").otherwise(F.col("verdict")).alias("verdict"), F.when(only, F.lit(0).cast("long")).otherwise(F.col("n_renames")).alias("n_renames"),
        F.when(~only, F.col("message")).alias("message"), F.when(only, "comment").otherwise(F.col("reject_reason")).alias("reason"),
    )
