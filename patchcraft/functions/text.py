"""Column expressions over patch text.

Every function returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage code generation / the JVM; nothing here calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- line ends
def normalise_newlines(text: Column | str) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(_c(text), "\r\n?", "\n")


def decode_lenient(raw: Column | str) -> Column:
    """Decode UTF-8 bytes, dropping invalid sequences (no replacement char)."""
    return F.replace(F.make_valid_utf8(_c(raw).cast("string")), F.lit("�"), F.lit(""))


def split_lines(text: Column | str) -> Column:
    """Lines on ``\\n`` only (form feed and Unicode separators stay inside lines)."""
    return F.split(_c(text), "\n", -1)


def line_sign(line: Column | str) -> Column:
    """First character of a patch line: '-', '+', ' ' or anything else."""
    return F.substring(_c(line), 1, 1)


# ---------------------------------------------------------------- patch rules
def strip_headers(text: Column | str) -> Column:
    """Everything before the first line that starts with ``@@`` is dropped."""
    return F.regexp_extract(_c(text), r"(?s)(?:^|\n)(@@.*)\z", 1)


def count_lines_with_sign(text: Column | str, sign: str) -> Column:
    return F.regexp_count(_c(text), F.lit("(?md)^" + "\\" + sign))


def has_package_line(text: Column | str) -> Column:
    """Any changed line declaring a package (sign, optional blanks, ``package ``)."""
    return _c(text).rlike(r"(?md)^[+-][^\S\n]*package ")


# ---------------------------------------------------------------- tokens
def standardise_numbers(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), fixed.NUMBER_RE, fixed.NUMBER_REPLACEMENT)


def tokenise(text: Column | str) -> Column:
    """Split on space/tab runs (dropped) and around punctuation and newline (kept)."""
    return F.regexp_extract_all(_c(text), F.lit(fixed.TOKEN_RE), F.lit(1))


def word_tokens(line: Column | str) -> Column:
    """Identifier-character runs and single other characters; joins back to the line."""
    return F.regexp_extract_all(_c(line), F.lit(fixed.WORD_RE), F.lit(1))


def words_only(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(fixed.IDENT_WORD_RE), F.lit(1))


def is_identifier(word: Column) -> Column:
    return word.rlike(fixed.IDENTIFIER_START_RE)


def keyword_array() -> Column:
    return F.array(*[F.lit(k) for k in fixed.JAVA_KEYWORDS])


def is_keyword(word: Column) -> Column:
    return word.isin(fixed.JAVA_KEYWORDS)


def rename_message(renames: Column | str) -> Column:
    """``old->new`` pairs joined by ``, ``."""
    return F.array_join(
        F.transform(_c(renames), lambda r: F.concat(r["old"], F.lit("->"), r["new"])), ", "
    )


def same_letter_shape(a: Column, b: Column) -> Column:
    """Both start upper case, or both start lower case / underscore."""
    up_a, up_b = a.rlike(r"^\p{Lu}"), b.rlike(r"^\p{Lu}")
    low_a, low_b = a.rlike(r"^[\p{Ll}_]"), b.rlike(r"^[\p{Ll}_]")
    return (up_a & up_b) | (low_a & low_b)


def seeded_hash(seed: int | str, *keys: Column | str) -> Column:
    """Reproducible pseudo-random order key: md5 of ``seed:key``."""
    parts = [F.lit(f"{seed}:")]
    for i, k in enumerate(keys):
        if i:
            parts.append(F.lit("|"))
        parts.append(_c(k).cast("string"))
    return F.md5(F.concat(*parts))
