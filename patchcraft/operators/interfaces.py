"""Renames that only follow the rename of an interface's method.

The types of a repository and what they extend or implement are one table
(``type_index``); a method renamed in an interface reaches that interface's
subtypes by joining it with the index level by level.  A rename in a file of
the same commit that declares such a subtype, with the same two names, is no
decision of that file and is taken out of its verdict.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..session import shared_path
from . import rename as R

COMMIT = ["repo", "commit_id"]
#: Between commit and path in a patch id; no path has it.
_SEP = "\x1f"
_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
#: String and character literals stay, comments go.
_LITERAL_OR_COMMENT = r"""(?s)("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|//[^\n]*|/\*.*?\*/"""
#: A declared type: kind, name, and what stands before its body.
_TYPE = rf"\b(class|interface|enum|record)\s+({_NAME})([^{{;]*)\{{"
#: A method without a body: its result's type, its name, its arguments.
_ABSTRACT = rf"(?<!\breturn)(?<!\bnew)(?<!\bthrow)(?<!\belse)(?<=[\p{{L}}\p{{N}}_$\]>])\s+({_NAME})\s*\([^(){{}};]*\)\s*(?:throws\s[^;{{}}()]*)?;"


def _without_comments(source: Column) -> Column:
    return F.regexp_replace(source, _LITERAL_OR_COMMENT, "$1")


def declared_types(files: DataFrame) -> DataFrame:
    """``..., kind, name, supers, methods`` of every type that ``source`` declares; a row each.

    ``supers`` are the simple names it extends or implements, without type
    arguments; ``methods`` the names of its methods without a body if it is an
    interface.  A type's part of the text ends where the next one begins.
    Files without a type, or null, give no row.
    """
    plain = files.withColumn("_plain", _without_comments("source")).drop("source")
    parts = plain.withColumn("_part", F.explode(F.split("_plain", r"(?=\b(?:class|interface|enum|record)\s+" + _NAME + r"[^{;]*\{)", -1))).drop("_plain")
    found = lambda i: F.regexp_extract("_part", "^" + _TYPE, i)
    heads = parts.withColumns({"kind": found(1), "name": found(2), "_tail": found(3)}).where("kind <> ''")
    # Type arguments go from the inside out; three levels are more than declarations have.
    tail = F.col("_tail")
    for _ in range(3):
        tail = F.regexp_replace(tail, r"<[^<>]*>", " ")
    named = F.regexp_extract_all(F.regexp_extract(tail, r"(?s)\b(?:extends|implements)\b(.*)", 1), F.lit(rf"((?:{_NAME}\s*\.\s*)*{_NAME})"), F.lit(1))
    simple = F.transform(named, lambda n: F.regexp_replace(n, r"(?s)^.*\.\s*", ""))
    supers = F.array_distinct(F.filter(simple, lambda n: ~n.isin("extends", "implements", "permits")))
    methods = F.when(F.col("kind") == "interface", F.array_distinct(F.regexp_extract_all("_part", F.lit(_ABSTRACT), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return heads.withColumns({"supers": supers, "methods": methods}).drop("_part", "_tail")


def type_index(files: DataFrame) -> DataFrame:
    """``repo, super, sub``: every declared step from a type to one that extends or implements it, once."""
    types = declared_types(files.select("repo", "source"))
    return types.select("repo", F.explode("supers").alias("super"), F.col("name").alias("sub")).distinct()


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage between levels."""
    path = shared_path(df.sparkSession, "interfaces", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def subtypes(seeds: DataFrame, index: DataFrame) -> DataFrame:
    """``seeds(repo, type)`` with ``sub``: the types themselves and all below them, each once.

    One join with the index a level, until a level finds no new pair; types
    that extend each other in a circle end it too.
    """
    level = _kept(seeds.select("repo", "type", F.col("type").alias("sub")).distinct(), "level")
    found = level
    while not level.isEmpty():
        below = level.join(index.withColumnRenamed("sub", "_below"), (level["repo"] == index["repo"]) & (level["sub"] == index["super"]))
        below = below.select(level["repo"], "type", F.col("_below").alias("sub")).distinct()
        level = _kept(below.join(found, ["repo", "type", "sub"], "left_anti"), "level")
        found = found.unionByName(level)
    return found


def interface_verdicts(changes: DataFrame, files: DataFrame, max_renames: int = fixed.DEFAULT_MAX_RENAMES) -> DataFrame:
    """``repo, commit_id, path, verdict, n_renames, n_caused, message, reason`` of every changed file that only renames.

    ``changes(repo, commit_id, path, text, source)`` are patches of single
    files with the file's content before; ``files(repo, source)`` the files of
    the repositories.  A rename is caused when the commit renames a method of
    an interface in the same way and the file declares a type below that
    interface; the interface's own file keeps it.  The verdict counts what is
    left; with causes alone left it is ``ignored`` with the reason
    ``interface method``.  Files whose patch is rejected have no row, nor have
    such whose key or text is null.
    """
    keyed = changes.where("repo is not null and commit_id is not null and path is not null and text is not null")
    patches = keyed.select("repo", F.concat_ws(_SEP, "commit_id", "path").alias("patch_id"), "text")
    parts = F.split("patch_id", _SEP, 2)
    maps = _kept(R.rename_map(patches).select("repo", parts[0].alias("commit_id"), parts[1].alias("path"), "renames"), "renames")
    types = _kept(declared_types(keyed.select(*COMMIT, "path", "source")), "types")

    renamed = maps.select(*COMMIT, "path", F.inline("renames"))
    methods = types.where("kind = 'interface'").select(*COMMIT, "path", F.col("name").alias("type"), F.explode("methods").alias("old"))
    roots = _kept(renamed.join(methods, [*COMMIT, "path", "old"]).select(*COMMIT, "type", "old", "new").distinct(), "roots")
    below = subtypes(roots.select("repo", "type").distinct(), type_index(files))
    # An interface's own renames are its own: only types strictly below it follow.
    follow = roots.join(below.where("sub <> type"), ["repo", "type"]).select(*COMMIT, F.col("sub").alias("name"), "old", "new").distinct()
    caused = follow.join(types.select(*COMMIT, "path", "name"), [*COMMIT, "name"]).groupBy(*COMMIT, "path").agg(F.collect_set(F.struct("old", "new")).alias("caused"))

    judged = maps.join(caused, [*COMMIT, "path"], "left").withColumn("caused", F.coalesce("caused", F.array().cast("array<struct<old:string,new:string>>")))
    judged = judged.withColumn("own", F.filter("renames", lambda r: ~F.array_contains("caused", r)))
    n_caused, n = F.size("renames") - F.size("own"), F.size("own")
    ignored = (n == 0) & (n_caused > 0)
    return judged.select(
        *COMMIT, "path",
        F.when(ignored, "ignored").when(n == 0, "n").when(n <= max_renames, "y").otherwise("skip").alias("verdict"),
        n.cast("long").alias("n_renames"), n_caused.cast("long").alias("n_caused"),
        F.when(n > 0, T.rename_message("own")).alias("message"), F.when(ignored, "interface method").alias("reason"),
    )
