"""Vocabulary mining, rename-pair sampling and template augmentation.

Sampling is exact and needs no retry cap: the vocabulary is indexed inside
letter-shape classes (upper / lower-or-underscore / other), so a draw is
always of the right shape; words of the template are skipped by mapping the
draw through the template's sorted excluded indices, so a draw never has to
be rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .dataset import seeded_rank
from .rename import rename_map


# ------------------------------------------------------------------ identifiers
def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_identifiers(text: Column | str) -> Column:
    """Distinct words starting with an ASCII letter or ``_``, keywords removed."""
    words = F.regexp_extract_all(_col(text), F.lit(fixed.VOCAB_WORD_RE), F.lit(1))
    return F.array_except(F.array_distinct(words), T.keyword_array())


def extract_short_identifiers(text: Column | str) -> Column:
    """Distinct words starting with an ASCII letter, at most 10 characters, keywords removed."""
    words = F.filter(
        F.regexp_extract_all(_col(text), F.lit(fixed.SHORT_VOCAB_WORD_RE), F.lit(1)),
        lambda w: F.length(w) <= fixed.SHORT_IDENTIFIER_MAX,
    )
    return F.array_except(F.array_distinct(words), T.keyword_array())


def keyword_minus(words: Column | str) -> Column:
    c = F.col(words) if isinstance(words, str) else words
    return F.array_except(c, T.keyword_array())


def seed_letters(letters: str = "abcdefghijklmnopqrstuvwxyz") -> list[str]:
    """Single letters the vocabulary starts with (all 26; the end letter is included)."""
    return list(letters)


def distinct_words(patches: DataFrame, text: str = "text") -> DataFrame:
    """``word``: distinct identifiers over all patches (explode + distinct)."""
    return patches.select(F.explode(extract_identifiers(text)).alias("word")).distinct()


def build_vocabulary(patches: DataFrame, text: str = "text", letters: list[str] | None = None) -> DataFrame:
    """Seed letters united with every identifier of every patch; distinct."""
    spark = patches.sparkSession
    seeds = spark.createDataFrame([(w,) for w in (letters or seed_letters())], "word string")
    return distinct_words(patches, text).unionByName(seeds).distinct()


def sort_vocabulary(vocab: DataFrame) -> DataFrame:
    """Words in code-point order (a distributed range sort)."""
    return vocab.orderBy("word")


def vocabulary_minus(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """Vocabulary without the given words (hash anti-join)."""
    return vocab.join(words.select("word").distinct(), "word", "left_anti")


def exact_dedup(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per distinct text, keeping the lowest key; ``n_copies`` counts the group.

    The grouping key is a fixed-size digest (SHA-256 and length) rather than
    the text itself, so the shuffle moves ~80 bytes per row instead of whole
    documents; equal texts always share it, and different texts sharing it
    would need a SHA-256 collision.  Partial aggregation collapses a hot copy
    group to one row per map task before the shuffle, so a text repeated in
    a third of all rows is cheap.
    """
    digest = df.select(
        F.sha2(F.col(text), 256).alias("_sha"), F.length(text).alias("_len"), F.col(key)
    )
    return digest.groupBy("_sha", "_len").agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("n_copies")
    ).drop("_sha", "_len")


# ------------------------------------------------------------------ sampling
def letter_shape(word: Column) -> Column:
    return (
        F.when(word.rlike(r"^\p{Lu}"), "U")
        .when(word.rlike(r"^[\p{Ll}_]"), "L")
        .otherwise("O")
    )


SHAPES = ("U", "L", "O")


def _of_shape(shape: Column) -> Column:
    """The excluded indices of a shape class."""
    return F.coalesce(*[F.when(shape == s, F.col(f"_excl_{s}")) for s in SHAPES])


def _index_vocabulary(vocab: DataFrame, seed) -> DataFrame:
    """``word, shape, idx`` (0-based within shape, seeded order) and ``class_size``."""
    v = vocab.select("word").withColumn("shape", letter_shape(F.col("word")))
    ranked = seeded_rank(v, "word", f"{seed}:vocab", by=["shape"], rank_col="_r", bounded_groups=True)
    sizes = v.groupBy("shape").agg(F.count(F.lit(1)).alias("class_size"))
    return ranked.select("word", "shape", (F.col("_r") - 1).alias("idx")), sizes


def _draw(seed, *parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def _skips(excluded_sorted: Column) -> Column:
    """Of each excluded index, the number of free ones before it."""
    return F.transform(excluded_sorted, lambda e, i: e - i)


def _skip_excluded(p: Column, skips: Column) -> Column:
    """Map a position among non-excluded indices to the actual index: one further for each excluded one before it."""
    return p + F.size(F.filter(skips, lambda before: before <= p))


def sample_pairs(
    vocab: DataFrame,
    templates: DataFrame,
    n: int,
    seed: int | str = fixed.DEFAULT_SEED,
) -> DataFrame:
    """``template_id, copy, pair_old, pair_new``: ``n`` ordered pairs of distinct words per template.

    ``templates``: ``template_id, old, new, words ARRAY<STRING>`` (words of the
    template, excluded from the draw).  ``pair_old`` has the letter shape of
    ``old`` and ``pair_new`` that of ``new``; draws are with replacement
    across copies.  A template whose class has no free word gets no rows.
    """
    # Ranking reads the vocabulary twice, and the indexed one feeds three joins and the
    # class sizes; one materialisation each, so the vocabulary is mined once.
    indexed, _ = _index_vocabulary(vocab.persist(), seed)
    indexed = indexed.persist()
    sizes = indexed.groupBy("shape").agg(F.count(F.lit(1)).alias("class_size"))
    t = templates.select(
        "template_id", "old", "new", "words",
        letter_shape(F.col("old")).alias("s_old"), letter_shape(F.col("new")).alias("s_new"),
    )
    # Excluded indices per template and shape class (bounded by template size).
    tw = t.select("template_id", F.explode(F.array_distinct("words")).alias("word"))
    # One aggregate for both names: Spark does not reuse an exchange above an explode.
    excl = tw.join(indexed, "word").groupBy("template_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("shape") == s, F.col("idx")))).alias(f"_excl_{s}") for s in SHAPES]
    )
    sizes_b = F.broadcast(sizes)  # at most three rows
    empty = F.array().cast("array<bigint>")
    t = (
        t.drop("words").join(excl, "template_id", "left")
        .join(sizes_b.withColumnsRenamed({"shape": "s_old", "class_size": "size_old"}), "s_old")
        .join(sizes_b.withColumnsRenamed({"shape": "s_new", "class_size": "size_new"}), "s_new")
        .withColumns({f"excl_{k}": F.coalesce(_of_shape(F.col(f"s_{k}")), empty) for k in ("old", "new")})
        .drop(*[f"_excl_{s}" for s in SHAPES])
    )
    # Each value that later ones name comes out of a generator, so none is computed twice.
    t = t.select("*", F.inline(F.array(F.struct(_skips(F.col("excl_old")).alias("skip_old"), _skips(F.col("excl_new")).alias("skip_new")))))
    copies = t.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    free_old = F.col("size_old") - F.size("excl_old")
    same = F.col("s_old") == F.col("s_new")
    free_new = F.col("size_new") - F.size("excl_new") - same.cast("long")
    d = copies.where((free_old > 0) & (free_new > 0))
    draws = F.struct(*[(_draw(seed, F.col("template_id"), F.col("copy"), F.lit(k)) % free).alias(f"draw_{k}") for k, free in (("old", free_old), ("new", free_new))])
    d = d.select("*", F.inline(F.array(draws)))
    d = d.select("*", F.inline(F.array(F.struct(_skip_excluded(F.col("draw_old"), F.col("skip_old")).alias("idx_old")))))
    # The new word also skips the old word when both come from one class, in which all of excl_old is excl_new.
    shifted = _skip_excluded(F.col("draw_new"), F.col("skip_new"))
    past_old = _skip_excluded(F.col("draw_new") + 1, F.col("skip_new"))
    d = d.withColumn("idx_new", F.when(same & (F.col("draw_old") <= F.col("draw_new")), past_old).otherwise(shifted))
    w_old = indexed.select(F.col("shape").alias("s_old"), F.col("idx").alias("idx_old"), F.col("word").alias("pair_old"))
    w_new = indexed.select(F.col("shape").alias("s_new"), F.col("idx").alias("idx_new"), F.col("word").alias("pair_new"))
    return d.join(w_old, ["s_old", "idx_old"]).join(w_new, ["s_new", "idx_new"]).select(
        "template_id", "copy", "pair_old", "pair_new"
    )


# ------------------------------------------------------------------ templates and spawning
def _whole_word(word: Column) -> Column:
    """Pattern matching ``word`` as a maximal word (identifiers hold no regex metacharacters)."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), word, F.lit(r"(?![\p{L}\p{N}_])"))


def spawn_templates(patches: DataFrame) -> DataFrame:
    """Patches usable as templates: exactly one rename ``old -> new``, the new
    name on no removed line and the old name on no added line.

    Output: ``repo, patch_id, template_id, text, old, new, words``.
    """
    first = F.try_element_at("renames", F.lit(1))
    m = rename_map(patches).where(F.size("renames") == 1).select(
        "repo", "patch_id", first["old"].alias("old"), first["new"].alias("new")
    )
    t = patches.select("repo", "patch_id", T.normalise_newlines("text").alias("text")).join(m, ["repo", "patch_id"])
    lines = F.split("text", "\n", -1)

    def has_word(sign: str, word: Column) -> Column:
        pattern = _whole_word(word)
        return F.exists(
            lines,
            lambda l: (F.substring(l, 1, 1) == sign) & F.regexp_like(F.substring(l, 2, 1 << 30), pattern),
        )

    ok = ~has_word("-", F.col("new")) & ~has_word("+", F.col("old"))
    return t.where(ok).select(
        "repo", "patch_id", F.concat_ws("/", "repo", "patch_id").alias("template_id"),
        "text", "old", "new", extract_identifiers("text").alias("words"),
    )


#: Stand for the two names in a template's text while copies are made.
_OLD, _NEW = "\x00", "\x01"


def _rewritten(text: Column, old: Column, new: Column, old_as: Column, new_as: Column) -> Column:
    """``old`` on removed lines and ``new`` on added ones, as whole words, in other words."""

    def rewrite(l: Column) -> Column:
        sign = F.substring(l, 1, 1)
        return (
            F.when(sign == "-", F.regexp_replace(l, _whole_word(old), old_as))
            .when(sign == "+", F.regexp_replace(l, _whole_word(new), new_as))
            .otherwise(l)
        )

    return F.array_join(F.transform(F.split(text, "\n", -1), rewrite), "\n")


def spawn_patches(templates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Copies of each template with the rename replaced by the drawn pair.

    On removed lines ``old`` becomes ``pair_old``; on added lines ``new``
    becomes ``pair_new`` (whole words only); other lines are unchanged.  The
    places of the names are found once a template, and a copy only puts its
    words there; a text that holds the signs used for that is rewritten for
    each copy.
    Output: ``repo, patch_id`` (``<template>-<copy>``), ``template_id, copy,
    pair_old, pair_new, text``.
    """
    old, new = F.col("old"), F.col("new")
    clear = (F.instr("text", _OLD) == 0) & (F.instr("text", _NEW) == 0)
    places = F.when(clear, _rewritten(F.col("text"), old, new, F.lit(_OLD), F.lit(_NEW)))
    marked = templates.select("*", F.inline(F.array(F.struct(places.alias("marked")))))
    j = marked.join(pairs, "template_id")
    put = F.replace(F.replace(F.col("marked"), F.lit(_OLD), F.col("pair_old")), F.lit(_NEW), F.col("pair_new"))
    text = F.coalesce(put, _rewritten(F.col("text"), old, new, F.col("pair_old"), F.col("pair_new")))
    return j.select(
        "repo",
        F.concat(F.col("patch_id"), F.lit("-"), F.col("copy").cast("string")).alias("patch_id"),
        "template_id", "copy", "pair_old", "pair_new", text.alias("text"),
    )
