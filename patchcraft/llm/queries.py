"""Registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, kneser, langid, lines, merkle, mixing, negatives, packing, quality, simhash, suffix, token_counts
from .common import read_docs, ship

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
#: Tokenizer files of the queries; a parameter of every operator.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(name: str):
    def register(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return run

    return register


@query("op1_quality_rules")
def op1(spark, sf_dir):
    base, full = quality.passes("base-1"), quality.passes("full-1")
    entries = quality.ledger(read_docs(spark, sf_dir))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base).alias("base_failed"), full.alias("kept"), "n_lines", "n_capitals", "failures",
    )


@query("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    return simhash.simhash_near_dedup(read_docs(spark, sf_dir))


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    return kneser.quality_classifier(read_docs(spark, sf_dir), read_docs(spark, sf_dir, "labels"))


@query("op4_suffix_array_dedup")
def op4(spark, sf_dir):
    done = suffix.remove_repeats(read_docs(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_exact_dedup")
def op5(spark, sf_dir):
    return exact.exact_dedup(read_docs(spark, sf_dir))


@query("op6_bpe_round_trip")
def op6(spark, sf_dir):
    return bpe.encode_documents(read_docs(spark, sf_dir), BYTE_BPE, digest=True)


@query("op7_token_counts")
def op7(spark, sf_dir):
    docs = read_docs(spark, sf_dir)
    # Three edits of each document: a cut at a third, its own beginning put into the middle, a word at its end.
    n = F.length(F.coalesce("text", F.lit("")))
    third, half = F.floor(n / 3), F.floor(n / 2)
    edit = lambda start, stop, new: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), new.alias("new"))
    edits = F.array(edit(third, third + 7, F.lit("")), edit(half, half, F.substring("text", 1, 40)), edit(n + 33, n + 33, F.lit(" end.")))
    counted = token_counts.count_with_edits(docs, edits, BYTE_BPE)
    return counted.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_read")


@query("op8_best_fit_packing")
def op8(spark, sf_dir):
    return packing.pack_documents(read_docs(spark, sf_dir), WORD_BPE)


@query("op9_language_id")
def op9(spark, sf_dir):
    return langid.language_id(read_docs(spark, sf_dir))


@query("op10_line_dedup")
def op10(spark, sf_dir):
    pages = lines.line_dedup(read_docs(spark, sf_dir, "pages"))
    return pages.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op11_mix_sources")
def op11(spark, sf_dir):
    mixed = mixing.mix(read_docs(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


@query("op12_hard_negatives")
def op12(spark, sf_dir):
    rows = read_docs(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


@query("op13_merkle_manifest")
def op13(spark, sf_dir):
    docs = read_docs(spark, sf_dir)
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = merkle.one_more(fields, "n_chars", F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    proved = merkle.manifest(docs, fields, shown=tampered)
    return proved.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
