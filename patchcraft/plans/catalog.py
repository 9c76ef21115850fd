"""Query catalogue: every registered job over the shared test tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
match the DuckDB oracle of the same name (``oracle_sql.ORACLES``).  All
entries read whole tables; none caps rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import charset as CH
from ..operators import clean as C
from ..operators import collect as CO
from ..operators import comments as CM
from ..operators import dataset as D
from ..operators import diff as DF
from ..operators import interfaces as IF
from ..operators import linediff as LD
from ..operators import model as M
from ..operators import network as NET
from ..operators import pairing as PR
from ..operators import rename as R
from ..operators import seen as SE
from ..operators import select as S
from ..operators import tokens as TK
from ..operators import vocab as V
from ..session import shared_path
from ..sources import tables as TB
from ..sources.files import label_from_path

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn

    return deco


def _docs(spark, sf):
    return TB.read_texts(spark, sf)


def adapter_patches(spark: SparkSession, sf: str) -> DataFrame:
    return TB.patches_from_documents(_docs(spark, sf))


# ------------------------------------------------------------------ rename
@query("rename_verdicts")
def q_rename_verdicts(spark, sf):
    v = R.rename_verdicts(adapter_patches(spark, sf))
    return v.select("repo", "patch_id", "verdict", "n_renames", "message")


@query("verdict_counts")
def q_verdict_counts(spark, sf):
    return R.verdict_counts(R.rename_verdicts(adapter_patches(spark, sf)))


@query("code_verdicts")
def q_code_verdicts(spark, sf):
    return CM.code_verdicts(TB.commented_patches_from_documents(_docs(spark, sf)))


@query("code_patches")
def q_code_patches(spark, sf):
    return CM.code_patches(TB.commented_patches_from_documents(_docs(spark, sf)))


# ------------------------------------------------------------------ shared inputs

TRUNCATE_AT = 80
SPAWN_COPIES = 10
LIMIT_N = 20


def adapter_examples(spark, sf):
    """Labelled patches: adapter patch text of every labelled document."""
    # Joined by id first: only labelled documents become patches.
    labels = TB.read_table(spark, sf, "labels", spread=False).select("doc_id", F.col("quality").cast("int").alias("label"))
    return TB.patches_from_documents(_docs(spark, sf).join(labels, "doc_id"), keep=("label",)).select(
        F.concat_ws("/", "repo", F.when(F.col("label") == 1, "yes").otherwise("no"),
                    F.concat(F.col("patch_id"), F.lit(".diff"))).alias("path"),
        "label", "text", "n_bytes",
    )


def loaded(spark, sf):
    return D.load_examples(adapter_examples(spark, sf))


def adapter_combined(spark, sf):
    return TB.combined_from_documents(_docs(spark, sf))


def adapter_commits(spark, sf):
    return TB.commits_from_orders(TB.read_table(spark, sf, "orders"))


def adapter_changes(spark, sf):
    return TB.changes_from_lineitem(TB.read_table(spark, sf, "lineitem"))


def verdicts(spark, sf):
    return R.rename_verdicts(adapter_patches(spark, sf))


# ------------------------------------------------------------------ rename building blocks
@query("rename_map")
def q_rename_map(spark, sf):
    m = R.rename_map(adapter_patches(spark, sf))
    return m.select("repo", "patch_id", F.size("renames").cast("long").alias("n_renames"),
                    F.when(F.size("renames") > 0, T.rename_message("renames")).alias("message"))


def _all_changed(spark, sf):
    p = adapter_patches(spark, sf).withColumn("text", T.normalise_newlines("text"))
    return R.changed_lines_of(p)


@query("change_runs")
def q_change_runs(spark, sf):
    r = R.change_runs(_all_changed(spark, sf))
    return r.select("repo", "patch_id", F.col("run_start").cast("long").alias("run_start"),
                    F.col("run_removed").cast("long").alias("run_removed"),
                    F.col("run_added").cast("long").alias("run_added")).distinct()


@query("align_runs")
def q_align_runs(spark, sf):
    a = R.align_runs(R.change_runs(_all_changed(spark, sf)))
    return a.select("repo", "patch_id", F.col("pos").cast("long").alias("pos"), F.col("akey").cast("long").alias("akey"))


@query("pair_lines")
def q_pair_lines(spark, sf):
    p = R.pair_lines(R.align_runs(R.change_runs(_all_changed(spark, sf)))).where("is_pair")
    return p.select("repo", "patch_id", F.col("akey").cast("long").alias("ord"), "old_line", "new_line")


@query("pair_similar")
def q_pair_similar(spark, sf):
    """Runs with their pairs, told by how alike these are in all and whether they are in order."""
    runs = PR.pair_similar(TB.mixed_patches_from_documents(_docs(spark, sf)))
    at = lambda c: F.transform("pairs", lambda p: p[c])
    in_order = F.lit(True)
    for c in ("old_pos", "new_pos"):
        in_order = in_order & (F.size(F.array_distinct(at(c))) == F.size("pairs")) & (F.array_sort(at(c)) == at(c))
    total = F.aggregate("pairs", F.lit(0).cast("long"), lambda acc, p: acc + F.coalesce(p["likeness"], F.lit(0)))
    return runs.select(
        "repo", "patch_id", F.col("run_start").cast("long").alias("run_start"), F.col("n_removed").cast("long").alias("n_removed"),
        F.col("n_added").cast("long").alias("n_added"), "plain", total.alias("likeness"), in_order.alias("in_order"),
    )


@query("interface_verdicts")
def q_interface_verdicts(spark, sf):
    return IF.interface_verdicts(*TB.interface_changes_from_documents(_docs(spark, sf)))


@query("balanced_filter")
def q_balanced(spark, sf):
    c = R.with_cheap_checks(adapter_patches(spark, sf))
    return c.select("repo", "patch_id", F.col("n_removed").cast("long").alias("n_removed"),
                    F.col("n_added").cast("long").alias("n_added"),
                    (F.col("n_removed") == F.col("n_added")).alias("balanced"))


@query("package_filter")
def q_package(spark, sf):
    c = R.with_cheap_checks(adapter_patches(spark, sf))
    return c.select("repo", "patch_id", "has_package")


# ------------------------------------------------------------------ collect
@query("commit_filter")
def q_commit_filter(spark, sf):
    return CO.commit_filter(adapter_commits(spark, sf)).select("repo", "commit_id")


@query("java_change_filter")
def q_java_change_filter(spark, sf):
    return CO.java_change_filter(adapter_changes(spark, sf)).select("repo", "commit_id", F.col("ord").cast("long").alias("ord"), "a_path")


@query("decode_lenient")
def q_decode(spark, sf):
    ch = adapter_changes(spark, sf)
    return ch.select("repo", "commit_id", F.col("ord").cast("long").alias("ord"), "a_path", T.decode_lenient("patch").alias("text"))


@query("normalise_newlines")
def q_newlines(spark, sf):
    ch = adapter_changes(spark, sf)
    return ch.select("repo", "commit_id", F.col("ord").cast("long").alias("ord"), "a_path",
                     T.normalise_newlines(T.decode_lenient("patch")).alias("text"))


@query("normalise_eof_newline")
def q_eof(spark, sf):
    ch = adapter_changes(spark, sf)
    t = CO.normalise_eof_newline(T.normalise_newlines(T.decode_lenient("patch")))
    return ch.select("repo", "commit_id", F.col("ord").cast("long").alias("ord"), "a_path", t.alias("text"))


@query("assemble_commit_patch")
def q_assemble(spark, sf):
    return CO.assemble_commit_patch(adapter_changes(spark, sf))


@query("collect_patches")
def q_collect(spark, sf):
    return CO.collect_patches(adapter_commits(spark, sf), adapter_changes(spark, sf))


@query("mined_dataset")
def q_mined(spark, sf):
    """The whole chain: collect, clean, label, select, load and split the patches of all commits."""
    collected = CO.collect_patches(*TB.mined_from_documents(_docs(spark, sf))).where("not is_empty")
    cleaned = C.drop_empty_patches(C.clean_patches(collected), "cleaned")
    patches = cleaned.select("repo", F.col("commit_id").alias("patch_id"), F.col("cleaned").alias("text"), F.octet_length("cleaned").cast("long").alias("n_bytes"))
    # Read by labelling and by both ways of selecting: written once.
    folder = shared_path(spark, "mined", uuid.uuid4().hex)
    patches.write.parquet(f"{folder}/patches")
    patches = spark.read.schema(patches.schema).parquet(f"{folder}/patches")
    found = R.rename_verdicts(patches).select("repo", "patch_id", "verdict")
    found.write.parquet(f"{folder}/verdicts")
    chosen = S.select_examples(patches, spark.read.schema(found.schema).parquet(f"{folder}/verdicts"))
    path = F.concat_ws("/", "repo", F.when(F.col("label") == 1, "yes").otherwise("no"), F.concat("patch_id", F.lit(".diff")))
    return D.split_dataset(D.load_examples(chosen.select(path.alias("path"), "label", "text", "n_bytes"))).select("path", "label", "n_tokens", "split")


# ------------------------------------------------------------------ clean
@query("java_sections")
def q_java_sections(spark, sf):
    c = adapter_combined(spark, sf)
    return c.select("patch_id", C.java_sections("text").alias("text"))


@query("clean_patches")
def q_clean(spark, sf):
    c = C.clean_patches(adapter_combined(spark, sf))
    return c.select("patch_id", "cleaned", "lines_removed", "status")


@query("drop_empty_patches")
def q_drop_empty(spark, sf):
    c = C.clean_patches(adapter_combined(spark, sf))
    return C.drop_empty_patches(c, "cleaned").select("patch_id")


@query("strip_headers")
def q_strip(spark, sf):
    return C.strip_headers(adapter_combined(spark, sf)).select("patch_id", "text")


@query("require_hunk_start")
def q_hunk_start(spark, sf):
    c = C.clean_patches(adapter_combined(spark, sf)).select("patch_id", F.col("cleaned").alias("text"))
    return C.require_hunk_start(C.drop_empty_patches(c)).select("patch_id", "starts_with_hunk")


@query("convert_encoding")
def q_convert(spark, sf):
    e = C.convert_encoding(TB.encoded_documents(_docs(spark, sf)))
    return e.select("doc_id", "charset", "charset_used", "converted", (F.col("text_decoded") == F.col("text")).alias("restored"))


def _charsets(documents):
    """A model of the documents whose charset is taken as known: three quarters of them, by id."""
    samples = TB.charset_documents(documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0))
    return CH.charset_model(CH.fit_charsets(samples))


@query("detect_charset")
def q_detect_charset(spark, sf):
    docs = _docs(spark, sf)
    found = C.convert_encoding(TB.charset_documents(docs), model=_charsets(docs))
    return found.select("doc_id", "charset", "charset_used", (F.col("text_decoded") == F.col("text")).alias("restored"))


@query("clean_patch_bytes")
def q_clean_patch_bytes(spark, sf):
    """Combined patches as bytes of eleven charsets, from the bytes to the cleaned text."""
    docs = _docs(spark, sf)
    named = TB.charset_documents(docs)
    patches = TB.combined_from_documents(named.select("doc_id", "source", "text"))
    raw = TB.encoded_text(patches.join(named.select(F.col("doc_id").cast("string").alias("patch_id"), "charset"), "patch_id"))
    cleaned = C.clean_patch_bytes(raw.drop("text"), model=_charsets(docs))
    return cleaned.select("patch_id", "charset_used", "cleaned", "lines_removed", "status")


# ------------------------------------------------------------------ examples and tokens
@query("load_examples")
def q_load(spark, sf):
    l = loaded(spark, sf)
    return l.select("path", "label", "n_tokens", D.join_tokens("tokens").alias("tokens"))


@query("label_from_path")
def q_label_from_path(spark, sf):
    e = adapter_examples(spark, sf).withColumn("label_dir", F.element_at(F.split("path", "/"), -2))
    return label_from_path(e).select("path", F.col("label").cast("int").alias("label"))


@query("standardise_numbers")
def q_standardise(spark, sf):
    e = adapter_examples(spark, sf)
    return e.select("path", T.standardise_numbers("text").alias("text"))


@query("tokenise")
def q_tokenise(spark, sf):
    e = adapter_examples(spark, sf)
    t = T.tokenise(T.standardise_numbers("text"))
    return e.select("path", F.size(t).cast("long").alias("n_tokens"), D.join_tokens(t).alias("tokens"))


@query("split_tokens")
def q_split_tokens(spark, sf):
    l = loaded(spark, sf)
    back = D.split_tokens(D.join_tokens("tokens"))
    return l.select("path", F.size(back).cast("long").alias("n_pieces"))


@query("class_counts")
def q_class_counts(spark, sf):
    return D.class_counts(loaded(spark, sf))


@query("row_count")
def q_row_count(spark, sf):
    return loaded(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"))


@query("max_sequence_length")
def q_max_seq(spark, sf):
    return D.max_sequence_length(loaded(spark, sf))


@query("class_filter")
def q_class_filter(spark, sf):
    return loaded(spark, sf).where(F.col("label") == 1).select("path")


@query("select_column")
def q_select_column(spark, sf):
    return loaded(spark, sf).select(D.join_tokens("tokens").alias("tokens"), "label")


@query("union_examples")
def q_union(spark, sf):
    l = loaded(spark, sf)
    return l.where("label = 1").unionByName(l.where("label = 0")).select("path", "label")


@query("sort_paths")
def q_sort_paths(spark, sf):
    return loaded(spark, sf).select("path").orderBy("path")


@query("ngrams")
def q_ngrams(spark, sf):
    g = TK.ngrams("tokens", 2)
    return loaded(spark, sf).select("path", F.size(g).cast("long").alias("n_ngrams"),
                                    F.md5(F.array_join(g, "\u0001")).alias("ngrams_md5"))


@query("token_frequency")
def q_token_frequency(spark, sf):
    return TK.token_frequency(loaded(spark, sf))


@query("top_k_tokens")
def q_top_k(spark, sf):
    l = loaded(spark, sf).select(TK.ngrams("tokens", 2).alias("tokens"))
    return TK.top_k_tokens(TK.token_frequency(l))


@query("token_ids")
def q_token_ids(spark, sf):
    g = loaded(spark, sf).select("path", TK.ngrams("tokens", 2).alias("tokens"))
    ids = TK.token_ids(g, TK.top_k_tokens(TK.token_frequency(g)))
    return ids.select("path", F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids_md5"),
                      F.size("ids").cast("long").alias("n_ids"), "n_unknown")


@query("vocabulary_report")
def q_vocab_report(spark, sf):
    return TK.vocabulary_report(loaded(spark, sf))


@query("truncate_line")
def q_truncate(spark, sf):
    return TK.truncation_counts(adapter_examples(spark, sf), "text", TRUNCATE_AT)


# ------------------------------------------------------------------ ranks and splits
@query("seeded_rank")
def q_seeded_rank(spark, sf):
    return D.seeded_rank(loaded(spark, sf), "path").select("path", "rank")


@query("holdout_take_skip")
def q_holdout(spark, sf):
    l = loaded(spark, sf)
    n = l.count()
    v, rest = D.holdout_take_skip(D.seeded_rank(l, "path"), n)
    return v.select("path", F.lit("validation").alias("split")).unionByName(rest.select("path", F.lit("rest").alias("split")))


@query("balance_classes")
def q_balance(spark, sf):
    l = loaded(spark, sf)
    n = l.count()
    _, rest = D.holdout_take_skip(D.seeded_rank(l, "path"), n)
    return D.balance_classes(rest.drop("rank")).select("path", "label")


@query("split_dataset")
def q_split(spark, sf):
    return D.split_dataset(loaded(spark, sf)).select("path", "label", "split")


@query("train_test_split")
def q_train_test(spark, sf):
    return D.split_dataset(loaded(spark, sf)).where("split in ('train', 'test')").select("path", "split")


@query("stability_check")
def q_stability(spark, sf):
    return D.stability_check(lambda: D.split_dataset(loaded(spark, sf)))


@query("cache_dataset")
def q_cache(spark, sf):
    return D.class_counts(D.cache_dataset(loaded(spark, sf)))


# ------------------------------------------------------------------ vocabulary
@query("extract_identifiers")
def q_identifiers(spark, sf):
    p = adapter_patches(spark, sf)
    return p.select("repo", "patch_id", F.explode(V.extract_identifiers("text")).alias("word"))


@query("extract_short_identifiers")
def q_short_identifiers(spark, sf):
    p = adapter_patches(spark, sf)
    return p.select("repo", "patch_id", F.explode(V.extract_short_identifiers("text")).alias("word"))


@query("keyword_minus")
def q_keyword_minus(spark, sf):
    p = adapter_patches(spark, sf)
    words = F.array_distinct(F.filter(T.words_only("text"), lambda w: w.rlike(r"^[A-Za-z_]")))
    return p.select("repo", "patch_id", F.size(words).cast("long").alias("n_words"),
                    F.size(V.keyword_minus(words)).cast("long").alias("n_identifiers"))


@query("distinct_words")
def q_distinct_words(spark, sf):
    return V.distinct_words(adapter_patches(spark, sf))


@query("build_vocabulary")
def q_build_vocab(spark, sf):
    return V.build_vocabulary(adapter_patches(spark, sf))


@query("seed_letters_union")
def q_seed_letters(spark, sf):
    v = V.build_vocabulary(adapter_patches(spark, sf))
    return v.where(F.length("word") == 1)


@query("sort_vocabulary")
def q_sort_vocab(spark, sf):
    return V.sort_vocabulary(V.build_vocabulary(adapter_patches(spark, sf)))


def _templates(spark, sf):
    return V.spawn_templates(adapter_patches(spark, sf))


@query("vocabulary_minus")
def q_vocab_minus(spark, sf):
    vocab = V.build_vocabulary(adapter_patches(spark, sf))
    tw = _templates(spark, sf).select(F.explode("words").alias("word"))
    return V.vocabulary_minus(vocab, tw)


@query("exact_dedup")
def q_dedup(spark, sf):
    return V.exact_dedup(_docs(spark, sf), "text", "doc_id")


@query("dedup_by_batches")
def q_dedup_by_batches(spark, sf):
    """Documents in two batches, the second one also without the texts of the first."""
    index = SE.SeenTexts(spark, shared_path(spark, "seen", uuid.uuid4().hex))
    docs = _docs(spark, sf).select("doc_id", "text")
    found = []
    for batch in (0, 1):
        path = shared_path(spark, "seen", uuid.uuid4().hex)
        index.unseen(docs.where(F.col("doc_id") % 2 == batch), "text", "doc_id").write.parquet(path)
        kept = spark.read.schema(docs.schema).parquet(path)
        index.add(kept, "text", f"batch-{batch}")
        found.append(kept.select("doc_id", F.lit(batch).alias("batch_no"), F.md5("text").alias("text_md5")))
    return found[0].unionByName(found[1])


@query("sample_pairs")
def q_sample_pairs(spark, sf):
    patches = adapter_patches(spark, sf).persist()
    vocab = V.build_vocabulary(patches)
    pairs = V.sample_pairs(vocab, V.spawn_templates(patches).persist(), SPAWN_COPIES)
    return pairs.select("template_id", F.col("copy").cast("long").alias("copy"), "pair_old", "pair_new")


@query("spawn_patches")
def q_spawn(spark, sf):
    # Patches and templates feed several branches (vocabulary, templates,
    # exclusions); one materialisation each instead of one per branch.
    patches = adapter_patches(spark, sf).persist()
    t = V.spawn_templates(patches).persist()
    sp = V.spawn_patches(t, V.sample_pairs(V.build_vocabulary(patches), t, SPAWN_COPIES))
    return sp.select("repo", "patch_id", "template_id", "pair_old", "pair_new",
                     F.octet_length("text").cast("long").alias("n_bytes"))


@query("spawn_relabel_check")
def q_spawn_relabel(spark, sf):
    """Every spawned copy must re-label to exactly its drawn pair (``relabel_ok``)."""
    patches = adapter_patches(spark, sf).persist()
    t = V.spawn_templates(patches).persist()
    sp = V.spawn_patches(t, V.sample_pairs(V.build_vocabulary(patches), t, SPAWN_COPIES)).persist()
    relabel = R.rename_map(sp.select("repo", "patch_id", "text"), keep_rejected=True)
    want = F.array(F.struct(F.col("pair_old").alias("old"), F.col("pair_new").alias("new")))
    return sp.join(relabel, ["repo", "patch_id"]).groupBy("template_id").agg(
        F.count(F.lit(1)).alias("n_copies"),
        F.bool_and(F.coalesce(F.col("renames") == want, F.lit(False))).alias("relabel_ok"),
    )


# ------------------------------------------------------------------ diffs
@query("changed_lines")
def q_changed_lines(spark, sf):
    return DF.changed_lines(TB.versions_from_documents(_docs(spark, sf)))


def _revisions(spark, sf):
    return TB.revisions_from_documents(_docs(spark, sf))


def _count(script, sign):
    return F.size(F.filter(script, lambda s: s["sign"] == sign)).cast("long")


@query("line_diff")
def q_line_diff(spark, sf):
    """The script of every pair, told by its size and by the two texts that it holds."""
    pairs = _revisions(spark, sf).select("pair_id", *[F.split(c, "\n", -1).alias(f"{c}_lines") for c in ("old", "new")])
    script = F.col("script")
    side = lambda sign: F.md5(F.array_join(F.transform(F.filter(script, lambda s: s["sign"] != sign), lambda s: s["line"]), "\n"))
    return LD.with_script(pairs).select(
        "pair_id", _count(script, " ").alias("n_kept"), _count(script, "-").alias("n_removed"), _count(script, "+").alias("n_added"),
        side("+").alias("old_md5"), side("-").alias("new_md5"),
    )


@query("moved_lines")
def q_moved_lines(spark, sf):
    moved = LD.moved_lines(LD.line_script(_revisions(spark, sf)))
    return moved.groupBy("pair_id").agg(F.sum("n_moved").alias("n_moved"))


@query("unified_hunks")
def q_unified_hunks(spark, sf):
    """A patch of every pair, told by what applying and undoing it gives and by its changed lines."""
    pairs = _revisions(spark, sf).select("pair_id", LD.text_lines("old").alias("old_lines"), LD.text_lines("new").alias("new_lines"))
    patched = LD.apply_patch(LD.with_patch(pairs))
    undone = LD.apply_patch(patched, lines="new_lines", out="undone_lines", reverse=True)
    lines = lambda sign: F.regexp_count("patch", F.lit("(?md)^" + sign)).cast("long")
    return undone.select(
        "pair_id", lines("-").alias("n_removed"), lines(r"\+").alias("n_added"),
        F.md5(LD.lines_text("patched_lines")).alias("patched_md5"), F.md5(LD.lines_text("undone_lines")).alias("undone_md5"),
    )


@query("rediff_changes")
def q_rediff_changes(spark, sf):
    """Patches of changes whose contents lack a last newline, made again from the contents and applied to the old one."""
    changes = CO.java_change_filter(TB.blob_changes_from_documents(_docs(spark, sf)))
    texts = CO.change_texts(changes.withColumn("rediffed", CO.has_marker()))
    old = F.when(F.col("rediffed"), LD.text_lines(T.normalise_newlines(T.decode_lenient("a_blob"))))
    applied = LD.apply_patch(texts.withColumn("old_lines", old), "text")
    lines = lambda sign: F.when(F.col("rediffed"), F.regexp_count("text", F.lit("(?md)^" + sign))).cast("long")
    return applied.select(
        "repo", "commit_id", "rediffed", F.contains("text", F.lit(fixed.NO_EOF_NEWLINE_MARKER)).alias("has_marker"),
        lines("-").alias("n_removed"), lines(r"\+").alias("n_added"), F.md5(LD.lines_text("patched_lines")).alias("patched_md5"),
    )


@query("synthetic_edits")
def q_synthetic(spark, sf):
    e = DF.synthetic_edits(_docs(spark, sf), "doc_id", "text", variants=20)
    e = e.withColumn("pair_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("variant").cast("string"), "choice"))
    return DF.changed_lines(e)


# ------------------------------------------------------------------ selection
@query("select_by_verdict")
def q_select_by_verdict(spark, sf):
    return S.select_by_verdict(adapter_patches(spark, sf), verdicts(spark, sf)).select("repo", "patch_id", "label")


@query("presumed_negatives")
def q_presumed(spark, sf):
    return S.presumed_negatives(adapter_patches(spark, sf), verdicts(spark, sf)).select("repo", "patch_id")


@query("size_filter")
def q_size_filter(spark, sf):
    p = adapter_patches(spark, sf)
    return p.where(F.col("n_bytes") <= 5 * 1024).select("repo", "patch_id", "n_bytes")


@query("select_examples")
def q_select_examples(spark, sf):
    return S.select_examples(adapter_patches(spark, sf), verdicts(spark, sf)).select("repo", "patch_id", "label", "origin")


@query("verdict_lines")
def q_verdict_lines(spark, sf):
    return S.verdict_lines(verdicts(spark, sf)).select("repo", "line")


# ------------------------------------------------------------------ evaluation (rule-based predictions for the oracle)
def rule_predictions(spark, sf):
    """Validation rows with a fixed rule as prediction (long patches -> 1)."""
    s = D.split_dataset(loaded(spark, sf)).where("split = 'validation'")
    return s.select("path", "label", (F.col("n_tokens") > 500).cast("int").alias("prediction"))


@query("confusion_matrix")
def q_confusion(spark, sf):
    return M.confusion_matrix(rule_predictions(spark, sf))


@query("error_rates")
def q_error_rates(spark, sf):
    return M.error_rates(rule_predictions(spark, sf))


@query("sort_errors")
def q_sort_errors(spark, sf):
    return M.sort_errors(rule_predictions(spark, sf)).select("path", "label", "prediction")


@query("evaluate")
def q_evaluate(spark, sf):
    s = D.split_dataset(loaded(spark, sf))
    model, _ = M.train_classifier(s.where("split = 'train'"), s.where("split = 'test'"), iterations=(10,))
    return M.predict(model, s.where("split = 'validation'"))


@query("adapter_patches")
def q_adapter_patches(spark, sf):
    """The derived patch table itself (input of every rename job)."""
    return adapter_patches(spark, sf).select("repo", "patch_id", "text", "n_bytes")


@query("join_tokens")
def q_join_tokens(spark, sf):
    return loaded(spark, sf).select("path", D.join_tokens("tokens").alias("joined"))


@query("limit_n")
def q_limit_n(spark, sf):
    """The first LIMIT_N presumed negatives of at most 5 KB per repository (the limits are the feature)."""
    found = S.presumed_negatives(adapter_patches(spark, sf), verdicts(spark, sf), max_bytes=5 * 1024, n=LIMIT_N)
    return found.select("repo", "patch_id", "label")


@query("load_examples_capped")
def q_load_capped(spark, sf):
    """What a limit of 10 KB would leave out (the limit is the feature)."""
    return D.load_report(adapter_examples(spark, sf), max_file_kb=10)


@query("accuracy")
def q_accuracy(spark, sf):
    return M.error_rates(rule_predictions(spark, sf)).select("n", "n_wrong", "accuracy")


@query("train_classifier")
def q_train(spark, sf):
    s = D.split_dataset(loaded(spark, sf))
    _, history = M.train_classifier(s.where("split = 'train'"), s.where("split = 'test'"), iterations=(5, 10))
    return history


def _trained_network(spark, sf):
    s = D.split_dataset(loaded(spark, sf)).select("path", "label", "tokens", "split")
    net, history = NET.train_network(s.where("split = 'train'"), s.where("split = 'test'"))
    return net, history, s.where("split = 'validation'")


@query("train_network")
def q_train_network(spark, sf):
    """Loss and test accuracy of every epoch of the embedding network."""
    return _trained_network(spark, sf)[1]


@query("evaluate_network")
def q_evaluate_network(spark, sf):
    """Matrix, accuracy and the larger class's share of the trained network on the validation examples."""
    net, _, validation = _trained_network(spark, sf)
    return M.report(NET.predict_network(net, validation))


@query("network_errors")
def q_network_errors(spark, sf):
    """The validation examples that the trained network gets wrong, by path."""
    net, _, validation = _trained_network(spark, sf)
    return M.sort_errors(NET.predict_network(net, validation))
