"""Adapters from the shared test tables to the patch data model.

The test data has no patch tables, so each adapter derives one from whole
rows of the given tables (every document, every order, every line item), with
functions DuckDB shares (md5, split, modulo, regex tokens).  All adapters are
row-local projections: no shuffle.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import fixed
from ..functions import text as T


#: A table of fewer bytes than this is spread over the cores.
SPREAD_BELOW = 64 << 20
#: Bytes of texts that one task works on, about; texts are dealt anew where a part of the file holds over twice as many.
TEXT_PART = 16 << 20


def _size(df: DataFrame) -> int:
    """Bytes by Spark's own estimate."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _largest_part(df: DataFrame) -> float:
    """The share of all rows that the largest part of the files holds, as tasks read them.

    A row group is read whole by one task, so parts may differ much from the
    sizes that files are split by.  Only rows are counted, no column is read.
    """
    rows = df.select(F.spark_partition_id().alias("part")).groupBy("part").count()
    found = rows.agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    return found["most"] / found["all"] if found["all"] else 0.0


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """Read a table; a small one (under SPREAD_BELOW bytes, by Spark's own estimate) is spread over the cores.

    Such a table may be a single row group, which one task would scan and
    process alone.  Larger tables are not exchanged before their first
    operator.  ``spread=False`` for the smaller side of a join, whose few
    partitions the larger side would else be dealt to.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if spread and _size(df) < SPREAD_BELOW:
        df = df.repartition(spark.sparkContext.defaultParallelism, df.columns[0])
    return df


def read_texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """``read_table`` of texts that are worked on for long: in parts whose number grows with the table, whatever its files and row groups."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    size = _size(df)
    if size < SPREAD_BELOW:
        return read_table(spark, sf_dir, name)
    if _largest_part(df) * size > 2 * TEXT_PART:
        df = df.repartition(max(spark.sparkContext.defaultParallelism, -(-size // TEXT_PART)), df.columns[0])
    return df


# ------------------------------------------------------------------ patches
def _with_rename_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``w1, w2, w3``: the first three distinct words starting with a letter.

    The words come out of a one-row generator (``inline``).  Later lambdas
    refer to them per token; a generator output cannot be substituted back by
    filter push-down or project collapsing, which would otherwise re-tokenise
    the whole text for every token of every line.
    """
    letters = F.regexp_extract_all(F.col(text), F.lit(fixed.LETTER_WORD_RE), F.lit(1))
    df = df.withColumn("_letters", letters)
    df = df.withColumn("_w1", F.try_element_at("_letters", F.lit(1)))
    df = df.withColumn("_rest", F.filter("_letters", lambda t: t != F.col("_w1")))
    df = df.withColumn("_w2", F.try_element_at("_rest", F.lit(1)))
    df = df.withColumn("_w3", F.try_element_at(F.filter("_rest", lambda t: t != F.col("_w2")), F.lit(1)))
    keep = [c for c in df.columns if not c.startswith("_")]
    words = F.array(F.struct(F.col("_w1").alias("w1"), F.col("_w2").alias("w2"), F.col("_w3").alias("w3")))
    return df.select(*keep, F.inline(words))


def _renamed_line(line: Column, idx: Column, case: Column, w1, w2, w3) -> Column:
    """The '+' side of a line: word-level substitution chosen by ``case``."""
    # The words are maximal runs of letters, digits and ``_``, so they stand in a pattern as they are.
    words = F.when(case == 1, F.concat_ws("|", w1, w2)).when(case == 2, F.concat_ws("|", w1, w2, w3)).otherwise(w1)
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), words, F.lit(r")(?![\p{L}\p{N}_])"))
    suffix = F.when((case == 3) & (idx % 2 != 0), "$0_2").otherwise("$0_1")

    # Lines containing none of the words (as substrings) cannot change, so
    # they skip the search; the result is the same either way.
    def within(word: Column) -> Column:
        return F.coalesce(F.instr(line, word), F.lit(0)) > 0

    touched = case.isin(0, 1, 2, 3, 4, 5, 7) & (within(w1) | (case.isin(1, 2) & within(w2)) | ((case == 2) & within(w3)))
    new = F.when(touched, F.regexp_replace(line, whole, suffix)).otherwise(line)
    return F.when(case == 4, F.concat(new, F.lit(" "))).otherwise(new)


def patches_from_documents(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One patch per document: every non-empty line becomes a ``-old``/``+new`` pair.

    ``doc_id % 8`` picks the edit: 0 rename one word, 1 two words, 2 three
    words, 3 one word to two names (even/odd lines), 4 rename plus trailing
    space, 5 rename plus a package line, 6 identical pairs, 7 the case-0 edit
    written as one block of removals followed by the additions.
    Output: ``repo, patch_id, text, n_bytes`` and the ``keep`` columns of the
    documents.  The text comes out of a one-row generator, so that rules on it
    do not each build it again.
    """
    text = F.col("text")
    case = F.col("case")
    # The three words are computed once per document as columns; inlining them
    # into the per-token lambda would rescan the whole text for every token.
    w1, w2, w3 = F.col("w1"), F.col("w2"), F.col("w3")
    lines = F.col("lines")
    pairs = F.transform(
        lines,
        lambda l, i: F.concat(
            F.lit("-"), l, F.lit("\n+"), _renamed_line(l, i, case, w1, w2, w3)
        ),
    )
    minus = F.transform(lines, lambda l: F.concat(F.lit("-"), l))
    plus = F.transform(lines, lambda l, i: F.concat(F.lit("+"), _renamed_line(l, i, case, w1, w2, w3)))
    header = F.lit(fixed.HUNK_PREFIX + " -1 +1 " + fixed.HUNK_PREFIX + "\n")
    body = (
        F.when(
            case == 7,
            F.concat(F.array_join(minus, "\n"), F.lit("\n"), F.array_join(plus, "\n"), F.lit("\n x\n")),
        )
        .when(case == 5, F.concat(F.array_join(pairs, "\n"), F.lit("\n-package a.b;\n+package a.c;\n")))
        .otherwise(F.concat(F.array_join(pairs, "\n"), F.lit("\n")))
    )
    patch = F.concat(header, body)
    prepared = _with_rename_words(
        documents.select(
            "doc_id", "source", "text", *keep,
            (F.col("doc_id") % 8).cast("int").alias("case"),
            F.filter(F.split(text, "\n", -1), lambda l: l != "").alias("lines"),
        )
    )
    return prepared.select(
        F.col("source").alias("repo"),
        F.col("doc_id").cast("string").alias("patch_id"),
        *keep,
        F.inline(F.array(F.struct(patch.alias("text")))),
    ).select("repo", "patch_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), *keep)


def commented_patches_from_documents(documents: DataFrame) -> DataFrame:
    """One patch per document that edits comments, code, or both; its lines stand in comments or strings.

    ``doc_id % 6``: 0 the comment behind a line, 1 the lines of a docstring,
    2 new block comments, 3 a rename beside an edited comment, 4 a rename
    beside strings that look like comments, 5 a hunk that begins inside a
    comment, then a rename beside a comment.  Output: ``repo, patch_id, text``.
    """
    case = F.col("doc_id") % 6
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda l: l != "")

    def around(*parts: str) -> Column:
        """Every line between the given pieces."""
        return F.transform(lines, lambda l: F.concat(*[x for part in parts for x in (F.lit(part), l)][:-1]))

    def text(*parts: Column | str) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.array(F.lit(p)) for p in parts])

    body = (
        F.when(case == 0, text(around("-", " // one\n+", " // two")))
        .when(case == 1, text(" /**", around("- * ", "\n+ * ", " more"), " */", " int a;"))
        .when(case == 2, text(around("+/* ", "\n+ more */\n ", "")))
        .when(case == 3, text(around("-int alpha = 1; /* ", " */\n+int beta = 1; /* other ", " */")))
        .when(case == 4, text(around('-String s = "// ', '" + x;\n+String s = "// ', '" + y;')))
        .otherwise(text(around("- ", "\n+ ", " edited"), " */", around("-int b; // ", "\n+int c; //", "")))
    )
    head = F.lit("@@ -1 +1 @@\n")
    return documents.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("patch_id"), F.concat(head, F.array_join(body, "\n"), F.lit("\n")).alias("text"))


def mixed_patches_from_documents(documents: DataFrame) -> DataFrame:
    """One patch per document whose runs have unequal and mixed removals and additions.

    Line i of a document (of its non-empty lines, from 0) is, by
    ``(i + doc_id) % 7``: 0 removed and added with a word more, 1 removed,
    2 added with a word in front, 3 added with a sign more and then removed, 4 removed, then two
    additions, 5 a removal and one of twice the line, 6 a context line that ends
    the run.  Output: ``repo, patch_id, text``.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda l: l != "")

    def changed(l: Column, i: Column) -> Column:
        k = (i + F.col("doc_id")) % 7
        made = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return (
            F.when(k == 0, made("-", l, "\n+", l, " edited"))
            .when(k == 1, made("-", l))
            .when(k == 2, made("+new ", l))
            .when(k == 3, made("+", l, "!\n-", l))
            .when(k == 4, made("-", l, "\n+other line\n+", l, " again"))
            .when(k == 5, made("-", l, "\n-", l, " ", l))
            .otherwise(made(" ", l))
        )

    text = F.concat(F.lit("@@ -1 +1 @@\n"), F.array_join(F.transform(lines, changed), "\n"), F.lit("\n"))
    return documents.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("patch_id"), text.alias("text"))


def interface_changes_from_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed files and all files of repositories: a commit of an interface and a class for every document.

    Both rename the method ``do_<first word>``.  ``doc_id % 6`` decides about
    the class: 0 implements the interface, 1 implements one that extends it
    and does not change, 2 implements none, 3 implements it and renames a
    variable too, 4 implements it but only a constant of the interface is
    renamed, 5 names it in a comment.  The document's lines are comments.
    Output: ``changes(repo, commit_id, path, text, source)``, ``files(repo, source)``.
    """
    k = F.col("doc_id") % 6
    name = F.concat(F.lit("do_"), F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda l: l != "")
    notes = F.array_join(F.transform(lines, lambda l: F.concat(F.lit("// "), l, F.lit("\n"))), "")
    context = F.array_join(F.transform(lines, lambda l: F.concat(F.lit(" // "), l, F.lit("\n"))), "")
    d = F.col("doc_id").cast("string")
    made = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    step = documents.select("source", d.alias("d"), k.alias("k"), F.inline(F.array(F.struct(name.alias("m"), notes.alias("notes"), context.alias("context")))))
    d, k, m = F.col("d"), F.col("k"), F.col("m")
    head = made("@@ -1 +1 @@\n", F.col("context"))
    declared = made("-  void ", m, "(int a);\n+  void ", m, "_r(int a);\n")
    iface = (
        made("src/I", d, ".java"), made(head, F.when(k == 4, "-  int LEAST = 1;\n+  int MOST = 1;\n").otherwise(declared)),
        made(F.col("notes"), "public interface I", d, " extends Base {\n  int LEAST = 1;\n  void ", m, "(int a);\n}\n"),
    )
    heading = made(
        "class C", d,
        F.when(k.isin(0, 3, 4), made(" implements I", d)).when(k == 1, made(" implements J", d))
        .when(k == 5, made(" /* implements I", d, " */")).otherwise(""),
        " {\n",
    )
    own = made(head, "-  public void ", m, "(int a) {\n+  public void ", m, "_r(int a) {\n", F.when(k == 3, "-    int old_v;\n+    int new_v;\n").otherwise(""))
    cls = (made("src/C", d, ".java"), own, made(F.col("notes"), heading, "  public void ", m, "(int a) {\n    int old_v;\n  }\n}\n"))
    files = [F.struct(path.alias("path"), text.alias("text"), source.alias("source")) for path, text, source in (iface, cls)]
    changes = step.select(F.col("source").alias("repo"), F.md5("d").alias("commit_id"), F.inline(F.array(*files)))
    between = step.select(F.col("source").alias("repo"), made("interface J", d, " extends I", d, " { }").alias("source"))
    return changes, changes.select("repo", "source").unionByName(between)


def mined_from_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits and their changed files, whose patches are those of ``patches_from_documents``.

    A commit for every document; ``doc_id % 9 = 8`` are merges, the files of
    ``doc_id % 10 = 9`` are no Java.  Output: ``commits``, ``changes``.
    """
    patches = patches_from_documents(documents.select("doc_id", "source", "text"), keep=("doc_id",))
    d = F.col("doc_id")
    commits = documents.select(
        F.col("source").alias("repo"), d.cast("string").alias("commit_id"),
        F.when(d % 9 == 8, F.array(F.lit("p"), F.lit("q"))).otherwise(F.array(F.lit("p"))).alias("parents"),
    )
    path = F.concat(F.lit("src/D"), F.col("patch_id"), F.when(d % 10 == 9, ".md").otherwise(".java"))
    changes = patches.select(
        "repo", F.col("patch_id").alias("commit_id"), F.lit(1).alias("ord"), path.alias("a_path"), path.alias("b_path"), F.encode("text", "UTF-8").alias("patch")
    )
    return commits, changes


def examples_from_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents: quality 1 = yes, 0 = no; ``path`` is the document id.

    Output: ``path, label, text, n_bytes``.  The join is on the document key;
    labels is the smaller side but not bounded, so no broadcast is forced.
    """
    return documents.join(labels, "doc_id").select(
        F.format_string("%s/%s/%d.diff", F.col("source"),
                        F.when(F.col("quality") == 1, "yes").otherwise("no"),
                        F.col("doc_id")).alias("path"),
        F.col("quality").cast("int").alias("label"),
        F.col("text"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )


def combined_from_documents(documents: DataFrame) -> DataFrame:
    """Combined (multi-file) patches in git form, one per document.

    Two sections per document; the extension of each comes from the id
    (``java``, ``md``, ``JAVA``), the second section of every fifth document
    has no hunk (a new empty file), and every seventh document is written
    without git headers at all.
    Output: ``patch_id, text``.
    """
    d = F.col("doc_id")
    exts = F.array(F.lit("java"), F.lit("md"), F.lit("JAVA"))
    ext_a = F.element_at(exts, (d % 3 + 1).cast("int"))
    ext_b = F.element_at(exts, ((d + 1) % 3 + 1).cast("int"))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda l: l != "")
    hunk = F.concat(
        F.lit("@@ -1 +1 @@\n"), F.array_join(F.transform(lines, lambda l: F.concat(F.lit("+"), l)), "\n"),
        F.lit("\n"),
    )

    def section(name: Column, with_hunk: Column) -> Column:
        path = F.concat(F.col("source"), F.lit("/"), name)
        head = F.concat(
            F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nindex 0000000..1111111 100644\n"),
        )
        full = F.concat(head, F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), hunk)
        bare = F.concat(head, F.lit("new file mode 100644\n"))
        return F.when(with_hunk, full).otherwise(bare)

    name_a = F.concat(d.cast("string"), F.lit("."), ext_a)
    name_b = F.concat(d.cast("string"), F.lit("_b."), ext_b)
    git = F.concat(section(name_a, F.lit(True)), section(name_b, d % 5 != 0))
    text = F.when(d % 7 == 0, hunk).otherwise(git)
    return documents.select(d.cast("string").alias("patch_id"), text.alias("text"))


# ------------------------------------------------------------------ commits
def _repos(order_key: str) -> Column:
    """One row for each repository with the commit of this order."""
    k = F.col(order_key)
    main = F.concat(F.lit("repo-"), (k % 5).cast("string"))
    return F.explode(F.when(k % 7 == 0, F.array(main, F.lit("repo-fork"))).otherwise(F.array(main))).alias("repo")


def commits_from_orders(orders: DataFrame) -> DataFrame:
    """Orders as commits: repo from the key, parents from status+priority.

    Root commits (no parent), merges (two) and octopus merges (three) occur.
    Every seventh order is also a commit, of the same id, of ``repo-fork``.
    Output: ``repo, commit_id, parents ARRAY<STRING>``.
    """
    k = F.col("o_orderkey")
    n_parents = (
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"), 0)
        .when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), 2)
        .when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), 3)
        .otherwise(1)
    )
    candidates = F.array(*[F.md5((k - i).cast("string")) for i in (1, 2, 3)])
    return orders.select(
        _repos("o_orderkey"),
        F.md5(k.cast("string")).alias("commit_id"),
        F.slice(candidates, 1, n_parents).alias("parents"),
    )


def changes_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Line items as changed files of the commit ``md5(l_orderkey)``.

    Path ``src/P<partkey>`` + ``.java`` (flag N), ``.JAVA`` (A) or ``.md`` (R);
    a new file has no old path (discount 0), a deleted one no new path (tax 0).
    Patches: empty when quantity < 4; CRLF line ends when line status is O;
    a missing newline at end of file when quantity is a multiple of 5, as the
    only change (1 mod 3), below a run of other changes (2 mod 3) or
    after a hunk whose removed and added line are the same (0 mod 3); one
    invalid UTF-8 byte when quantity is a multiple of 7.  A fork changes other
    names.
    Output: ``repo, commit_id, ord, a_path, b_path, patch BINARY``.
    """
    q = F.col("l_quantity").cast("int")
    ext = (
        F.when(F.col("l_returnflag") == "N", ".java")
        .when(F.col("l_returnflag") == "A", ".JAVA")
        .otherwise(".md")
    )
    path = F.concat(F.lit("src/P"), F.col("l_partkey").cast("string"), ext)
    name = F.concat(F.when(F.col("repo") == "repo-fork", "int f").otherwise("int v"), F.col("l_partkey").cast("string"), F.lit(" = "))
    # Columns of their own: named many times below, they would make one method that the JVM does not compile.
    named = lineitem.select("*", _repos("l_orderkey")).select(
        "*",
        q.alias("_q"),
        F.concat(name, F.col("l_suppkey").cast("string"), F.lit(";")).alias("_old"),
        F.concat(name, F.col("l_linenumber").cast("string"), F.lit(";")).alias("_new"),
        F.when(F.col("l_linestatus") == "O", "\r\n").otherwise("\n").alias("_end"),
    )
    q, old, new, end = F.col("_q"), F.col("_old"), F.col("_new"), F.col("_end")
    header, mark = F.lit("@@ -1 +1 @@"), F.lit(fixed.NO_EOF_NEWLINE_MARKER)

    def signed(sign: str, line: Column) -> Column:
        return F.concat(F.lit(sign), line)

    alone = [header, signed("-", old), mark, signed("+", old)]
    below = [header, signed("-", new), signed("-", old), mark, signed("+", F.lit("int y;")), signed("+", old)]
    after = [header, signed("-", new), signed("+", new), header, signed("-", F.lit("int z;")), signed("+", old), mark]
    lines = (
        F.when(q % 5 != 0, F.array(header, signed("-", old), signed("+", new)))
        .when(q % 3 == 1, F.array(*alone))
        .when(q % 3 == 2, F.array(*below))
        .otherwise(F.array(*after))
    )
    body = F.concat(F.call_function("array_join", lines, end), end)
    raw = F.when(q < 4, F.lit("")).otherwise(body).cast("binary")
    patch = F.concat(raw, F.when(q % 7 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    # The patch comes out of a one-row generator, so that a rule on it does not make it again.
    return named.select("*", F.inline(F.array(F.struct(patch.alias("patch"))))).select(
        "repo",
        F.md5(F.col("l_orderkey").cast("string")).alias("commit_id"),
        F.col("l_linenumber").cast("int").alias("ord"),
        F.when(F.col("l_discount") != 0, path).alias("a_path"),
        F.when(F.col("l_tax") != 0, path).alias("b_path"),
        "patch",
    )


# ------------------------------------------------------------------ versions and bytes
def versions_from_documents(documents: DataFrame) -> DataFrame:
    """Two versions of every document: ``old`` is the text, ``new`` an edit of it.

    The edit drops every line whose position is 2 mod 5, prefixes lines at
    3 mod 7 with ``# `` and appends one new line; all positions count from 0 over the
    ``\\n``-split text.  Output: ``pair_id, old, new``.
    """
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.filter(
        F.transform(lines, lambda l, i: F.when(i % 7 == 3, F.concat(F.lit("# "), l)).otherwise(l)),
        lambda l, i: i % 5 != 2,
    )
    new = F.concat(F.array_join(kept, "\n"), F.lit("\nadded line "), F.col("doc_id").cast("string"))
    return documents.select(
        F.col("doc_id").cast("string").alias("pair_id"), F.col("text").alias("old"), new.alias("new")
    )


def revisions_from_documents(documents: DataFrame) -> DataFrame:
    """Two versions of every document, with moves, copies, deletions and unlike ends.

    ``doc_id % 7`` picks the change of the lines: 0 the edit of
    ``versions_from_documents`` without its last line, 1 the first third moved
    to the end, 2 every line at 1 mod 4 doubled, 3 none, 4 nothing left,
    5 reversed, 6 a line put in front and ``!`` before lines at 0 mod 3.  The
    old text ends with a newline for even ids, the new one (if not empty) for
    ids that 3 divides.  Output: ``pair_id, old, new, doc_id, source``.
    """
    d = F.col("doc_id")
    df = documents.select("doc_id", "source", F.inline(F.array(F.struct(F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines")))))
    lines = F.col("lines")
    third = F.floor(F.size(lines) / 3).cast("int")
    new = (
        F.when(d % 7 == 0, F.filter(F.transform(lines, lambda l, i: F.when(i % 7 == 3, F.concat(F.lit("# "), l)).otherwise(l)), lambda l, i: i % 5 != 2))
        .when(d % 7 == 1, F.concat(F.slice(lines, third + 1, F.size(lines) - third), F.slice(lines, 1, third)))
        .when(d % 7 == 2, F.flatten(F.transform(lines, lambda l, i: F.when(i % 4 == 1, F.array(l, l)).otherwise(F.array(l)))))
        .when(d % 7 == 3, lines)
        .when(d % 7 == 4, F.array().cast("array<string>"))
        .when(d % 7 == 5, F.reverse(lines))
        .otherwise(F.concat(F.array(F.lit("first line")), F.transform(lines, lambda l, i: F.when(i % 3 == 0, F.concat(F.lit("!"), l)).otherwise(l))))
    )
    ended = lambda text, yes: F.when(yes & (text != ""), F.concat(text, F.lit("\n"))).otherwise(text)
    df = df.select("doc_id", "source", "lines", F.array_join(new, "\n").alias("new"))
    return df.select(
        d.cast("string").alias("pair_id"), ended(F.array_join(lines, "\n"), d % 2 == 0).alias("old"), ended(F.col("new"), d % 3 == 0).alias("new"),
        "doc_id", "source",
    )


def blob_changes_from_documents(documents: DataFrame) -> DataFrame:
    """Changed files with both contents: the revisions of every document as a commit of ``source``.

    Lines end with CRLF in both contents for ids that 5 divides; the old one
    begins with an invalid byte for ids that 11 divides; every ninth path is no
    Java file.  ``patch`` is a line each way, with the marker of a missing
    newline where an end lacks it.
    Output: ``repo, commit_id, ord, a_path, b_path, patch, a_blob, b_blob, doc_id``.
    """
    d, mark = F.col("doc_id"), F.lit(fixed.NO_EOF_NEWLINE_MARKER + "\n")
    ends = lambda c: F.when((F.col(c) == "") | F.col(c).endswith("\n"), F.lit("")).otherwise(mark)
    crlf = lambda c: F.when(d % 5 == 0, F.replace(F.col(c), F.lit("\n"), F.lit("\r\n"))).otherwise(F.col(c))
    path = F.concat(F.lit("src/D"), F.col("pair_id"), F.when(d % 9 == 0, ".md").otherwise(".java"))
    patch = F.concat(F.lit("@@ -1 +1 @@\n-old\n"), ends("old"), F.lit("+new\n"), ends("new"))
    a_blob = F.encode(crlf("old"), "UTF-8")
    return revisions_from_documents(documents).select(
        F.col("source").alias("repo"), F.md5("pair_id").alias("commit_id"), F.lit(1).alias("ord"), path.alias("a_path"), path.alias("b_path"),
        F.encode(patch, "UTF-8").alias("patch"), F.when(d % 11 == 0, F.concat(F.unhex(F.lit("FF")), a_blob)).otherwise(a_blob).alias("a_blob"),
        F.encode(crlf("new"), "UTF-8").alias("b_blob"), "doc_id",
    )


#: Charsets of ``charset_documents`` by ``doc_id % 11``, and the letters that stand for a to z in their texts.
CHARSETS = ("UTF-8", "UTF-16LE", "UTF-16BE", "windows-1252", "windows-1251", "KOI8-R", "Shift_JIS", "EUC-JP", "GB18030", "Big5", "EUC-KR")
_CYRILLIC = "абцдефгхийклмнопярстувшжыз"
_KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのは"
_HANZI = "的一是不了人我在有他上大中到子地也你就那要下以生自出"
_HANGUL = "가나다라마바사아자차카타파하고노도로모보소오조초코토"
LETTERS = ("", "", "", "", _CYRILLIC, _CYRILLIC, _KANA, _KANA, _HANZI, _HANZI, _HANGUL)


@F.arrow_udf(BinaryType())
def _encoded(text: pa.Array, charset: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.encode(c) for t, c in zip(text.to_pylist(), charset.to_pylist())], pa.binary())


def charset_documents(documents: DataFrame) -> DataFrame:
    """Documents as bytes of eleven charsets without byte-order marks.

    Texts of the scripts other than Latin keep their ASCII characters but the
    letters, which become letters of the script.  A text that windows-1252
    cannot hold, or that is plain ASCII there, is UTF-8.
    Output: ``doc_id, source, raw, charset, text``.
    """
    k = (F.col("doc_id") % len(CHARSETS)).cast("int")
    plain = F.regexp_replace(F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", "")), "\0", "")
    text = F.col("text")
    for i, letters in enumerate(LETTERS):
        if letters:
            text = F.when(k == i, F.translate(plain, "abcdefghijklmnopqrstuvwxyz", letters)).otherwise(text)
    latin = F.col("text").rlike(r"^[\x00-\x7F\xA0-\xFF]*$") & F.col("text").rlike(r"[\xA0-\xFF]")
    named = F.element_at(F.array(*[F.lit(c) for c in CHARSETS]), k + 1)
    charset = F.when((k == 3) & ~latin, "UTF-8").when((k > 3) & ~F.col("text").rlike("[A-Za-z]"), "UTF-8").otherwise(named)
    made = documents.select("doc_id", "source", charset.alias("charset"), F.coalesce(text, F.lit("")).alias("text"))
    return encoded_text(made)


def encoded_text(df: DataFrame, text: str = "text", charset: str = "charset", out: str = "raw") -> DataFrame:
    """``out``: the text in the bytes of the named charset."""
    return df.withColumn(out, _encoded(text, charset))


def encoded_documents(documents: DataFrame) -> DataFrame:
    """Document text as bytes: UTF-8, ISO-8859-1, or UTF-16LE with byte-order mark.

    Characters outside Latin-1 cannot be written as ISO-8859-1; such rows are
    written as UTF-16LE instead.  Output: ``doc_id, raw BINARY, charset, text``.
    """
    m = F.col("doc_id") % 3
    latin1_ok = F.col("text").rlike(r"^[\x{0}-\x{FF}]*$")
    charset = (
        F.when(m == 0, "UTF-8")
        .when((m == 1) & latin1_ok, "ISO-8859-1")
        .otherwise("UTF-16LE")
    )
    raw = (
        F.when(charset == "UTF-8", F.encode("text", "UTF-8"))
        .when(charset == "ISO-8859-1", F.encode("text", "ISO-8859-1"))
        .otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    )
    return documents.select("doc_id", raw.alias("raw"), charset.alias("charset"), "text")
