"""Readers for patch folders, verdict exports and vocabulary lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import parse_verdict_lines


def decoded_path(col: str) -> Column:
    """The path behind a file URL; a ``+`` in a name is a plus sign there, not a blank."""
    return F.url_decode(F.replace(F.col(col), F.lit("+"), F.lit("%2B")))


def scan_patches(
    spark: SparkSession,
    folder: str,
    max_file_kb: int | None = None,
    recursive: bool = True,
) -> DataFrame:
    """Every ``*.diff`` file under ``folder`` as one row: ``path, repo, patch_id, label_dir, text, n_bytes``.

    Names starting with ``.`` (and ``_``, Spark's own rule) are skipped.  A
    size limit, if given, is applied to file metadata, so over-size files are
    never read.  ``repo`` and ``label_dir`` are the parent folder name.
    """
    reader = spark.read.option("pathGlobFilter", "*.diff")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.text(folder, wholetext=True)
    df = df.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("n_bytes"),
        F.col("value").alias("text"),
    )
    if max_file_kb is not None:
        df = df.where(F.col("n_bytes") <= max_file_kb * 1024)
    parts = F.split(decoded_path("path"), "/", -1)
    name = F.element_at(parts, -1)
    return df.select(
        "path",
        F.element_at(parts, -2).alias("repo"),
        F.regexp_replace(name, r"\.diff$", "").alias("patch_id"),
        F.element_at(parts, -2).alias("label_dir"),
        "text",
        F.col("n_bytes").cast("long").alias("n_bytes"),
    ).where(~F.element_at(parts, -1).startswith("."))


def scan_dataset(spark: SparkSession, dataset: str, max_file_kb: int | None = None) -> DataFrame:
    """Direct ``*.diff`` children of every repository folder of a dataset."""
    return scan_patches(spark, dataset.rstrip("/") + "/[!.]*/", max_file_kb=max_file_kb, recursive=False)


def label_from_path(df: DataFrame, folder_col: str = "label_dir") -> DataFrame:
    """``yes`` -> 1, ``no`` -> 0, anything else fails the job."""
    f = F.col(folder_col)
    return df.withColumn(
        "label",
        F.when(f == "yes", 1).when(f == "no", 0).otherwise(
            F.raise_error(F.concat(F.lit("label not found for "), F.col("path")))
        ),
    )


def read_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict exports (one folder per repository) -> ``repo, patch_id, verdict, message``."""
    lines = spark.read.text(folder).withColumn(
        "repo", F.regexp_extract(decoded_path("_metadata.file_path"), r"repo=([^/]+)/", 1)
    )
    return parse_verdict_lines(lines)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("word")).where(F.length("word") > 0).distinct()
