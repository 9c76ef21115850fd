"""The corpus pipeline: from all documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchcraft.llm import exact, kneser, packing, simhash, suffix
from patchcraft.llm.common import exchanged, read_docs, ship, written
from patchcraft.llm.queries import WORD_BPE


#: Names each row; no column of the documents has this name.
KEY = "pipeline_row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with KEY, unique to each row and the same whenever it is read: id, file and place in the file.

    Rows that are not just read from files are written first.  An id orders
    before the place; a row without one comes before all others.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
        docs = written(docs, "keyed")
    return docs.withColumn(KEY, F.struct("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")))


def _only(keyed: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows that ``decided`` keeps; its ``doc_id`` is their KEY."""
    kept = decided.where("kept").select(F.col("doc_id").alias(KEY))
    return keyed.join(exchanged(kept), KEY, "left_semi").drop(KEY)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is that of trusted text."""
    ship(spark)
    keyed = _keyed(docs)
    return _only(keyed, kneser.quality_classifier(keyed, read_docs(spark, sf_dir, "labels"), key_col=KEY)).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    ship(spark)
    keyed = _keyed(docs)
    return _only(keyed, exact.exact_dedup(keyed, id_col=KEY)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints."""
    ship(spark)
    keyed = _keyed(docs)
    return _only(keyed, simhash.simhash_near_dedup(keyed, id_col=KEY)).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the byte strings that stand elsewhere too.

    A character that loses some of its bytes goes as a whole; n_chars is
    counted again; a document that loses all its text stays, empty.
    """
    ship(spark)
    done = suffix.remove_repeats(docs, carry=tuple(docs.columns), as_text=True)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept")), "n_chars": F.length("kept").cast("long")}
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in their sequences."""
    ship(spark)
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeats),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = read_docs(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
