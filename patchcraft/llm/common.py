"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: The white space of every word rule here: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \\t\\n\\x0B\\f\\r"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that they import it whatever their path is."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="patchcraft-"), "patchcraft.zip")
    with zipfile.ZipFile(name, "w") as z:
        for top, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(top, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(name)
    _shipped.add(context.applicationId)


def read_docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the cluster's shared folder and read again.

    Cuts lineage, so work behind it is not repeated when an executor is lost
    or when two consumers read it.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm", f"{re.sub(r'[^a-z0-9_]', '_', name.lower())}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exchanged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that exchanges and sorts both, whatever size Spark expects.

    That size is one of compressed files and does not count the rows an explode
    makes, so a table that grows with the corpus could be broadcast by it.
    """
    return df.hint("merge")


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns: the id, and the text as UTF-8 bytes (null as empty).  Other columns, whatever their names, stay out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


def type_of(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()
