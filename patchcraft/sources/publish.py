"""Tables that grow by batches, each written whole or not at all.

A batch is first staged: its files go to a folder that nobody lists.  Then one
row naming that folder is written as the batch's own manifest, which Spark
commits by renaming one file; from then on ``read_published`` finds the batch.
A run that fails before leaves nothing readable, a run that is repeated finds
the manifest and writes nothing, and of two runs at once the second fails on
the manifest that is there.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "batch string, folder string, n_rows long"
#: Rows of a file at most; a repository with more is spread over more tasks.
ROWS_PER_FILE = 1_000_000


def placed(rows: DataFrame, by: str, key: Column | str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rows of one ``by`` value together, split by a hash of ``key`` where there are more than one file takes.

    So a repository gets a file or a few, not one from every task, and a hot
    one is not written by a single task.  Only counts meet by value.
    """
    sizes = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_parts"))
    salted = rows.join(sizes.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    salt = F.pmod(F.xxhash64(key), F.col("_parts"))
    return salted.withColumn("_salt", salt).repartition(by, "_salt").drop("_by", "_parts", "_salt")


def _manifest(spark: SparkSession, base: str) -> list[tuple[str, str]]:
    """(batch, folder) of every published batch, in the order of their names."""
    try:
        rows = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{base}/manifest").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted((r["batch"], r["folder"]) for r in rows)


def published(spark: SparkSession, base: str) -> list[str]:
    """Names of the batches that readers see."""
    return [batch for batch, _ in _manifest(spark, base.rstrip("/"))]


def publish(rows: DataFrame, base: str, batch: str, partition_by: str | None = None, form: str = "parquet") -> bool:
    """Adds ``rows`` to the table at ``base`` as ``batch``; False, and nothing written, if that batch is there already."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    spark, base = rows.sparkSession, base.rstrip("/")
    if batch in published(spark, base):
        return False
    folder = f"data/{batch}-{uuid.uuid4().hex}"
    writer = rows.write.format(form)
    (writer.partitionBy(partition_by) if partition_by else writer).save(f"{base}/{folder}")
    reader = spark.read.format(form) if form == "text" else spark.read.format(form).schema(rows.schema)
    n = reader.load(f"{base}/{folder}").count()
    spark.createDataFrame([(batch, folder, n)], MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{base}/manifest/{batch}")
    return True


def read_published(spark: SparkSession, base: str, schema: StructType | str, form: str = "parquet") -> DataFrame:
    """All published batches with ``batch`` beside their columns; no rows if there is none."""
    base = base.rstrip("/")
    kind = spark.createDataFrame([], schema).schema
    parts = [
        spark.read.schema(kind).format(form).load(f"{base}/{folder}").withColumn("batch", F.lit(batch))
        for batch, folder in _manifest(spark, base)
    ]
    if not parts:
        return spark.createDataFrame([], kind).withColumn("batch", F.lit(None).cast("string"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
