"""Stream forms of the stateless jobs (cleaning and tokenising).

``clean_patches`` and the tokeniser are row-local projections, so the same
column expressions run unchanged on a file stream.  Label jobs group per
patch and stay batch jobs.  Progress and output survive executor and driver
loss through the checkpoint folder (under the shared ``spark.checkpoint.dir``
unless given).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import clean as C
from ..session import shared_path


def read_patch_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """New ``*.diff`` files of ``folder`` as a stream of ``path, text`` rows."""
    return (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("pathGlobFilter", "*.diff")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def clean_and_tokenise(stream: DataFrame) -> DataFrame:
    """Java sections, audit status, and standardised tokens of each patch."""
    cleaned = C.clean_patches(stream, "text")
    return cleaned.select(
        "path", "cleaned", "lines_removed", "status",
        T.tokenise(T.standardise_numbers("cleaned")).alias("tokens"),
    )


def start_clean_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Run ``clean_and_tokenise`` from ``source`` files into a parquet ``sink``.

    ``available_now`` processes what is there and stops (batch-like, but
    incremental on the next run thanks to the checkpoint).
    """
    q = clean_and_tokenise(read_patch_stream(spark, source))
    writer = (
        q.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint or shared_path(spark, "streams", "clean"))
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
