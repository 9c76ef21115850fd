"""Writers: tables instead of one small file per patch.

With a ``batch`` name a writer adds to a published table (``sources.publish``):
whole or not at all, and once however often it is run.  Without one it replaces
the table at ``path``.  Rows of a repository are written together, a large
repository by several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.select import verdict_lines
from .publish import placed, publish


def _write(rows: DataFrame, path: str, batch: str | None, mode: str, partition_by: str | None = None, form: str = "parquet") -> None:
    if batch is not None:
        publish(rows, path, batch, partition_by, form)
        return
    writer = rows.write.mode(mode).format(form)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)


def write_patches(patches: DataFrame, path: str, mode: str = "overwrite", batch: str | None = None) -> None:
    """Patches as a parquet table partitioned by repository."""
    _write(placed(patches, "repo", "patch_id"), path, batch, mode, "repo")


def write_cleaned(cleaned: DataFrame, path: str, mode: str = "overwrite", batch: str | None = None) -> None:
    """Cleaned patches with their audit columns; deleted ones are kept as audit rows."""
    _write(cleaned, path, batch, mode)


def write_verdicts(verdicts: DataFrame, path: str, mode: str = "overwrite", batch: str | None = None) -> None:
    """Text export, one folder per repository, rows ``id||verdict|message``."""
    lines = verdict_lines(verdicts).select("repo", "line")
    _write(placed(lines, "repo", "line"), path, batch, mode, "repo", "text")


def write_selection(selected: DataFrame, path: str, mode: str = "overwrite", batch: str | None = None) -> None:
    """Selected examples partitioned by label folder ``yes`` / ``no``."""
    out = selected.withColumn("label_dir", F.when(F.col("label") == 1, "yes").otherwise("no"))
    _write(placed(out, "label_dir", "patch_id"), path, batch, mode, "label_dir")


def write_vocabulary(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Words in code-point order, one per line (range-sorted, no single-task sort)."""
    vocab.select("word").orderBy("word").write.mode(mode).text(path)


def write_spawned(spawned: DataFrame, path: str, mode: str = "append", batch: str | None = None) -> None:
    """Spawned copies added to a patch table; with a ``batch`` a repeated run adds nothing."""
    _write(placed(spawned.select("repo", "patch_id", "text"), "repo", "patch_id"), path, batch, mode, "repo")
