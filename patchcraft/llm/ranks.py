"""Places of rows within sorted groups, whatever the groups' sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: monotonically_increasing_id() has the partition above this bit and the row's place in it below.
_BITS = 33


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (long, from 0, place in its group by ``order``) and ``n`` (long, rows of the group).

    ``group`` columns hold no null; nulls in ``order`` come first; rows equal
    in both get places in any order.  The rows are sorted by ranges of group
    and order together, so one group spreads over as many tasks as it fills;
    give ``order`` a last column that tells equal rows apart, and no key is
    too hot.  What meets by group is one count for each group and partition.
    An empty table gives no rows.  ``pos``, ``n`` and ``place_`` must not be
    columns of ``rows``.
    """
    at = F.monotonically_increasing_id()
    by = [*group, *order]
    laid = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place_", at), "numbered")
    part = F.shiftright("place_", _BITS)
    inside = F.col("place_").bitwiseAND(F.lit((1 << _BITS) - 1))
    runs = laid.groupBy(*group, part.alias("part_")).agg(F.min(inside).alias("first_"), F.count(F.lit(1)).alias("run_"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"before_": F.coalesce(F.sum("run_").over(before), F.lit(0)), "n": F.sum("run_").over(whole)}).drop("run_")
    joined = laid.withColumn("part_", part).join(runs, [*group, "part_"])
    return joined.select(*rows.columns, (inside - F.col("first_") + F.col("before_")).alias("pos"), "n")
