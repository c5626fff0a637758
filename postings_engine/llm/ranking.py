"""Exact positions within groups of any size, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def seeded_hash(seed: int, *columns: str) -> Column:
    """A 64-bit hash of the columns that shuffles rows in a repeatable order."""
    return F.xxhash64(F.lit(seed), *columns)


def hash_bucket(column: str) -> Column:
    """The upper 12 bits of a hash, in the order of the hash read as unsigned."""
    return F.shiftrightunsigned(column, 52).cast("int")


def drawn(hash_column: Column, wanted: int, of: Column) -> Column:
    """True for about ``wanted`` of ``of`` rows, each taken by its hash alone.

    Every row is drawn with chance wanted / of (all of them if there are no more), so nothing is sorted
    or gathered; that a draw exceeds the wanted number by a fifth has no practical chance.
    """
    return F.shiftrightunsigned(hash_column, 11) / F.lit(float(1 << 53)) < F.lit(float(wanted)) / of


def positions(df: DataFrame, group: list[str], bucket: Column, order: list, name: str, total: str | None = None) -> DataFrame:
    """Add the row's position (from 0) within its group.

    ``bucket`` cuts a group into at most BUCKETS consecutive ranges of ``order``; the rows of one
    range are numbered together, and the few counts per group give the ranges' offsets.  ``group``
    columns must hold no nulls.  ``total`` also adds the group's size.
    """
    keys = [*group, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*group)))
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = numbered.join(offsets.drop("_n"), keys)
    return joined.withColumn(name, F.col("_before") + F.col("_row") - 1).drop("_bucket", "_before", "_row")
