"""Keep-first, per-group caps, consecutive batches and look-back within a group.

Group limits are written as ``row_number() <= n``: Spark then limits each group inside every map
task before the shuffle, so a group holding a third of all rows reaches the reducer as at most
``n`` rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _ranked(df: DataFrame, keys: list[Column], order: list[str | Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key in the given order."""
    return _ranked(df, [F.col(k) for k in keys], order, 1)


def keep_first_known(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per key, except that rows with an empty key are all kept.

    The unkeyed rows skip the shuffle altogether, however many there are.
    """
    unknown = F.col(key).isNull() | (F.col(key) == "")
    return keep_first(df.filter(~unknown), [key], order).unionByName(df.filter(unknown))


def cap_per_group(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """At most ``n`` rows per group, the first in the given order."""
    return _ranked(df, [F.col(k) for k in keys], order, n)


def last_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per key in the given order, as an aggregate (partial sums before the shuffle)."""
    row = F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(row).select(key, "_row.*")


def assign_batches(
    df: DataFrame, batch_size: int = 5, id_column: str = "job_id", order: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """Consecutive full batches of ``batch_size`` rows; only the last one may be short.

    ``id_column`` is a hex hash; where it repeats, ``order`` names columns that tell the rows apart, and
    rows are then dealt by a hash of all of them, so that a frequent id spreads.  Rows are numbered inside
    the 4096 buckets of its first three digits, and the counts of the buckets, a small table, give each its first number.
    Adds ``batch_id`` and ``pos`` (0-based within the batch).
    """
    spread_id = F.sha1(F.to_json(F.struct(id_column, *order))) if order else F.col(id_column)
    rows = df.withColumn("_bucket", F.conv(F.substring(spread_id, 1, 3), 16, 10).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(id_column, *order)) - 1
    numbered = rows.withColumn("_inside", inside).join(starts, "_bucket").withColumn("_n", F.col("_start") + F.col("_inside"))
    return numbered.withColumn(
        "batch_id", F.floor(F.col("_n") / batch_size).cast("string")
    ).withColumn("pos", (F.col("_n") % batch_size).cast("int")).drop("_bucket", "_start", "_inside", "_n")


def previous_in_group(df: DataFrame, key: str, order: list[str], value: str, out: str = "previous") -> DataFrame:
    """Add ``out``: a struct holding the value of the preceding row of the same key, or NULL.

    Pass narrow rows: a frequent key is sorted in one task, which spills but carries what it is given.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(out, F.lag(F.struct(F.col(value).alias("value"))).over(window))
