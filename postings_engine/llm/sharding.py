"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked.  A row's fractional rank
``(rank + 0.5) / size of its source`` spreads every source evenly over 0..1, so the rows sorted by it
are the sources' mixture all along, and consecutive cuts of equal length are shards that match it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import whole_text
from .ranking import BUCKETS, hash_bucket, positions, seeded_hash

SEED = 20240601


def text_size(df: DataFrame) -> DataFrame:
    """Ids, source, size and checksum; the texts themselves are not shuffled."""
    text = whole_text()
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source").cast("string"))).alias("stratum"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.crc32(text).alias("text_crc32"),
    )


def interleave(df: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Deal ``documents`` into ``shards`` shards: ``doc_id, stratum, bytes, text_crc32, shard, slot``.

    Row counts differ by at most one, and so do each source's counts between its expected share and
    what a shard gets, up to ties at the cuts.  Null sources are a source of their own; null texts
    count as empty; equal rows are interchangeable; an empty table gives no rows; other columns are
    not read.  Both sorts run in hash or rank ranges, so a source with a third of all rows is dealt
    over as many tasks as any other.
    """
    rows = text_size(df).withColumn("_h", seeded_hash(seed, "doc_id", "text_crc32", "bytes"))
    ties = ["_h", F.col("doc_id").asc_nulls_first(), "text_crc32", "bytes"]
    ranked = positions(rows, ["stratum"], hash_bucket("_h"), ties, "_rank", "_size")
    mixed = ranked.withColumn("_f", (F.col("_rank") + 0.5) / F.col("_size")).withColumn("_all", F.lit(0))
    placed = positions(mixed, ["_all"], F.floor(F.col("_f") * BUCKETS).cast("int"), ["_f", *ties, "stratum"], "_at", "_total")
    # Shard k starts at the first position p with p * shards // total = k.
    shard = F.expr(f"_at * {shards} div _total")
    start = F.expr(f"(shard * _total + {shards} - 1) div {shards}")
    return (placed.withColumn("shard", shard).withColumn("slot", F.col("_at") - start)
            .select("doc_id", "stratum", "bytes", "text_crc32", F.col("shard").cast("int").alias("shard"),
                    F.col("slot").cast("long").alias("slot")))
