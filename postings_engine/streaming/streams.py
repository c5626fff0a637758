"""The same jobs over streams: merge per micro-batch, stateful dedup, windowed cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.merge import sync_touched
from ..plans.costs import SOFT_CAP_GBP
from ..plans.daily import empty_history
from ..schema import HISTORY
from ..session import materialise
from ..sources.tables import (
    compact, compact_updates, current_version, deltas_since_full, has_batch, read_history, write_version,
)


def stream_id(session: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint: a new checkpoint is a new stream."""
    return session.read.json(f"{checkpoint}/metadata").first()["id"]


def merge_batch(
    root: str, order: list[str], run_date: Callable[[DataFrame], object], checkpoint: str, compact_every: int = 50
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function merging each micro-batch into the versioned table at ``root``.

    A batch writes only the rows it touched, as a delta and as the table's next version; every
    ``compact_every`` deltas the table is rewritten in full.  The batch is recorded by the stream's own
    id, which its checkpoint keeps, and its number: a batch replayed after a failure is found and skipped,
    while daily runs on the same table and streams begun anew get versions of their own.  The merge reads a batch three
    times, so its rows are stored first.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream = stream_id(session, checkpoint)
        if has_batch(session, root, stream, batch_id):
            return
        found = current_version(session, root)
        jobs = read_history(session, root)
        batch = materialise(batch, "batch", compression="zstd")
        touched = sync_touched(empty_history(session) if jobs is None else jobs, batch, order, run_date(batch))
        version = found[0] + 1 if found else 1
        write_version(touched.select(*HISTORY.names), root, version, "delta" if found else "full", stream, batch_id)
        if deltas_since_full(session, root) >= compact_every:
            compact(session, root)

    return merge


def stream_sync(
    postings: DataFrame, root: str, checkpoint: str, order: list[str],
    run_date: Callable[[DataFrame], object], compact_every: int = 50,
) -> DataStreamWriter:
    """Merge a stream of conformed postings; start it with the trigger of your choice."""
    return postings.writeStream.foreachBatch(merge_batch(root, order, run_date, checkpoint, compact_every)).option(
        "checkpointLocation", checkpoint
    )


def stream_dedup(raw: DataFrame, keys: list[str], event_time: str, horizon: str = "7 days") -> DataFrame:
    """First record per key within the horizon; older keys leave the state."""
    return raw.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(keys)


def stream_cost(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    """Cost per day, operation and model over event time."""
    return calls.withWatermark("timestamp", delay).groupBy(
        F.window("timestamp", "1 day"), "operation", "model"
    ).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("cached_input_tokens").alias("cached_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("est_cost_gbp").alias("est_cost_gbp"),
    ).select(F.to_date("window.start").alias("day"), "operation", "model", "calls", "input_tokens",
             "cached_tokens", "output_tokens", "est_cost_gbp")


def stream_soft_cap(calls: DataFrame, cap: float = SOFT_CAP_GBP, delay: str = "1 day") -> DataFrame:
    """Days whose cost went over the soft cap."""
    daily = calls.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 day")).agg(
        F.sum("est_cost_gbp").alias("cost_gbp")
    )
    return daily.filter(F.col("cost_gbp") > cap).select(F.to_date("window.start").alias("day"), "cost_gbp")


def write_updates(df: DataFrame, path: str, checkpoint: str, keys: list[str], compact_every: int = 50) -> DataStreamWriter:
    """Keep an aggregation as a table: each micro-batch adds the rows that it changed.

    In update mode the watermark lets old days leave the state, and a batch writes changed rows alone;
    :func:`postings_engine.sources.tables.read_updates` gives the newest row per key.  Every ``compact_every``
    batches these rows are written as one full version, so a reader never unites more versions than that.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        stream = stream_id(session, checkpoint)
        if not has_batch(session, path, stream, batch_id):
            found = current_version(session, path)
            write_version(batch, path, found[0] + 1 if found else 1, "delta" if found else "full", stream, batch_id)
        # Also after a replay: the batch may have been recorded and the compaction lost.
        if deltas_since_full(session, path) >= compact_every:
            compact_updates(session, path, keys)

    return df.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
