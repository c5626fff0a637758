"""Table reads and writes: versioned history, bucketed history, append-only logs, exports."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import keep_first
from ..schema import HISTORY

TEXTS = "_name string, _text string"
LEDGER = "version bigint, kind string, path string, stream string, batch bigint"


def write_version(
    df: DataFrame, root: str, version: int, kind: str = "full", stream: str | None = None, batch: int | None = None
) -> str:
    """Write a new version folder, then record it; readers never see a half-written table.

    Every write has a folder of its own, so a lost executor, a failed job or a second writer leaves what is
    recorded in place.  A version is recorded once: the later of two writers of one version fails.
    A ``delta`` holds only the rows that changed.  ``stream`` and ``batch`` name the micro-batch written.  Row groups carry a
    Bloom filter of their ids, so a lookup of one id reads the row groups that may hold it.
    """
    spark = df.sparkSession
    path = f"{root}/v{version:08d}-{kind}-{uuid.uuid4().hex[:12]}"
    df.write.option("parquet.bloom.filter.enabled#job_id", "true").parquet(path)
    entry = (
        F.lit(version).cast("bigint").alias("version"), F.lit(kind).alias("kind"), F.lit(path).alias("path"),
        F.lit(stream).cast("string").alias("stream"), F.lit(batch).cast("bigint").alias("batch"),
    )
    spark.range(1).select(*entry).write.mode("error").parquet(f"{root}/_versions/v{version:08d}")
    return path


def write_texts(texts: DataFrame, jobs: DataFrame, root: str) -> None:
    """Add the texts that descriptions of ``jobs`` name to the table's store of texts, where each lies once."""
    spark, path = texts.sparkSession, f"{root}/_texts"
    named = texts.join(jobs.select(F.col("description").alias("_name")), "_name", "left_semi")
    found = _texts(spark, root)
    (named if found is None else named.join(found, "_name", "left_anti")).write.mode("append").parquet(path)


def _texts(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(TEXTS).parquet(f"{root}/_texts")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def stored_texts(spark: SparkSession, root: str) -> DataFrame:
    """``(_name, _text)``: the table's texts, each once, whatever failed writes left twice."""
    found = _texts(spark, root)
    if found is None:
        raise FileNotFoundError(f"no texts stored under {root}")
    return found.groupBy("_name").agg(F.first("_text").alias("_text"))


def _ledger(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).parquet(f"{root}/_versions/v*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def has_batch(spark: SparkSession, root: str, stream: str, batch: int) -> bool:
    """Whether this micro-batch of this stream was recorded, whatever was written since."""
    ledger = _ledger(spark, root)
    return ledger is not None and not ledger.filter((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()


def _recorded(spark: SparkSession, root: str) -> list:
    """Ledger entries from the last full version on, oldest first."""
    ledger = _ledger(spark, root)
    if ledger is None:
        return []
    full = ledger.filter("kind = 'full'").agg(F.max("version").alias("v")).first()["v"]
    entries = ledger.filter(F.col("version") >= F.lit(full if full is not None else 0)).collect()
    return sorted(entries, key=lambda e: e["version"])


def current_version(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Latest recorded version and its folder, or None before the first write."""
    entries = _recorded(spark, root)
    return (entries[-1]["version"], entries[-1]["path"]) if entries else None


def deltas_since_full(spark: SparkSession, root: str) -> int:
    return sum(e["kind"] == "delta" for e in _recorded(spark, root))


def read_history(spark: SparkSession, root: str) -> DataFrame | None:
    """The current history: the last full version, overlaid with the newer deltas.

    The overlay keeps the newest row per posting, limited inside the map tasks.
    """
    entries = _recorded(spark, root)
    if not entries:
        return None
    parts = [
        spark.read.schema(HISTORY).parquet(e["path"]).withColumn("_version", F.lit(e["version"])) for e in entries
    ]
    if len(parts) == 1:
        return parts[0].drop("_version")
    return keep_first(reduce(DataFrame.unionByName, parts), ["job_id"], [F.desc("_version")]).drop("_version")


def read_updates(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """A table kept by updates: the newest row per key over all recorded versions."""
    parts = [spark.read.parquet(e["path"]).withColumn("_version", F.lit(e["version"])) for e in _recorded(spark, root)]
    return keep_first(reduce(DataFrame.unionByName, parts), keys, [F.desc("_version")]).drop("_version")


def scan_jobs(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The current history table, reading only the named columns."""
    df = read_history(spark, root)
    if df is None:
        raise FileNotFoundError(f"no version recorded under {root}")
    return df.select(*columns) if columns else df


def compact(spark: SparkSession, root: str) -> None:
    """Replace the last full version and its deltas by one new full version."""
    write_version(scan_jobs(spark, root), root, current_version(spark, root)[0] + 1, "full")


def compact_updates(spark: SparkSession, root: str, keys: list[str]) -> None:
    """As :func:`compact`, for a table kept by updates."""
    write_version(read_updates(spark, root, keys), root, current_version(spark, root)[0] + 1, "full")


def point_lookup(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)


def write_jobs_bucketed(df: DataFrame, table: str, buckets: int) -> None:
    """History as a bucketed, sorted table: merges on ``job_id`` then need no shuffle of it."""
    df.write.mode("overwrite").bucketBy(buckets, "job_id").sortBy("job_id").saveAsTable(table)


def append_run(
    spark: SparkSession, path: str, run_id: int, started_at: dt.datetime, finished_at: dt.datetime,
    metrics: DataFrame, sources_ok: int, sources_failed: int, errors: list[str],
) -> None:
    """Append one row of run metrics; ``metrics`` holds ``scraped``, ``new`` and ``closed``."""
    row = metrics.select(
        F.lit(run_id).cast("bigint").alias("id"),
        F.lit(started_at).cast("timestamp").alias("started_at"),
        F.lit(finished_at).cast("timestamp").alias("finished_at"),
        F.lit((finished_at - started_at).total_seconds()).alias("duration_s"),
        F.lit(sources_ok).alias("sources_ok"),
        F.lit(sources_failed).alias("sources_failed"),
        F.col("scraped").cast("bigint").alias("jobs_scraped"),
        F.col("new").cast("bigint").alias("jobs_new"),
        F.col("closed").cast("bigint").alias("jobs_closed"),
        F.array(*[F.lit(e) for e in errors]).cast("array<string>").alias("errors"),
    )
    row.write.mode("append").parquet(path)


def append_api_calls(calls: DataFrame, path: str) -> None:
    """Append cost events, one folder per day, so that day and month views prune their scan."""
    calls.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(path)


def write_bronze(raw: DataFrame, path: str) -> None:
    """Raw snapshots by source and ingest day; the replay and the age limit prune on the day."""
    raw.write.mode("append").partitionBy("source", "ingest_date").parquet(path)


def write_csv(view: DataFrame, path: str) -> None:
    view.write.mode("overwrite").option("header", True).csv(path)
