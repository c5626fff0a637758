"""The daily run: edits in, feeds filtered, scored and merged, stale rows closed, views out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import DEFAULT_PRESCORE_THRESHOLD, apply_filters
from ..operators.merge import close_stale, fold_run, import_edits, sync
from ..operators.scoring import ScoreBatches, prescore_and_route, score_round_trip
from ..operators.texts import with_texts
from ..schema import CONTENT_COLUMNS, HISTORY, POSTING, SCORE_COLUMNS
from ..session import materialise
from ..sources.tables import append_run, current_version, read_history, write_version
from .reports import run_metrics


@dataclass(frozen=True)
class RunResult:
    """The merged table (with ``action`` and ``closed_now``) and the run's counters."""

    jobs: DataFrame
    metrics: DataFrame


def daily_run(
    jobs: DataFrame, postings: DataFrame, order: list[str], profile: Mapping, as_of,
    edits: DataFrame | None = None, score_batches: ScoreBatches | None = None,
    threshold: float = DEFAULT_PRESCORE_THRESHOLD, ranker_version: str = "v1", stale_days: int = 14,
    texts: DataFrame | None = None, columns: Collection[str] | None = None,
) -> RunResult:
    """One run over conformed ``postings``; the merged table is not written.

    The filtered and scored rows are stored once, since the merge counts them before it folds them.  Filters run before the merge, so a known posting that no longer passes is not seen again and
    goes stale like one that disappeared.  With ``texts`` (see ``operators.texts``) descriptions are names, in
    ``jobs`` and in the result too: the keyword score and the scorer read the texts, and nothing else moves them.
    ``columns`` names the columns of the result that are wanted, all by default; what the run reads is stored besides.
    """
    if edits is not None:
        jobs = import_edits(jobs, edits).drop("edited", "conflict", "edits_applied")
    kept = apply_filters(postings, profile, jobs, as_of)
    if columns is not None:
        read = {*columns, *order, *SCORE_COLUMNS, "job_id", "title", "company", "description", "jd_content_hash"}
        kept = kept.select(*[c for c in kept.columns if c in read])
    read = with_texts(kept.withColumn("_named", F.col("description")), texts)
    scored = prescore_and_route(read, profile, threshold, ranker_version, score_batches is not None)
    scored = scored.withColumn("description", F.col("_named")).drop("_named")
    if score_batches is not None:
        scored = score_round_trip(scored, score_batches, ranker_version, order=order, texts=texts)
    names = [c for c in POSTING.names if columns is None or c in columns or c in ("job_id", "jd_content_hash")]
    routed = materialise(scored.select(*dict.fromkeys([*names, *order])), "routed", compression="zstd")
    merged = sync(jobs, routed, order, as_of, columns)
    closed = close_stale(merged, as_of, stale_days)
    return RunResult(closed, run_metrics(closed))


def empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HISTORY)


def run_and_store(
    spark: SparkSession, root: str, postings: DataFrame, order: list[str], profile: Mapping, as_of,
    sources_ok: int = 1, sources_failed: int = 0, errors: list[str] | None = None, **options,
) -> RunResult:
    """A daily run against the versioned history under ``root``, with its metrics appended."""
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    found = current_version(spark, root)
    jobs = read_history(spark, root) if found else empty_history(spark)
    version = found[0] + 1 if found else 1
    # Conforming is the costly part: its rows are written once, and counted as they are, before the filters.
    read, merged = Observation("conformed"), Observation("merged")
    postings = materialise(postings.observe(read, F.count(F.lit(1)).alias("scraped")), "conformed")
    result = daily_run(jobs, postings, order, profile, as_of, **options)
    # The action flags are stored with the rows they describe, and counted by the write's own pass; readers of the
    # history ask for its own columns only.
    counters = (F.count_if(F.col("action") == "inserted").alias("new"), F.count_if(F.col("closed_now")).alias("closed"))
    stored = spark.read.parquet(write_version(result.jobs.observe(merged, *counters), root, version))
    metrics = spark.createDataFrame([(read.get["scraped"], merged.get["new"], merged.get["closed"])], "scraped bigint, new bigint, closed bigint")
    finished = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    append_run(
        spark, f"{root}/_runs", version, started, finished, metrics, sources_ok, sources_failed, errors or []
    )
    return RunResult(stored, metrics)


def replay_bronze(bronze: DataFrame, day: str, order: list[str], columns: Collection[str] | None = None) -> DataFrame:
    """The history rebuilt from all raw snapshots, as if each day had been merged in turn.

    ``bronze`` holds conformed snapshots with a partition column ``day``.  Without user edits the
    merges compose, so a single fold ordered by day and position replaces one merge per day.  The snapshots are
    stored once: the fold counts them and deals them out from there.  ``columns`` names the
    columns of the history that are wanted, all by default.
    """
    names = [c for c in POSTING.names if columns is None or c in columns or c in ("job_id", "jd_content_hash")]
    folded = fold_run(materialise(bronze.select(*dict.fromkeys([*names, day, *order])), "bronze", compression="zstd"), [day, *order], columns)
    made = {
        "job_id": F.col("job_id"), "first_seen": F.col(f"first_at.{day}"), "last_seen": F.col(f"last_at.{day}"),
        "status": F.lit("new"), "notes": F.lit(""), "last_user_edit": F.lit(None),
    }

    def column(name: str) -> Column:
        if name in made:
            return made[name]
        first = F.col(f"first.{name}")
        if name not in CONTENT_COLUMNS:
            return first
        return F.when(F.col("changed").isNotNull(), F.col(f"changed.{name}")).otherwise(first)

    return folded.select(*[column(f.name).cast(f.dataType).alias(f.name) for f in HISTORY.fields if columns is None or f.name in columns])
