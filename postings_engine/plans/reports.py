"""Report views over the history table: counts, top-k lists and the exported sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.classify import (
    closes_soon, experience_level, next_step, priority_label, priority_order,
)
from ..functions.columns import ColumnLike
from ..functions.dates import days_left
from ..operators.filters import f_open_status
from ..schema import OVERVIEW_PRIORITIES, STATUSES
from .costs import cache_hit_rate, cost_projection, cost_today

# Sizes and limits of the views.
NEW_TODAY_ROWS = 50
CLOSING_ROWS = 20
DIGEST_CLOSING_ROWS = 10
HIGH_FIT_ROWS = 20
MID_FIT_ROWS = 10
CANDIDATE_ROWS = 50
OVERVIEW_ROWS = 15
CLOSING_DAYS = 7
RECENT_RUNS = 30
HIGH_FIT = 7
MID_FIT = 5
PASSIVE_SCORE = 9


def _day(as_of) -> Column:
    return F.lit(as_of).cast("date")


def labels(spark: SparkSession, values: tuple[str, ...], name: str) -> DataFrame:
    """A fixed list of labels as ``(position, name)`` rows."""
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(v).alias(name)) for i, v in enumerate(values)])
    return spark.range(1).select(F.explode(pairs).alias("p")).select("p.*")


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "status")


def _full_counts(counts: DataFrame, all_labels: DataFrame, name: str) -> DataFrame:
    return all_labels.join(counts, name, "left").select(
        "position", name, F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt")
    )


def status_counts_full(jobs: DataFrame) -> DataFrame:
    """Count of every status a user may set, those without postings included."""
    return _full_counts(status_counts(jobs), labels(jobs.sparkSession, STATUSES, "status"), "status")


def with_priority(jobs: DataFrame, as_of) -> DataFrame:
    return jobs.withColumn("priority", priority_label("status", "fit_score", "closes_on", _day(as_of)))


def priority_counts(jobs: DataFrame, as_of) -> DataFrame:
    counts = with_priority(jobs, as_of).groupBy("priority").agg(F.count(F.lit(1)).alias("cnt"))
    return _full_counts(counts, labels(jobs.sparkSession, OVERVIEW_PRIORITIES, "priority"), "priority")


def jobs_sorted(jobs: DataFrame) -> DataFrame:
    """All postings in sheet order: a range-partitioned sort."""
    return jobs.orderBy(F.col("fit_score").desc_nulls_last(), F.desc("first_seen"), "job_id")


def overview_candidates(jobs: DataFrame, rows: int = CANDIDATE_ROWS) -> DataFrame:
    wanted = F.col("fit_score").isNull() | (F.col("fit_score") >= MID_FIT) | (F.col("status") != "new")
    return jobs.filter(wanted).orderBy(
        F.col("fit_score").desc_nulls_last(), F.col("closes_on").isNull(), "closes_on",
        F.desc("first_seen"), "job_id",
    ).limit(rows)


def overview_top(jobs: DataFrame, as_of, rows: int = OVERVIEW_ROWS) -> DataFrame:
    """The candidates re-sorted by priority; the level is inferred for these few rows only."""
    ranked = with_priority(overview_candidates(jobs), as_of)
    top = ranked.orderBy(
        priority_order("priority"), "priority",
        # A missing or zero score sorts as -1.
        F.coalesce(F.nullif(F.col("fit_score"), F.lit(0.0)), F.lit(-1.0)).desc(),
        F.coalesce("closes_on", F.lit("9999-12-31").cast("date")), "job_id",
    ).limit(rows)
    return top.withColumn("experience", experience_level("title", "description"))


def new_today(jobs: DataFrame, as_of, rows: int = NEW_TODAY_ROWS) -> DataFrame:
    due = F.col("closes_on") <= F.date_add(_day(as_of), CLOSING_DAYS)
    return jobs.filter((F.col("first_seen") == _day(as_of)) & (F.col("status") == "new")).withColumn(
        "closes_soon", due
    ).orderBy(F.col("fit_score").desc_nulls_last(), "job_id").limit(rows)


def closing_soon(jobs: DataFrame, as_of, rows: int = CLOSING_ROWS) -> DataFrame:
    """Open postings closing within a week; dates already past are included."""
    due = F.col("closes_on") <= F.date_add(_day(as_of), CLOSING_DAYS)
    return jobs.filter(due & f_open_status()).orderBy("closes_on", "job_id").limit(rows)


def _fit(jobs: DataFrame, as_of, wanted: Column, rows: int) -> DataFrame:
    fresh = jobs.filter((F.col("first_seen") == _day(as_of)) & (F.col("status") == "new") & wanted)
    return fresh.orderBy(F.desc("fit_score"), "job_id").limit(rows)


def high_fit(jobs: DataFrame, as_of, rows: int = HIGH_FIT_ROWS) -> DataFrame:
    return _fit(jobs, as_of, F.col("fit_score") >= HIGH_FIT, rows)


def mid_fit(jobs: DataFrame, as_of, rows: int = MID_FIT_ROWS) -> DataFrame:
    return _fit(jobs, as_of, (F.col("fit_score") >= MID_FIT) & (F.col("fit_score") < HIGH_FIT), rows)


def digest_counts(jobs: DataFrame, as_of) -> DataFrame:
    """``(jobs_new, jobs_high_fit)`` of a digest: counted after the lists' limits."""
    lists = high_fit(jobs, as_of).select(F.lit(True).alias("high")).unionAll(
        mid_fit(jobs, as_of).select(F.lit(False).alias("high"))
    )
    return lists.agg(
        F.count(F.lit(1)).alias("jobs_new"), F.count_if(F.col("high")).alias("jobs_high_fit")
    )


def digest_tables(jobs: DataFrame, as_of) -> dict[str, DataFrame]:
    return {
        "closing_soon": closing_soon(jobs, as_of, DIGEST_CLOSING_ROWS),
        "high_fit": high_fit(jobs, as_of),
        "mid_fit": mid_fit(jobs, as_of),
        "status_counts": status_counts(jobs),
        "counts": digest_counts(jobs, as_of),
    }


def dashboard_tables(jobs: DataFrame, runs: DataFrame, calls: DataFrame, as_of) -> dict[str, DataFrame]:
    """The tables behind the dashboard."""
    return {
        "last_run": latest_run(runs),
        "new_today": new_today(jobs, as_of),
        "closing_soon": closing_soon(jobs, as_of),
        "cost_today": cost_today(calls, as_of),
        "cost_projection": cost_projection(calls, as_of),
        "cache_hit_rate": cache_hit_rate(calls, as_of),
    }


def passive_digest(jobs: DataFrame, as_of) -> DataFrame:
    """Weekly view of the passive mode: postings of the last seven days scored 9 or better."""
    week = F.col("first_seen") > F.date_sub(_day(as_of), 7)
    up_to = F.col("first_seen") <= _day(as_of)
    return jobs.filter(week & up_to & (F.col("fit_score") >= PASSIVE_SCORE))


def export_jobs_view(jobs: DataFrame, as_of) -> DataFrame:
    """The 22-column sheet, in sheet order, derived columns included."""
    day = _day(as_of)
    # The rows are sorted without their texts: the level, all that is read of them, is inferred first.
    levelled = jobs.withColumn("_level", experience_level("title", "description")).drop("description")
    rows = with_priority(jobs_sorted(levelled), as_of)
    return rows.select(
        F.col("priority").alias("Action"),
        F.col("fit_score").alias("Score"),
        F.col("_level").alias("Experience"),
        F.col("title").alias("Title"),
        F.col("company").alias("Company"),
        F.col("location").alias("Location"),
        F.col("salary_raw").alias("Salary"),
        F.col("closes_on").alias("Closes"),
        days_left("closes_on", day).alias("Days Left"),
        F.col("url").alias("Apply"),
        F.col("fit_reason").alias("Fit Reason"),
        F.col("status").alias("Status"),
        F.col("notes").alias("Notes"),
        F.col("job_id").alias("Job ID"),
        F.col("posted_date").alias("Posted"),
        F.col("source").alias("Source"),
        F.array_join("matched_keywords", ", ").alias("Matched Keywords"),
        F.col("matched_query").alias("Query"),
        F.col("salary_min").alias("Salary Min"),
        F.col("salary_max").alias("Salary Max"),
        F.col("first_seen").alias("First Seen"),
        F.col("ranker_version").alias("Ranker Ver."),
    )


def next_steps(jobs: DataFrame, as_of) -> DataFrame:
    rows = with_priority(jobs, as_of)
    return rows.withColumn("next_step", next_step("status", "priority")).withColumn(
        "due_soon", closes_soon("closes_on", _day(as_of))
    )


# --- views that are only described, not coded, in the original design ----------------------


def kanban(jobs: DataFrame) -> DataFrame:
    """Board rows in column order, as a long table: a column may hold most of the postings, so
    it is never gathered into one list."""
    positions = F.create_map(*[F.lit(x) for i, s in enumerate(STATUSES) for x in (s, i)])
    return jobs.select(
        F.try_element_at(positions, F.col("status")).alias("column_no"),
        "status", "job_id", "title", "company", "fit_score",
    ).orderBy("column_no", F.col("fit_score").desc_nulls_last(), "job_id")


def top_employers_month(jobs: DataFrame, as_of, rows: int = 10) -> DataFrame:
    """Companies with most postings first seen in the month of ``as_of``."""
    day = _day(as_of)
    month = (F.col("first_seen") >= F.trunc(day, "month")) & (F.col("first_seen") <= F.last_day(day))
    return jobs.filter(month).groupBy("company").agg(F.count(F.lit(1)).alias("cnt")).orderBy(
        F.desc("cnt"), "company"
    ).limit(rows)


def calibration_pairs(jobs: DataFrame) -> DataFrame:
    """How often a well-scored posting was rejected by the user."""
    hit = (F.col("fit_score") >= HIGH_FIT) & (F.col("status") == "rejected")
    return jobs.agg(F.count_if(hit).alias("rejected_high"), F.count(F.lit(1)).alias("total"))


def rerank_stale(jobs: DataFrame, current_version: str) -> DataFrame:
    """Scored postings whose scores come from another ranker version."""
    return jobs.filter(
        F.col("fit_score").isNotNull() & ~F.col("ranker_version").eqNullSafe(F.lit(current_version))
    )


def rank_expiry(jobs: DataFrame, as_of, scored_on: ColumnLike, days: int = 30) -> DataFrame:
    """Postings whose score is older than ``days``; ``scored_on`` is the day of the last scoring.

    The history keeps no such day of its own: name the column that your scoring writes.
    """
    column = F.col(scored_on) if isinstance(scored_on, str) else scored_on
    return jobs.filter(F.datediff(_day(as_of), column) > days)


# --- runs -----------------------------------------------------------------------------------


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by(F.struct(*runs.columns), "id").alias("r")).select("r.*")


def recent_runs(runs: DataFrame, rows: int = RECENT_RUNS) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(rows)


def quiet_streak(runs: DataFrame, source: str, n: int = 3) -> DataFrame:
    """Runs with ``quiet``: they and the ``n - 1`` runs before them, per source, brought nothing.

    A source has one run a day, so its window stays short however many sources there are.
    """
    window = Window.partitionBy(source).orderBy("id").rowsBetween(-(n - 1), 0)
    seen = F.count(F.lit(1)).over(window)
    return runs.withColumn("quiet", (F.sum("jobs_new").over(window) == 0) & (seen == n))


def heartbeat_due(
    runs: DataFrame, as_of, last_sent=None, n: int = 3, suppress_days: int = 7
) -> DataFrame:
    """One row ``(quiet, due)``: the last ``n`` runs brought nothing and no mail went out lately."""
    last = runs.orderBy(F.desc("id")).limit(n)
    quiet = (F.coalesce(F.sum("jobs_new"), F.lit(0)) == 0) & (F.count(F.lit(1)) == n)
    sent = F.lit(last_sent).cast("date")
    allowed = sent.isNull() | (F.datediff(_day(as_of), sent) >= suppress_days)
    return last.agg(quiet.alias("quiet")).withColumn("due", F.col("quiet") & allowed)


def source_health_rag(health: DataFrame, source: str, day: str) -> DataFrame:
    """Latest state per source: green without bad records, amber with some, red with only bad."""
    latest = health.groupBy(source).agg(
        F.max_by(F.struct(day, "records", "corrupt"), day).alias("h")
    ).select(source, "h.*")
    colour = (
        F.when(F.col("corrupt") == 0, "green").when(F.col("corrupt") < F.col("records"), "amber").otherwise("red")
    )
    return latest.withColumn("colour", colour)


def run_metrics(merged: DataFrame) -> DataFrame:
    """``(scraped, new, closed)`` style counters of a merged table with ``action`` (and, after
    stale closing, ``closed_now``)."""
    closed = F.count_if(F.col("closed_now")) if "closed_now" in merged.columns else F.lit(0).cast("bigint")
    return merged.agg(
        F.count_if(F.col("action") != "kept").alias("seen"),
        F.count_if(F.col("action") == "inserted").alias("new"),
        F.count_if(F.col("action") == "updated_jd").alias("changed"),
        closed.alias("closed"),
    )


def edit_metrics(edited: DataFrame) -> DataFrame:
    return edited.agg(
        F.sum("edits_applied").alias("updated"), F.count_if(F.col("conflict")).alias("conflicts")
    )
