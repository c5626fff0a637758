"""Merging a run's postings and the user's edits into the history table.

One full outer join on ``job_id`` replaces a lookup and an update per record.  User-owned columns
(status, notes) and first-seen facts of known postings are never overwritten.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import is_stale
from ..schema import CONTENT_COLUMNS, HISTORY, POSTING, SCORE_COLUMNS
from .dedup import cap_per_group, previous_in_group
from .filters import f_status_valid

# Parts that the records of one posting are dealt to where they meet its last change.
SPREAD = 16
# Records are counted by so many buckets of ids.  Postings of a bucket that holds more than FREQUENT records and a
# SHARE-th part of all are folded without gathering one posting's records in a task.
BUCKETS, FREQUENT, SHARE = 1 << 16, 1 << 17, 1024

_PAYLOAD = [f.name for f in POSTING.fields if f.name != "job_id"]


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def sync_actions(existing: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """What each incoming record does: ``inserted``, ``updated_jd`` or ``updated_meta``.

    Records of one posting apply in ``order``; each is compared with the text hash left by its
    predecessor, the first one with the stored hash.
    """
    known = existing.select("job_id", F.col("jd_content_hash").alias("_stored"), F.lit(True).alias("_known"))
    narrow = incoming.select("job_id", "jd_content_hash", *[c for c in order if c not in ("job_id", "jd_content_hash")])
    rows = previous_in_group(narrow, "job_id", order, "jd_content_hash", "_previous").join(known, "job_id", "left")
    first = F.col("_previous").isNull()
    before = F.when(first, F.col("_stored")).otherwise(F.col("_previous.value"))
    action = (
        F.when(first & F.col("_known").isNull(), "inserted")
        .when(_same(before, F.col("jd_content_hash")), "updated_meta")
        .otherwise("updated_jd")
    )
    return rows.withColumn("action", action).drop("_previous", "_stored", "_known")


def last_changes(incoming: DataFrame, order: list[str]) -> DataFrame:
    """``(job_id, _first, _last, _changed)``: positions (structs of ``order``) of a posting's first and last record, and of the last whose text hash differs from its predecessor's.

    That record is the first one, after the last record with any other hash, that has the last record's hash.  So nothing is
    sorted: records are reduced to one row per posting and hash inside the map tasks, the two hashes seen last
    decide, and only postings with several hashes are looked at again, dealt out by position: a posting that
    holds a third of all records is spread at every step.  ``_changed`` is NULL when all records carry the same text.
    """
    at = F.struct(*order)
    narrow = incoming.select("job_id", F.col("jd_content_hash").alias("_hash"), at.alias("_at"))
    seen = narrow.groupBy("job_id", "_hash").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    ends = seen.groupBy("job_id").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.count(F.lit(1)).alias("_hashes"))
    several = ends.filter(F.col("_hashes") > 1).select("job_id")
    two = cap_per_group(seen.join(several, "job_id", "left_semi"), ["job_id"], [F.desc("_last")], 2)
    tail = two.groupBy("job_id").agg(F.max_by("_hash", "_last").alias("_tail"), F.min("_last").alias("_other"))
    # Each of these postings meets its records in SPREAD parts.
    dealt = tail.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    parts = narrow.withColumn("_part", F.pmod(F.xxhash64("_at"), F.lit(SPREAD)).cast("int"))
    same = (parts["job_id"] == dealt["job_id"]) & (parts["_part"] == dealt["_part"]) & parts["_hash"].eqNullSafe(dealt["_tail"])
    changed = parts.join(dealt, same).filter(F.col("_at") > F.col("_other")).groupBy(parts["job_id"]).agg(F.min("_at").alias("_changed"))
    return ends.join(changed, "job_id", "left").select("job_id", "_first", "_last", "_changed")


def fold_run(incoming: DataFrame, order: list[str], columns: Collection[str] | None = None) -> DataFrame:
    """One row per posting of a run: ``first`` record and ``changed`` content.

    ``changed`` holds the content of the last record whose text differs from its predecessor's;
    it is NULL when all records of the run carry the same text.  ``first_at`` and ``last_at`` are the positions, structs
    of ``order``, of its first and last record.  Records are dealt out by id, once, and folded where they lie.  Only those of
    postings that would fill a task are spread (:func:`_fold_spread`): a count per bucket of ids, a subquery, tells them apart.
    ``incoming`` is read for the count and for both ways: store it first if it is costly to derive.  ``columns`` names the columns that the two records are
    wanted for, all by default: no field of a folded struct is pruned by itself.  The hash is always among them.
    """
    wanted = {c for c in (*_PAYLOAD, "jd_content_hash") if columns is None or c in columns or c == "jd_content_hash"}
    known = incoming.filter(F.col("job_id").isNotNull()).select("job_id", *dict.fromkeys([*order, *[c for c in incoming.columns if c in wanted]]))
    frequent = F.array_contains(_frequent_buckets(known), _bucket())
    return _fold_gathered(known.filter(~frequent), order, wanted).unionByName(_fold_spread(known.filter(frequent), order, wanted))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int")


def _frequent_buckets(rows: DataFrame) -> Column:
    """The buckets of ids whose records are too many for one task, a short array: a scalar subquery."""
    counts = rows.groupBy(_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    large = F.collect_list(F.when(F.col("n") > FREQUENT, F.struct("bucket", "n"))).alias("large")
    found = counts.agg(large, F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    return found.select(F.transform(F.filter("large", lambda b: b["n"] * SHARE > F.col("all")), lambda b: b["bucket"])).scalar()


def _folded(rows: DataFrame, wanted: Collection[str], *more: Column) -> DataFrame:
    """The ``first`` and ``changed`` records of postings, from rows that carry ``_at``, ``_first`` and ``_changed``."""
    payload, content = ([c for c in names if c in wanted] for names in (_PAYLOAD, CONTENT_COLUMNS))
    return rows.groupBy("job_id").agg(
        F.min_by(F.struct(*payload), F.when(F.col("_at") == F.col("_first"), F.col("_at"))).alias("first"),
        F.min_by(F.struct(*content), F.when(F.col("_at") == F.col("_changed"), F.col("_at"))).alias("changed"),
        *more,
    )


def _fold_gathered(rows: DataFrame, order: list[str], wanted: Collection[str]) -> DataFrame:
    """:func:`fold_run` with the records of a posting in one task; they cross the network once, and no position twice in a row."""
    own, hash_ = Window.partitionBy("job_id"), F.col("jd_content_hash")
    # Rows are dealt before positions are made of their columns.
    dealt = rows.repartition("job_id").withColumn("_at", F.struct(*order))
    # As in last_changes: the first record, after the last with any other hash, that has the last record's hash.
    ends = dealt.withColumns({"_first": F.min("_at").over(own), "_last": F.max("_at").over(own),
                              "_tail": F.max_by(F.struct("jd_content_hash"), "_at").over(own)})
    same = _same(hash_, F.col("_tail.jd_content_hash"))
    others = ends.withColumn("_other", F.max(F.when(~same, F.col("_at"))).over(own))
    marked = others.withColumn("_changed", F.min(F.when(same & (F.col("_at") > F.col("_other")), F.col("_at"))).over(own))
    ours = marked.filter((F.col("_at") == F.col("_first")) | (F.col("_at") == F.coalesce("_changed", "_first")))
    return _folded(ours, wanted, F.min("_first").alias("first_at"), F.max("_last").alias("last_at"))


def _fold_spread(rows: DataFrame, order: list[str], wanted: Collection[str]) -> DataFrame:
    """:func:`fold_run` for frequent postings, whose records are spread over the tasks at every step.

    The two records that matter are found by ids, positions and hashes alone and then fetched by id and position.
    """
    marks = last_changes(rows, order)
    at = marks.select("job_id", F.explode(F.array_distinct(F.array("_first", F.coalesce("_changed", "_first")))).alias("_at"),
                      "_first", "_changed", "_last")
    fetched = rows.withColumn("_at", F.struct(*order)).join(at, ["job_id", "_at"])
    return _folded(fetched, wanted, F.min("_first").alias("first_at"), F.max("_last").alias("last_at"))


def sync(
    existing: DataFrame, incoming: DataFrame, order: list[str], run_date, columns: Collection[str] | None = None,
) -> DataFrame:
    """The history table after a run, with an ``action`` column.

    ``action`` is ``inserted``, ``updated_jd``, ``updated_meta`` or, for postings the run did not
    bring, ``kept``.  New postings start as ``new``; known ones get ``last_seen`` and, when the
    text changed, the content columns.  ``incoming`` is read twice, so store it if it is costly to derive.
    ``columns`` names the columns wanted, all of the history by default; ``existing`` needs these, ``job_id`` and the hash alone.
    """
    run_date = F.lit(run_date).cast("date")
    wanted = [c for c in HISTORY.names if columns is None or c in columns]
    folded = fold_run(incoming, order, columns)
    # The id stays a column of its own so that a table bucketed by it keeps its partitioning.
    old = existing.select(
        F.col("job_id").alias("_old_id"), F.struct(*[c for c in HISTORY.names if c in wanted or c in ("job_id", "jd_content_hash")]).alias("old")
    )
    joined = old.join(folded, F.col("_old_id") == F.col("job_id"), "full_outer")
    known, seen = F.col("old").isNotNull(), F.col("job_id").isNotNull()

    first_differs = ~_same(F.col("old.jd_content_hash"), F.col("first.jd_content_hash"))
    first_content = F.struct(*[F.col(f"first.{c}").alias(c) for c in CONTENT_COLUMNS if c in wanted or c == "jd_content_hash"])
    # A new posting is its first record plus any later change; a known one changes only when
    # the run brought a different text.
    content = F.coalesce(F.col("changed"), F.when(seen & (~known | first_differs), first_content))
    joined = joined.withColumn("_content", content)
    updated = F.col("_content").isNotNull()

    def column(name: str) -> Column:
        if name == "job_id":
            return F.coalesce("old.job_id", "job_id")
        if name == "first_seen":
            return F.coalesce("old.first_seen", run_date)
        if name == "last_seen":
            return F.when(seen, run_date).otherwise(F.col("old.last_seen"))
        if name == "status":
            return F.coalesce("old.status", F.lit("new"))
        if name == "notes":
            return F.coalesce("old.notes", F.lit(""))
        if name == "last_user_edit":
            return F.col("old.last_user_edit")
        stored = F.when(known, F.col(f"old.{name}")).otherwise(F.col(f"first.{name}"))
        if name in CONTENT_COLUMNS:
            return F.when(updated, F.col(f"_content.{name}")).otherwise(stored)
        return stored

    action = (
        F.when(~seen, "kept").when(~known, "inserted").when(updated, "updated_jd").otherwise("updated_meta")
    )
    return joined.select(*[column(c).alias(c) for c in wanted], action.alias("action"))


def sync_touched(
    existing: DataFrame, incoming: DataFrame, order: list[str], run_date, columns: Collection[str] | None = None,
) -> DataFrame:
    """:func:`sync` limited to the postings a run brought: the rows of a delta.

    The history is first reduced to the incoming ids.
    """
    ids = incoming.select("job_id").distinct()
    return sync(existing.join(ids, "job_id", "left_semi"), incoming, order, run_date, columns)


def sync_diff(existing: DataFrame, incoming: DataFrame, order: list[str], run_date) -> DataFrame:
    """A dry run: postings that would be inserted or get a new text; nothing is written."""
    merged = sync(existing, incoming, order, run_date, ("job_id", "title", "company"))
    return merged.filter(F.col("action").isin("inserted", "updated_jd")).select(
        "job_id", "action", "title", "company"
    )


def close_stale(jobs: DataFrame, as_of, stale_days: int = 14) -> DataFrame:
    """Postings still ``new`` but unseen for more than ``stale_days`` become ``closed``.

    Adds a boolean ``closed_now`` for counting.
    """
    stale = (F.col("status") == "new") & is_stale("last_seen", F.lit(as_of), stale_days)
    return jobs.withColumn("closed_now", stale).withColumn(
        "status", F.when(F.col("closed_now"), F.lit("closed")).otherwise(F.col("status"))
    )


def rejected_edits(edits: DataFrame) -> DataFrame:
    """Edit rows with an unknown status; they are skipped as a whole."""
    return edits.filter(~f_status_valid())


def import_edits(jobs: DataFrame, edits: DataFrame) -> DataFrame:
    """Jobs after the user's edits, with ``edited`` and ``conflict`` flags and ``edits_applied``.

    ``edits(job_id, status, notes, edited_at, row_no)`` apply one after another by time and row: a blank status
    keeps the current one while blank notes erase, and a row that changes nothing is ignored.  A row applied
    to a job that was edited after ``edited_at`` is a conflict, which is flagged; the edit still wins.
    """
    # Only the first row applied can be a conflict: it leaves its own time, and later rows are no older.
    in_order = Window.partitionBy("job_id").orderBy("edited_at", "row_no")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    blank = F.lit("")
    now = jobs.select("job_id", F.coalesce("status", blank).alias("_status"), F.coalesce("notes", blank).alias("_notes"))
    rows = edits.filter(f_status_valid()).select(
        "job_id", F.coalesce("status", blank).alias("status"), F.coalesce("notes", blank).alias("notes"), "edited_at", "row_no",
    ).join(now, "job_id")
    given = F.nullif(F.col("status"), blank)
    before_status = F.coalesce(F.last(given, ignorenulls=True).over(earlier), F.col("_status"))
    before_notes = F.coalesce(F.lag("notes").over(in_order), F.col("_notes"))
    rows = rows.withColumn("_applied", (F.col("status") != before_status) | (F.col("notes") != before_notes))
    position, applied = F.struct("edited_at", "row_no"), F.col("_applied")
    folded = rows.groupBy("job_id").agg(F.struct(
        F.count_if(applied).alias("applied"),
        F.max_by(given, F.when(given.isNotNull(), position)).alias("status"),
        F.max_by("notes", position).alias("notes"),
        F.min(F.when(applied, F.col("edited_at"))).alias("first_at"),
        F.max(F.when(applied, F.col("edited_at"))).alias("edited_at"),
    ).alias("edit"))
    joined = jobs.join(folded, "job_id", "left").withColumn("edits_applied", F.coalesce("edit.applied", F.lit(0).cast("bigint")))
    joined = joined.withColumn("edited", F.col("edits_applied") > 0)
    newer = F.coalesce(F.col("last_user_edit") > F.col("edit.first_at"), F.lit(False))
    edited = F.col("edited")
    return joined.withColumn("conflict", edited & newer).withColumns({
        "status": F.when(edited, F.coalesce("edit.status", "status")).otherwise(F.col("status")),
        "notes": F.when(edited, F.col("edit.notes")).otherwise(F.col("notes")),
        "last_user_edit": F.when(edited, F.col("edit.edited_at")).otherwise(F.col("last_user_edit")),
    }).select(*jobs.columns, "edited", "conflict", "edits_applied")


def update_scores(jobs: DataFrame, scores: DataFrame) -> DataFrame:
    """Write the five ranking columns of the given ids; other rows stay as they are."""
    new = scores.select("job_id", F.struct(*SCORE_COLUMNS).alias("_new"))
    joined = jobs.join(new, "job_id", "left")
    return joined.withColumns({
        c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in SCORE_COLUMNS
    }).select(*jobs.columns)
