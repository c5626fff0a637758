"""Derived inputs: what is folded and carried, against a direct computation on rows of its own."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postings_engine.plans import reports as R
from postings_engine.queries.inputs import ORDER, Inputs
from postings_engine.queries.merging import close_stale, in_run_last_change, metrics_of_run, update_scores
from postings_engine.queries.registry import Tables
from postings_engine.queries.scores import apply_scores
from postings_engine.schema import HISTORY, POSTING


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, pick = tmp_path_factory.mktemp("tables"), random.Random(5)
    day = lambda n: dt.datetime(1999, 1, 1, 13) + dt.timedelta(days=n)
    maybe = lambda v: None if pick.random() < 0.05 else v
    rows = {
        "nation": ("n_nationkey int, n_name string", [(i, f"Nation {i}") for i in range(3)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(i, f"Firm {i}" if i else None, i % 3) for i in range(4)]),
        "part": ("p_partkey long, p_type string", [(i, f"TYPE {i % 3}") for i in range(12)]),
        "orders": ("o_orderkey long, o_orderdate timestamp, o_orderpriority string",
                   [(i, maybe(day(i)), maybe(f"{i % 5 + 1}-X")) for i in range(40)]),
        "documents": ("doc_id long, text string", [(i, f"text {i}") for i in range(7)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_shipdate timestamp",
                     [(pick.randrange(40), pick.randrange(12), pick.randrange(4), pick.randrange(1, 8), maybe(float(pick.randrange(1, 50))),
                       100.0 + n, 0.1, 0.2, maybe(day(pick.randrange(90)))) for n in range(600)]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return Tables(spark, str(at))


def test_jobs_are_first_records(tables):
    own = Window.partitionBy("job_id")
    ranked = tables.inputs.keyed().withColumns({
        "first_seen": F.min("seen_date").over(own), "last_seen": F.max("seen_date").over(own), "rn": F.row_number().over(own.orderBy(*ORDER))})
    plain = ["job_id", "first_seen", "last_seen", "source", "title", "company", "url", "location", "lat", "lon", "salary_raw",
             "posted_date", "doc_id", "l_partkey", "l_quantity"]
    expected = {r["job_id"]: r for r in ranked.filter("rn = 1").select(*plain).collect()}
    found = tables.inputs.jobs()
    assert tuple(found.columns) == Inputs.JOB_COLUMNS
    got = {r["job_id"]: r for r in found.select(*plain).collect()}
    assert None in expected and set(got) == set(expected)
    assert [(got[k], v) for k, v in expected.items() if got[k] != v] == []
    for some in (("company", "status", "last_seen"), ("job_id", "closes_on", "fit_score"), ("url", "ranker_version")):
        assert sorted(tables.inputs.jobs(*some).collect(), key=str) == sorted(found.select(*some).collect(), key=str)


def test_folded_rows_carry_what_is_wanted(spark, tables):
    spark.conf.set("spark.sql.debug.maxToStringFields", "200")

    def carried(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return re.search(r"min\(struct\(([^)]*)\)", plan)[1]

    assert "_url" in carried(tables.inputs.jobs()) and "salary_raw" not in carried(tables.inputs.jobs())
    few = carried(tables.inputs.jobs("company", "status", "last_seen"))
    assert "s_name" in few and not re.search("_url|n_name|n_nationkey|o_orderdate", few)
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_scores_read_the_postings_once(tables):
    jobs = tables.inputs.jobs().select("job_id")
    # A posting without an id, which has a company or title of NULL, gets no batch.
    for made, expected in ((update_scores(tables), jobs), (apply_scores(tables), jobs.filter("job_id IS NOT NULL"))):
        assert "lineitem" not in made._jdf.queryExecution().toString() and made.count() == expected.count()


def test_sheet_is_sorted_without_texts(spark):
    jobs = spark.createDataFrame(
        [("a", "Clerk", "junior needed " * 9, 5.0), ("b", "Senior clerk", None, None), ("c", None, "", 7.0)],
        "job_id string, title string, description string, fit_score double").withColumns({
            **{c: F.lit("x") for c in ("company", "location", "salary_raw", "url", "fit_reason", "status", "notes", "source", "matched_query", "ranker_version")},
            **{c: F.lit("1999-01-01").cast("date") for c in ("closes_on", "posted_date", "first_seen")},
            "matched_keywords": F.array(F.lit("k")), "salary_min": F.lit(1), "salary_max": F.lit(2)})
    sheet = R.export_jobs_view(jobs, "1999-01-02")
    assert [(r["Job ID"], r["Experience"]) for r in sheet.collect()] == [("c", "Unspecified"), ("a", "Junior"), ("b", "Senior/Lead")]
    sort = re.search(r"Sort \[.*", sheet._jdf.queryExecution().optimizedPlan().toString(), re.S)[0]
    assert "AS _level" in sort


def test_stored_history_is_the_first_record(tables):
    day = F.lit("1999-02-20").cast("date")
    own = Window.partitionBy("job_id")
    versions = tables.inputs.versions().filter(F.col("seen_date") < day)
    ranked = tables.inputs.records(versions).withColumns({
        "first_seen": F.min("seen_date").over(own), "last_seen": F.max("seen_date").over(own), "rn": F.row_number().over(own.orderBy(*ORDER))})
    plain = [*POSTING.names, "first_seen", "last_seen"]
    expected = ranked.filter("rn = 1").select(*plain).collect()
    found = tables.inputs.history(F.col("seen_date") < day)
    assert found.columns == HISTORY.names
    assert len(expected) > 20 and sorted(found.select(*plain).collect(), key=str) == sorted(expected, key=str)
    for some in (("job_id", "status", "last_seen"), ("job_id", "jd_content_hash"), ("job_id", "url", "description", "notes")):
        few = tables.inputs.history(F.col("seen_date") < day, *some)
        assert set(few.columns) == set(some) and sorted(few.collect(), key=str) == sorted(found.select(*few.columns).collect(), key=str)


def test_history_of_missing_and_repeated_documents(spark, tables):
    inputs = Inputs(Tables(spark, tables.folder))
    docs = tables.documents
    # A record without its document does not count, and one whose document is there twice counts once.
    inputs.t.documents = docs.filter("doc_id < 3").unionByName(docs.filter("doc_id < 3")).unionByName(docs.filter("doc_id = 0").withColumn("doc_id", F.lit(99).cast("long")))
    every = F.lit(True)
    ids = sorted(map(str, (r[0] for r in inputs.versions().select("job_id").distinct().collect())))
    assert ids and sorted(str(r["job_id"]) for r in inputs.history(every).collect()) == ids
    assert sorted(str(r["job_id"]) for r in inputs.history(every, "job_id", "status").collect()) == ids
    assert sorted(inputs.version_records().collect(), key=str) == sorted(inputs.records(inputs.versions()).collect(), key=str)


def test_merges_shuffle_narrow_rows(spark, tables):
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    t = tables
    closed = close_stale(t)
    assert not re.search("s_nationkey#|n_name#|sha2|salary_raw", re.search(r"min\(struct\(([^)]*)\)", plan(closed))[1])
    assert "sha2" not in plan(closed) and "salary_raw" not in plan(closed)
    assert "salary_raw" not in plan(metrics_of_run(t)) and "salary_raw" not in plan(in_run_last_change(t))
    spark.conf.unset("spark.sql.debug.maxToStringFields")
