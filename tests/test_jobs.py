"""Feeds from files, stored tables, the daily run, streams, plans and the driver contract."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from test_operators import ORDER, brute_sync, history, random_rows, record, records

import __spark_entry__ as entry
from postings_engine.functions.text import clean_text
from postings_engine.operators import merge as G
from postings_engine.plans import daily, reports
from postings_engine.queries import load
from postings_engine.schema import HISTORY, POSTING
from postings_engine.sources import landing as L
from postings_engine.sources import shapes as H
from postings_engine.sources import tables as B
from postings_engine.streaming import streams as S

DAY = dt.date(2025, 6, 15)


def test_paged_feed_from_files(spark, tmp_path):
    def item(ident, **more):
        return {"id": ident, "title": f"t{ident}", "company": {"display_name": "Acme"}, "location": {"display_name": "A, B, C"},
                "redirect_url": f"https://x.example/?id={ident}", "created": "2025-06-01T00:00:00Z", "description": "Closing date: 1 July 2025.", **more}

    pages = [
        {"query": "q1", "query_pos": 0, "page": 1, "results": [item("1", salary_min=30000.0, salary_max=35000.5), item("2"), item("")]},
        {"query": "q2", "query_pos": 1, "page": 1, "results": [item("2"), item(""), item("3", title="")]},
    ]
    lines = [json.dumps(p) for p in pages] + ['{"query": "q3", broken']
    (tmp_path / "feed.json").write_text("\n".join(lines), encoding="utf-8")
    landed = L.read_landed(spark, str(tmp_path), H.PAGED_API)
    assert [r["record"] for r in L.quarantine(landed, "s").collect()] == ['{"query": "q3", broken']
    health = L.source_health(landed.withColumn("source", F.lit("s")), "source").first()
    assert (health["records"], health["corrupt"], health["ok"]) == (3, 1, True)
    mapped = H.map_paged_api(H.paged_items(L.good_records(landed)))
    assert mapped.count() == 5
    rows = {r["title"]: r for r in L.conform(mapped, DAY).collect() if r["title"] != "t"}
    assert set(rows) == {"t1", "t2"}
    one = rows["t1"]
    assert (one["salary_raw"], one["salary_min"], one["salary_max"]) == ("£30,000 - £35,000", 30000, 35000)
    assert (one["location"], one["url"], one["closes_on"], one["posted_date"]) == (
        "A, B", "https://x.example/?id=1", dt.date(2025, 7, 1), dt.date(2025, 6, 1))
    assert one["matched_query"] == "q1" and rows["t2"]["matched_query"] == "q1"
    assert set(L.conform(mapped, DAY).columns) == set(POSTING.names)


def test_posting_arrays_from_files(spark, tmp_path):
    rows = [{"slug": "s1", "text": f"t{i}", "hostedUrl": f"https://x.example/{i}", "categories": {"team": "Ops"},
             "lists": [{"text": "Needs", "content": "<li>x</li>"}], "closing": "bye", "createdAt": 1} for i in range(2)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1), encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"slug": "s1", "te', encoding="utf-8")
    landed = L.read_landed(spark, str(tmp_path), H.POSTINGS, multi_line=True)
    assert L.quarantine(landed, "s").count() == 1
    companies = spark.createDataFrame([("s1", "Acme")], "slug string, name string")
    mapped = H.map_postings(H.postings_items(L.good_records(landed), companies)).collect()
    assert {(r["title"], r["company"], r["location"], r["source"]) for r in mapped} == {
        ("t0", "Acme", "Ops", "lever:s1"), ("t1", "Acme", "Ops", "lever:s1")}
    assert mapped[0]["description"] == "Needs\n\n<li>x</li>\n\nbye"


def test_one_missing_feed_does_not_stop_the_others(spark, tmp_path):
    from postings_engine.sources import feeds

    frame = spark.createDataFrame(
        [("https://x.example/1", "t", "Acme", "", "text", "£30k", None, None, None, "q", 0, 0)],
        "job_url string, title string, company string, location string, description string, salary_source string, "
        "min_amount string, max_amount string, date_posted date, query string, query_pos int, pos int")
    frame.write.parquet(str(tmp_path / "frame"))
    found = feeds.gather(spark, [(feeds.Frame(), str(tmp_path / "frame")), (feeds.PagedApi(), str(tmp_path / "absent")),
                                 (feeds.Tenant(), str(tmp_path / "absent"))])
    assert found.ok == ["jobspy"] and set(found.failed) == {"adzuna", "workday"}
    row = L.conform(found.postings, DAY).first()
    assert (row["title"], row["salary_min"], row["source"]) == ("t", 30000, "jobspy")


def test_pay_aliases_are_no_fallback(spark):
    raw = spark.createDataFrame([("a", "Competitive", "30000", None), ("b", "Competitive", None, "30000"), ("c", None, "30000", None)],
                                "title string, salary string, minimum_salary string, salary_min string")
    raw = raw.selectExpr("*", "'Co' as company", "concat('https://x.example/', title) as url")
    assert {r["title"]: r["salary_min"] for r in L.conform(raw, DAY).collect()} == {"a": None, "b": 30000, "c": 30000}


def test_conform_with_packs_and_places(spark):
    raw = spark.createDataFrame([
        ("clerk", "Co", "https://x.example/1", "Leeds", "£20", "Doors shut: 3 May 2026", "care"),
        ("clerk", "Co", "https://x.example/2", "Remote", "£20", "Doors shut: 3 May 2026", "other"),
    ], "title string, company string, url string, location string, salary string, description string, domain string")
    packs = spark.createDataFrame(
        [("care", ("hourly_gbp", True, 1820, 230), [r"Doors shut: ([^\n]+)", "a signal"])],
        "name string, salary struct<default_unit: string, agenda_for_change_bands: boolean, hourly_to_annual_multiplier: int, daily_to_annual_multiplier: int>, closing_date_patterns array<string>")
    places = spark.createDataFrame([("Leeds", 53.8, -1.5)], "location_key string, lat double, lon double")
    got = {r["url"][-1]: (r["salary_min"], r["closes_on"], r["lat"]) for r in L.conform(raw, DAY, places, packs).collect()}
    assert got == {"1": (36400, dt.date(2026, 5, 3), 53.8), "2": (37600, None, None)}


def test_edits_from_csv(spark, tmp_path):
    (tmp_path / "edits.csv").write_text('Title,Status,Job ID,Notes\nx, applied ,a,"two\nlines"\ny,offer,,z\n', encoding="utf-8")
    rows = L.read_edits_csv(spark, str(tmp_path)).collect()
    assert [(r["job_id"], r["status"], r["notes"]) for r in rows] == [("a", "applied", "two\nlines")]
    assert rows[0]["edited_at"] is not None


def test_cost_log_skips_bad_lines(spark, tmp_path):
    good = {"timestamp": "2025-06-15T10:00:00Z", "operation": "rank", "model": "m", "input_tokens": 5, "est_cost_gbp": 0.25}
    (tmp_path / "log.jsonl").write_text(json.dumps(good) + "\n\n{bad\n", encoding="utf-8")
    assert [r["est_cost_gbp"] for r in L.scan_cost_log(spark, str(tmp_path)).collect()] == [0.25]


def test_versions_never_overwrite_what_is_read(spark, tmp_path):
    root = str(tmp_path / "jobs")
    assert B.current_version(spark, root) is None
    for version in (1, 2):
        jobs, _ = brute_sync({}, [record("a", version, "x")], DAY)
        B.write_version(history(spark, jobs), root, version)
    assert B.current_version(spark, root)[0] == 2
    assert B.scan_jobs(spark, root, "job_id", "salary_min").first()["salary_min"] == 2
    assert B.point_lookup(B.scan_jobs(spark, root), "zz").count() == 0


def test_daily_runs(spark, tmp_path):
    root = str(tmp_path / "store")
    profile = {"core_skills": ["python"], "filters": {"salary_floor_gbp": 10}}
    first = [record("a", 20, "python"), record("b", 21, "none"), record("c", 1, "python")]
    result = daily.run_and_store(spark, root, records(spark, first), ORDER, profile, dt.date(2025, 6, 1))
    assert result.metrics.first().asDict() == {"scraped": 3, "new": 2, "closed": 0}
    edits = spark.createDataFrame([("b", "applied", "hi", dt.datetime(2025, 6, 2), 1)], "job_id string, status string, notes string, edited_at timestamp, row_no int")
    daily.run_and_store(spark, root, records(spark, [record("d", 30, "python")]), ORDER, profile, dt.date(2025, 6, 20), edits=edits)
    jobs = {r["job_id"]: r for r in B.scan_jobs(spark, root).collect()}
    assert {k: (r["status"], r["fit_score"]) for k, r in jobs.items()} == {"a": ("closed", 10.0), "b": ("applied", 0.0), "d": ("new", 10.0)}
    runs = spark.read.parquet(f"{root}/_runs")
    last = reports.latest_run(runs).first()
    assert (last["id"], last["jobs_new"], last["jobs_closed"]) == (2, 1, 1)
    assert last["finished_at"] >= last["started_at"]


def test_stream_of_several_batches_equals_sequential_merges(spark, tmp_path):
    rng = random.Random(4)
    rows = random_rows(rng, 60)
    jobs = {}
    for n in range(3):
        part = [r for i, r in enumerate(rows) if i // 20 == n]
        records(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs, _ = brute_sync(jobs, part, DAY)
    stream = spark.readStream.schema(records(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = {k: {f.name: v.get(f.name) for f in HISTORY.fields} for k, v in jobs.items()}
    for compact_every, kinds, version in ((50, ["full", "delta", "delta"], 3), (2, ["full"], 4)):
        root = str(tmp_path / f"out{compact_every}")
        writer = S.stream_sync(stream, root, root + "-progress", ORDER, lambda b: DAY, compact_every)
        writer.trigger(availableNow=True).start().awaitTermination()
        assert B.current_version(spark, root)[0] == version
        assert [e["kind"] for e in B._recorded(spark, root)] == kinds
        assert {r["job_id"]: r.asDict() for r in B.scan_jobs(spark, root).collect()} == want
        # A batch that is replayed after it was recorded changes nothing.
        S.merge_batch(root, ORDER, lambda b: DAY, root + "-progress")(records(spark, rows[:5]), 2)
        assert B.current_version(spark, root)[0] == version
        with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
            B.write_version(history(spark, jobs), root, version)


def test_a_lookup_reads_the_row_group_that_holds_the_id(spark, tmp_path):
    rows = spark.range(8000).select(F.sha1(F.col("id").cast("string")).alias("job_id"), F.col("id").alias("n")).repartition(8)
    table = spark.read.parquet(B.write_version(rows, str(tmp_path / "jobs"), 1))
    wanted = rows.filter("n = 4321").first()["job_id"]
    # All files span nearly all ids, so only their Bloom filters can tell them apart.
    found = B.point_lookup(table, wanted).groupBy().agg(F.max("n").alias("n"))
    assert found.first()["n"] == 4321
    plan = found._jdf.queryExecution().executedPlan().executedPlan()
    while not plan.children().isEmpty() or plan.getClass().getSimpleName().endswith("QueryStageExec"):
        plan = plan.plan() if plan.getClass().getSimpleName().endswith("QueryStageExec") else plan.children().head()
    assert plan.metrics().get("numOutputRows").get().value() < 2000


def test_streams_and_daily_runs_share_a_table(spark, tmp_path):
    root, source = str(tmp_path / "jobs"), str(tmp_path / "in")
    schema = records(spark, [record("a", 1, "x")]).schema

    def streamed(checkpoint, *new):
        for job in new:
            records(spark, [record(job, 1, "x")]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        S.stream_sync(stream, root, str(tmp_path / checkpoint), ORDER, lambda b: DAY).trigger(availableNow=True).start().awaitTermination()
        return {r["job_id"] for r in B.scan_jobs(spark, root).collect()}

    assert streamed("one", "a") == {"a"}
    daily.run_and_store(spark, root, records(spark, [record("b", 1, "x")]), ORDER, {}, DAY)
    assert streamed("one", "c") == {"a", "b", "c"}
    # A new checkpoint counts its batches from 0 again and reads everything once more.
    assert streamed("two", "d") == {"a", "b", "c", "d"}
    assert streamed("one", "e") == {"a", "b", "c", "d", "e"}


def test_bucketed_history_is_not_shuffled_by_the_merge(spark):
    jobs, _ = brute_sync({}, [record(f"j{i}", i, "x") for i in range(50)], DAY)
    spark.sql("DROP TABLE IF EXISTS bucketed_jobs")
    try:
        B.write_jobs_bucketed(history(spark, jobs), "bucketed_jobs", 8)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        merged = G.sync(spark.table("bucketed_jobs"), records(spark, [record("j1", 1, "y")]), ORDER, DAY)
        assert merged.filter("action = 'updated_jd'").count() == 1
        plan = merged._jdf.queryExecution().executedPlan().toString()
        # The history goes into the merge as it lies: the last join's left side has no exchange.
        join = plan[plan.index("FullOuter"):]
        left = join[:join.index("bucketed_jobs")]
        assert "Exchange" not in left, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_jobs")


def test_text_path_has_no_python_and_scans_prune(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = docs.filter("lang = 'en'").select("doc_id", clean_text("text").alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "EqualTo(lang,en)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_shared_folder(spark):
    from types import SimpleNamespace

    from postings_engine.session import CHECKPOINT_CONF, shared_dir

    def session(master, conf):
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))

    assert shared_dir(session("spark://x", {CHECKPOINT_CONF: "/shared/dir/"})) == "/shared/dir"
    with pytest.raises(ValueError):
        shared_dir(session("spark://x", {}))
    local = session("local[2]", {})
    assert shared_dir(local) == shared_dir(local)


def test_driver_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    own, checked = load()
    assert set(own) <= set(queries) and set(own) == set(checked)
    assert entry.entry(spark).count() == 50


@pytest.mark.parametrize("name", ["job_key", "apply_filters", "sync_diff", "bm25_search", "stream_cost", "map_paged_api"])
def test_registered_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    from postings_engine.queries.registry import Tables

    for table in Tables.NAMES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = entry.queries()[name](spark, folder)
    result = con.execute(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(c[0] for c in result.description) == columns
    place = [[c[0] for c in result.description].index(c) for c in columns]
    want = sorted(repr([row[i] for i in place]) for row in result.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want


def test_updates_are_compacted(spark, tmp_path):
    for n in range(9):
        spark.createDataFrame([("a", n), (f"k{n % 2}", 1)], "k string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    totals = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).groupBy("k").agg(F.sum("v").alias("v"))
    root = str(tmp_path / "table")
    writer = S.write_updates(totals, root, str(tmp_path / "progress"), ["k"], compact_every=3)
    writer.trigger(availableNow=True).start().awaitTermination()
    # Nine batches: a full version, then three deltas and a full version, twice, and two deltas.
    assert B.current_version(spark, root)[0] == 11 and B.deltas_since_full(spark, root) == 2
    stored = B.read_updates(spark, root, ["k"])
    assert stored._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 4
    assert {r["k"]: r["v"] for r in stored.collect()} == {"a": 36, "k0": 5, "k1": 4}
