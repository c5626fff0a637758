"""Operators against plain-Python brute force on small tables, hot keys included."""

from __future__ import annotations

import collections
import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postings_engine.operators import dedup as K
from postings_engine.operators import filters as P
from postings_engine.operators import matching as Q
from postings_engine.operators import merge as G
from postings_engine.operators import places as L
from postings_engine.operators import profiles as R
from postings_engine.operators import scoring as S
from postings_engine.operators import search as Z
from postings_engine.operators import similarity as Y
from postings_engine.operators.stemmer import porter_stem
from postings_engine.plans import daily
from postings_engine.schema import CONTENT_COLUMNS, HISTORY, POSTING

ORDER = ["seq"]
RUN_DAY = dt.date(2025, 6, 15)


def record(job: str, seq: int, text: str, **more) -> dict:
    base = {f.name: None for f in POSTING.fields}
    base.update(
        job_id=job, source="s", title=f"title {job}", company=f"Co {job}", url="u", location="Leeds", description=text,
        jd_content_hash=text and f"h-{text}", salary_min=seq, salary_max=seq + 1, seq=seq)
    base.update(more)
    return base


def records(spark, rows):
    schema = T.StructType([*POSTING.fields, T.StructField("seq", T.LongType())])
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)


def brute_sync(stored: dict, rows: list[dict], day: dt.date):
    """The record-at-a-time merge."""
    jobs = {k: dict(v) for k, v in stored.items()}
    actions = []
    for r in sorted(rows, key=lambda r: r["seq"]):
        old = jobs.get(r["job_id"])
        if old is None:
            jobs[r["job_id"]] = {**r, "first_seen": day, "last_seen": day, "status": "new", "notes": ""}
            actions.append((r["seq"], "inserted"))
        elif old["jd_content_hash"] != r["jd_content_hash"]:
            old.update({c: r[c] for c in CONTENT_COLUMNS}, last_seen=day)
            actions.append((r["seq"], "updated_jd"))
        else:
            old["last_seen"] = day
            actions.append((r["seq"], "updated_meta"))
    return jobs, sorted(actions)


def history(spark, jobs: dict):
    rows = [tuple(j.get(f.name) for f in HISTORY.fields) for j in jobs.values()]
    return spark.createDataFrame(rows, HISTORY)


def random_rows(rng, n, jobs="abcdefgh", hot="a"):
    """A third of all rows belong to one posting."""
    return [
        record(hot if rng.random() < 0.34 else rng.choice(jobs), i, rng.choice(["x", "y", "z", None]),
               fit_score=float(i)) for i in range(n)]


def test_sync_equals_record_at_a_time(spark):
    rng = random.Random(7)
    stored = {}
    for job in "abcz":
        r = record(job, -1, rng.choice("xy"))
        stored[job] = {**r, "first_seen": dt.date(2025, 1, 1), "last_seen": dt.date(2025, 2, 2), "status": "applied", "notes": "mine"}
    rows = random_rows(rng, 120)
    want, actions = brute_sync(stored, rows, RUN_DAY)
    existing, incoming = history(spark, stored), records(spark, rows).repartition(5)
    got = {r["job_id"]: r.asDict() for r in G.sync(existing, incoming, ORDER, RUN_DAY).collect()}
    assert got.keys() == want.keys()
    for job, expected in want.items():
        for field in HISTORY.fields:
            assert got[job][field.name] == expected.get(field.name), (job, field.name)
    per_record = G.sync_actions(existing, incoming, ORDER).collect()
    assert sorted((r["seq"], r["action"]) for r in per_record) == actions
    assert got["z"]["action"] == "kept" and got["z"]["status"] == "applied"


def test_sync_is_idempotent_and_protects_user_columns(spark):
    rows = random_rows(random.Random(3), 40)
    first = G.sync(daily.empty_history(spark), records(spark, rows), ORDER, RUN_DAY)
    edited = first.select(*HISTORY.names).withColumns({"status": F.lit("offer"), "notes": F.lit("n"), "title": F.lit("t")})
    last = sorted(rows, key=lambda r: r["seq"])
    latest = list({r["job_id"]: r for r in last}.values())
    again = G.sync(edited, records(spark, latest), ORDER, RUN_DAY).collect()
    assert {r["action"] for r in again} == {"updated_meta"}
    assert {(r["status"], r["notes"], r["title"]) for r in again} == {("offer", "n", "t")}


def test_replay_equals_daily_merges(spark):
    rng = random.Random(11)
    rows = random_rows(rng, 60)
    days = [dt.date(2025, 1, d) for d in (1, 2, 5)]
    per_day = {d: [r for i, r in enumerate(rows) if i % 3 == n] for n, d in enumerate(days)}
    jobs = {}
    for day in days:
        jobs, _ = brute_sync(jobs, per_day[day], day)
    bronze = None
    for day in days:
        part = records(spark, per_day[day]).withColumn("day", F.lit(day))
        bronze = part if bronze is None else bronze.unionByName(part)
    got = {r["job_id"]: r.asDict() for r in daily.replay_bronze(bronze, "day", ORDER).collect()}
    assert got == {k: {f.name: v.get(f.name) for f in HISTORY.fields} for k, v in jobs.items()}


def test_previous_in_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", i, rng.choice(["p", "q", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, n int, v string").repartition(7)
    want, last = {}, {}
    for k, n, v in sorted(rows, key=lambda r: r[1]):
        want[n] = last.get(k, "none")
        last[k] = v
    got = {r["n"]: "none" if r["previous"] is None else r["previous"]["value"]
           for r in K.previous_in_group(df, "k", ["n"], "v").collect()}
    assert got == want


@pytest.mark.parametrize("spread", [1, 16])
def test_last_changes_of_hot_postings(spark, monkeypatch, spread):
    monkeypatch.setattr(G, "SPREAD", spread)
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", i, rng.choice(["p", "p", "p", "q", None])) for i in range(800)]
    rows += [("one", 900, None), ("same", 901, "p"), ("same", 902, "p"), ("end", 903, None), ("end", 904, "q"), ("end", 905, None)]
    df = spark.createDataFrame(rows, "job_id string, seq int, jd_content_hash string").repartition(7)
    want = {}
    for k, n, v in sorted(rows, key=lambda r: r[1]):
        first, _, changed, last = want.get(k, (n, n, None, v))
        want[k] = (first, n, n if v != last else changed, v)
    got = {r["job_id"]: (r["_first"]["seq"], r["_last"]["seq"], r["_changed"] and r["_changed"]["seq"]) for r in G.last_changes(df, ["seq"]).collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    assert "lag(" not in G.last_changes(df, ["seq"])._jdf.queryExecution().executedPlan().toString()


def test_building_a_merge_runs_no_job(spark):
    existing, incoming = history(spark, {}), records(spark, random_rows(random.Random(3), 20))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan only", "")
    try:
        G.sync(existing, incoming, ORDER, RUN_DAY)
        G.sync_touched(existing, incoming, ORDER, RUN_DAY)
        assert list(tracker.getJobIdsForGroup("plan only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_keep_first_and_caps_limit_groups_before_the_shuffle(spark):
    df = spark.createDataFrame([(i % 3 == 0 and "hot" or f"k{i % 7}", i) for i in range(500)], "k string, n int").repartition(6)
    for frame, n in ((K.keep_first(df, ["k"], ["n"]), 1), (K.cap_per_group(df, ["k"], ["n"], 9), 9)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2, "one before and one after the exchange"
        counts = collections.Counter(r["k"] for r in frame.collect())
        assert set(counts.values()) <= set(range(1, n + 1))
        assert min(r["n"] for r in frame.filter("k = 'hot'").collect()) == 0


def test_keep_first_known_keeps_every_unkeyed_row(spark):
    df = spark.createDataFrame([("", 1), ("", 1), (None, 1), ("a", 2), ("a", 1)], "id string, n int")
    got = collections.Counter((r["id"], r["n"]) for r in K.keep_first_known(df, "id", ["n"]).collect())
    assert got == {("", 1): 2, (None, 1): 1, ("a", 1): 1}


def test_import_edits(spark):
    day, time = dt.date(2025, 1, 1), dt.datetime(2025, 3, 1, 12)
    base = {"first_seen": day, "last_seen": day}
    jobs = history(spark, {
        "a": {**record("a", 0, "x"), **base, "status": "new", "notes": ""},
        "b": {**record("b", 0, "x"), **base, "status": "applied", "notes": "old", "last_user_edit": dt.datetime(2025, 4, 1)},
        "c": {**record("c", 0, "x"), **base, "status": "offer", "notes": "keep"},
        "d": {**record("d", 0, "x"), **base, "status": "new", "notes": "n"},
    })
    edits = spark.createDataFrame([
        ("a", "applied", "", time, 1), ("a", "interview", "call", time, 2), ("b", "", "", time, 3),
        ("c", "hired", "x", time, 4), ("zz", "offer", "", time, 5), ("d", "new", "n", time, 6),
    ], "job_id string, status string, notes string, edited_at timestamp, row_no int")
    got = {r["job_id"]: (r["status"], r["notes"], r["edited"], r["conflict"]) for r in G.import_edits(jobs, edits).collect()}
    assert got == {
        "a": ("interview", "call", True, False), "b": ("applied", "", True, True),
        "c": ("offer", "keep", False, False), "d": ("new", "n", False, False)}
    assert [r["job_id"] for r in G.rejected_edits(edits).collect()] == ["c"]


PROFILE = {
    "location": {"lat": 53.8, "lon": -1.5}, "search_radius_miles": 60, "remote_ok": False,
    "negative_signals": {"title_excludes": ["lead"], "company_blocklist": ["Bad Co"]},
    "filters": {"salary_floor_gbp": 30000, "max_days_since_posted": 30, "exclude_companies": [], "rejected_company_cooldown_days": 90},
}


def test_filters_and_reasons(spark):
    def posting(job, **more):
        return record(job, 0, "x", salary_min=None, salary_max=None, posted_date=RUN_DAY, lat=53.8, lon=-1.5, **more)

    def changed(job, **more):
        return {**posting(job), **more}

    rows = [
        posting("ok"), changed("floor", salary_max=20000), changed("pay", salary_max=35000),
        changed("old", posted_date=dt.date(2025, 1, 1)), changed("nodate", posted_date=None),
        changed("blocked", company="BAD CO"), changed("title", title="Team Lead"), changed("leading", title="Leading"),
        changed("cool", company="cooled"), changed("far", lat=51.5, lon=-0.1),
        changed("remote", lat=51.5, lon=-0.1, location="Home based"), changed("nowhere", lat=None, lon=None),
        changed("zero", lat=0.0, lon=0.0),
    ]
    stored = {
        "r": {**record("r", 0, "x", company="Cooled"), "first_seen": RUN_DAY, "last_seen": dt.date(2025, 5, 1), "status": "rejected", "notes": ""},
        "q": {**record("q", 0, "x", company="Co ok"), "first_seen": RUN_DAY, "last_seen": dt.date(2024, 5, 1), "status": "rejected", "notes": ""},
    }
    df, jobs = records(spark, rows), history(spark, stored)
    kept = {r["job_id"] for r in P.apply_filters(df, PROFILE, jobs, RUN_DAY).collect()}
    assert kept == {"ok", "pay", "nodate", "leading", "remote", "nowhere"}
    reasons = {r["job_id"]: r["drop_reason"] for r in P.explain_filters(df, PROFILE, jobs, RUN_DAY).collect()}
    assert {k for k, v in reasons.items() if v is None} == kept
    assert {k: v for k, v in reasons.items() if v} == {
        "floor": "salary_floor", "old": "max_age", "blocked": "company_block", "title": "title_exclude",
        "cool": "cooldown", "far": "radius", "zero": "radius"}


def test_prescore_defaults(spark):
    df = records(spark, [record("a", 0, "We use Python here"), record("b", 1, "nothing")])
    got = {r["job_id"]: (r["fit_score"], r["fit_confidence"], r["route"], r["matched_keywords"]) for r in
           S.prescore_and_route(df, {"core_skills": ["Python"]}, 3.0, "v1").collect()}
    assert got == {"a": (10.0, 0.3, "scorer", ["python"]), "b": (0.0, 0.3, "skip", [])}
    neutral = S.prescore_and_route(df, {}, 3.0, "v1", scorer_ready=False).first()
    assert (neutral["fit_score"], neutral["fit_reason"]) == (5.0, S.NOT_SCORED)


@pytest.mark.parametrize("extra", [0, 60])
def test_profiles_against_postings_equal_single_profile_scores(spark, extra):
    rng = random.Random(2)
    words = ["python", "c", "Excel sheet", "é", "lead", "thon", "pyth", "sales", "c++", "", "\U0001F600 x"] + [f"skill{i}x" for i in range(extra)]
    people = []
    for i in range(12):
        people.append({
            "profile_id": f"p{i}", "core_skills": rng.sample(words, min(len(words), rng.randrange(0, 4) + extra // 4)), "adjacent_skills": rng.sample(words, 2),
            "negative_signals": {"title_excludes": rng.sample(words, 1), "description_excludes": rng.sample(words, 1)}})
    people.append({"profile_id": "none", "core_skills": [], "adjacent_skills": [],
                   "negative_signals": {"title_excludes": ["lead"], "description_excludes": []}})
    some = words + ["x"] * 8 if not extra else words
    postings = [record(f"j{i}", i, " ".join(rng.sample([w.upper() for w in some], 4 + extra // 10)), title=rng.choice(["Lead c", "Clerk", "Python", ""])) for i in range(25)]
    postings.append(record("jnull", 30, None, title=""))
    profiles = R.default_profile(spark.createDataFrame(
        [(p["profile_id"], p["core_skills"], p["adjacent_skills"], (p["negative_signals"]["title_excludes"], 3, p["negative_signals"]["description_excludes"], [])) for p in people],
        "profile_id string, core_skills array<string>, adjacent_skills array<string>, negative_signals struct<title_excludes: array<string>, requires_years_above: int, description_excludes: array<string>, company_blocklist: array<string>>"))
    df = records(spark, postings).withColumn("title", F.nullif("title", F.lit("")))
    got = {(r["profile_id"], r["job_id"]): (r["score"], r["keywords"]) for r in Q.profiles_x_postings(profiles, df).collect()}
    want = {("none", None): (5.0, [])}
    for p in people:
        skills = [s.lower() for s in p["core_skills"] + p["adjacent_skills"] if s]
        for r in df.select("*", S.keyword_prescore(p).alias("s")).collect():
            text = f"{r['title'] or ''} {r['description'] or ''}".lower()
            if any(s in text for s in skills):
                want[p["profile_id"], r["job_id"]] = (r["s"]["score"], r["s"]["keywords"])
    assert got == want
    for least, best in ((None, 2), (3.0, None), (1.0, 2)):
        top = Q.profiles_x_postings(profiles, df, min_score=least, best=best).filter("job_id is not null").collect()
        ranked = collections.defaultdict(list)
        for (person, job), (score, _) in want.items():
            if job and score >= (least or 0):
                ranked[person].append((-score, job))
        assert {(r["profile_id"], r["job_id"]) for r in top} == {(p, j) for p, js in ranked.items() for _, j in sorted(js)[:best]}


def test_home_radius_join_matches_every_pair(spark):
    """Homes at poles, on the date line and anywhere; radii from nothing to half the globe."""
    rng = random.Random(21)
    spot = lambda: (rng.choice([90.0, -90.0, 89.9, -89.95, 0.0, rng.uniform(-90, 90), rng.uniform(50, 52)]), rng.choice([180.0, -180.0, 179.99, 0.0, rng.uniform(-180, 180), rng.uniform(-2, 2)]))
    homes = [(f"p{i}", *spot(), rng.choice([0, 1, 30, 60, 500, 3000, 7000, 13000]), False) for i in range(60)]
    homes += [("any", 51.0, 0.0, 10, True), ("nowhere", None, None, 10, False)]
    posts = [(f"j{i}", *spot(), "x") for i in range(300)] + [("home", 51.0, 0.0, "Remote"), ("lost", None, 0.0, "x")]
    profiles = spark.createDataFrame(homes, "profile_id string, lat double, lon double, search_radius_miles int, remote_ok boolean").selectExpr(
        "profile_id", "struct(lat, lon) AS location", "search_radius_miles", "remote_ok", "1 AS cell")
    postings = spark.createDataFrame(posts, "job_id string, lat double, lon double, location string")

    def miles(a, b):
        (p1, l1), (p2, l2) = (tuple(map(math.radians, x)) for x in (a, b))
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
        return 2 * 3958.8 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    got = [(r["profile_id"], r["job_id"]) for r in L.profiles_near_postings(profiles, postings).collect()]
    sure, maybe = set(), set()
    for p, lat, lon, radius, remote_ok in homes:
        for j, jlat, jlon, location in posts:
            if lat is not None and not remote_ok and jlat is not None and location == "x":
                far = miles((lat, lon), (jlat, jlon))
                sure |= {(p, j)} if far <= radius - 1e-6 else set()
                maybe |= {(p, j)} if far <= radius + 1e-6 else set()
    assert len(got) == len(set(got)) and sure <= set(got) <= maybe and len(sure) > 1000
    met = L.home_cells(profiles).join(L.posting_cells(postings, L.home_cells(profiles), ["job_id"]), "cell").filter(L.within_radius())
    passes = {(r["profile_id"], r["job_id"]) for r in met.select("profile_id", "job_id").collect()}
    everyone = {j for j, *_ in posts}
    assert {j for p, j in passes if p == "any"} == everyone == {j for p, j in passes if p == "nowhere"}
    assert all((p, j) in passes for p, *_ in homes for j in ("home", "lost"))


def test_profile_matching_shuffles_no_text(spark):
    df = records(spark, [record("a", 1, "python and sales")])
    profiles = R.default_profile(spark.createDataFrame([("p", ["python"])], "profile_id string, core_skills array<string>"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.profiles_x_postings(profiles, df, best=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    below = [lines[i + 1] for i, line in enumerate(lines[:-1]) if "Exchange hashpartitioning" in line]
    assert below and not any(re.search(r"[\[ ](text|description)#", line) for line in below)


def python_bm25(docs, query, stem):
    def words(text):
        found = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        return [porter_stem(w) for w in found] if stem else found

    bags = {k: collections.Counter(words(t)) for k, t in docs.items()}
    sizes = {k: sum(b.values()) for k, b in bags.items()}
    average = sum(sizes.values()) / len(sizes)
    terms = [porter_stem(q.lower()) if stem else q.lower() for q in query]
    out = {}
    for k, bag in bags.items():
        if all(bag[t] for t in terms):
            score = 0.0
            for t in terms:
                df = sum(1 for b in bags.values() if b[t])
                idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
                score += idf * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * sizes[k] / average))
            out[k] = round(score, 9)
    return out


@pytest.mark.parametrize("stem", [True, False])
def test_search_equals_brute_force(spark, stem):
    rng = random.Random(9)
    vocabulary = ["nurse", "nurses", "nursing", "ward", "wards", "sister", "Manchester", "day", "night"]
    docs = {f"d{i:02d}": " ".join(rng.choices(vocabulary, k=rng.randrange(1, 30))) for i in range(60)}
    df = spark.createDataFrame([(k, t, "Co", "") for k, t in docs.items()], "job_id string, description string, company string, title string")
    texts = {k: f" co {t}" for k, t in docs.items()}
    terms, lengths = Z.build_terms(df, stem=stem), Z.build_lengths(df)
    for query in (["Nurses"], ["nursing", "ward"], ["day", "day"], ["absent"]):
        want = python_bm25(texts, query, stem)
        got = Z.search(df, terms, lengths, query, k=100, stem=stem).collect()
        assert {r["job_id"]: round(r["score"], 9) for r in got} == want
        assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    phrase = {r["job_id"] for r in Z.search_phrase(df, lengths, ["ward", "sister"], k=100, stem=stem).collect()}
    pattern = r"\bwards? sister\b" if stem else r"\bward sister\b"
    assert phrase == {k for k, t in docs.items() if re.search(pattern, t)}


def test_stored_index_folds_accents_and_knows_fields(spark, tmp_path):
    df = spark.createDataFrame([("a", "Café", "Co", "tea"), ("b", "Bar", "Co", "the cafe NOËL"), ("c", "Bar", "Co", "noel the café")],
                               "job_id string, title string, company string, description string")
    Z.write_index(df, str(tmp_path / "index"), stem=False)
    terms, lengths = Z.read_index(spark, str(tmp_path / "index"))
    found = lambda *q, **o: {r["job_id"] for r in Z.search(df, terms, lengths, list(q), stem=False, **o).collect()}
    assert found("CAFÉ") == {"a", "b", "c"} and found("cafe", field="title") == {"a"} and found("noël", "the") == {"b", "c"}
    phrase = Z.search_phrase(df, lengths, ["The", "cafe"], stem=False, terms=terms).collect()
    assert [r["job_id"] for r in phrase] == ["b", "c"]


@pytest.mark.parametrize("stem", [True, False])
def test_near_and_phrases_by_positions(spark, stem):
    rng = random.Random(12)
    vocabulary = ["nurse", "nurses", "ward", "wards", "day", "night", "Café"]
    docs = {f"d{i:02d}": (" ".join(rng.choices(vocabulary, k=rng.randrange(0, 25))), " ".join(rng.choices(vocabulary, k=6))) for i in range(60)}
    df = spark.createDataFrame([(k, t, d) for k, (t, d) in docs.items()], "job_id string, title string, description string")
    index = Z.build_positions(df, ("title", "description"), stem=stem)
    term = lambda w: porter_stem(Z._folded(w)) if stem else Z._folded(w)

    def clumps(text, words, distance):
        have, wanted = [term(w) for w in text.split()], {term(w) for w in words}
        return sum(1 for p, w in enumerate(have) if w in wanted and wanted <= set(have[p:p + distance + 2]))

    for words, distance in ((["nurse", "ward"], 0), (["nurse", "ward"], 3), (["day", "Cafe", "nurses"], 4), (["night", "night"], 1), (["absent", "day"], 9)):
        want = {k: n for k, texts in docs.items() if (n := sum(clumps(t, words, distance) for t in texts))}
        assert {r["job_id"]: r["tf"] for r in Z.near_hits(index, words, distance, stem).collect()} == want
    for phrase in (["day", "night"], ["ward", "day", "ward"], ["nurse", "nurse"]):
        terms = [term(w) for w in phrase]
        count = lambda t: sum(1 for p in range(len(t.split())) if [term(w) for w in t.split()[p:p + len(terms)]] == terms)
        want = {k: n for k, texts in docs.items() if (n := sum(map(count, texts)))}
        assert {r["job_id"]: r["tf"] for r in Z.phrase_hits(index, phrase, stem).collect()} == want
    title_only = {r["job_id"] for r in Z.near_hits(index, ["day", "night"], 2, stem, field="title").collect()}
    assert title_only == {k for k, (t, _) in docs.items() if clumps(t, ["day", "night"], 2)}


@pytest.mark.parametrize("stem", [True, False])
def test_index_is_made_inside_documents(spark, stem, tmp_path):
    rows = [("a", "Nurses nurse"), ("a", "ward nurses"), (None, "day"), (None, "day ward"), ("b", ""), ("b", None), ("c", None), ("d", "day Day NIGHT day")]
    df = spark.createDataFrame(rows, "job_id string, title string")
    index = Z.build_positions(df, ("title",), stem=stem)
    places = {}
    for k, text in rows:
        for p, w in enumerate((text or "").lower().split()):
            places.setdefault((k, porter_stem(w) if stem else w), []).append(p)
    want = sorted(((k, w, len(at), tuple(sorted(at))) for (k, w), at in places.items()), key=str)
    assert sorted(((r["job_id"], r["term"], r["tf"], tuple(r["positions"])) for r in index.collect()), key=str) == want
    assert {r["field"] for r in index.collect()} == {"title"}
    counts = Z.build_terms(df, ("title",), stem=stem)
    assert sorted(((r["job_id"], r["term"], r["tf"]) for r in counts.collect()), key=str) == sorted((w[:3] for w in want), key=str)
    Z.write_index(df, str(tmp_path / "index"), ("title",), stem=stem)
    lengths = spark.read.parquet(str(tmp_path / "index" / "lengths")).select("job_id", "tokens").collect()
    assert sorted(map(tuple, lengths), key=str) == sorted(((k, len((t or "").split())) for k, t in rows), key=str)
    # Between a document and the rows of its terms nothing is shuffled.
    plan = index._jdf.queryExecution().executedPlan().toString()
    alone = plan[plan.index("Union"):]
    assert "Exchange" not in alone[:alone.index("Generate explode")]


def test_refresh_rewrites_touched_buckets_only(spark, tmp_path):
    root, texts = str(tmp_path / "index"), {f"j{i}": f"word{i} shared" for i in range(40)}
    frame = lambda rows: spark.createDataFrame(list(rows.items()), "job_id string, title string")
    options = dict(fields=("title",), stem=False, buckets=8)
    Z.write_index(frame(texts), root, **options)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index" / "terms").rglob("*.parquet")}
    before = files()
    Z.refresh_index(root, frame({"j3": "changed words", "new": "shared new"}), spark.createDataFrame([("j5",)], "job_id string"), **options)
    same = set(before.items()) & set(files().items())
    assert 0 < len(same) < len(before)
    texts = {k: t for k, t in texts.items() if k != "j5"} | {"j3": "changed words", "new": "shared new"}
    terms, lengths = Z.read_index(spark, root)
    assert {(r["job_id"], r["term"], tuple(r["positions"])) for r in terms.collect()} == {(k, w, (p,)) for k, t in texts.items() for p, w in enumerate(t.split())}
    assert {r["job_id"]: r["tokens"] for r in lengths.collect()} == {k: 2 for k in texts}
    # A bucket may lose all its documents.
    Z.refresh_index(root, spark.createDataFrame([], "job_id string, title string"), frame(texts).select("job_id"), **options)
    terms, lengths = Z.read_index(spark, root)
    assert terms.count() == 0 and lengths.count() == 0


def test_phrases_of_a_profile_are_dealt_before_they_are_compared(spark):
    rows = [("p", [], 0, "Nurse  ward"), ("p", [], 1, "nurse Ward"), ("q", ["head"], 0, "Head nurse"), ("q", [], 2, "ward"), ("p", [], 2, "day"), (None, [], 0, "x")]
    found = R.normalise_queries(spark.createDataFrame(rows, "profile_id string, excluded array<string>, ordinal int, phrase string"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("p", 1, "Nurse ward"), ("p", 2, "day"), ("q", 1, "ward"), (None, 1, "x")], key=str)
    assert plan.count("Exchange ") == 1 and plan.rindex("Aggregate") < plan.index("Exchange ")


def test_similarity_keeps_scores_of_minor_changes(spark):
    words = [f"w{i}" for i in range(200)]
    a, b, c = " ".join(words), " ".join(words[:-3] + ["new"]), " ".join(reversed(words))
    df = spark.createDataFrame([(a, b), (a, c), (a, a), ("", "")], "o string, n string")
    got = [r["v"] for r in df.select(Y.text_similarity("o", "n").alias("v")).collect()]
    assert got[0] > 0.9 and got[1] == 0.0 and got[2] == 1.0 and got[3] == 1.0


def test_score_round_trip_retries_singly(spark):
    import json

    def scorer(batches):
        for frame in batches:
            answers = []
            for payload in frame["payload"]:
                rows = json.loads(payload)
                if any("silent" in r["title"] for r in rows):
                    answers.append("no json")
                else:
                    answers.append("```json\n" + json.dumps([{"s": len(r["jd"]), "r": r["title"]} for r in rows]) + "\n```")
            yield frame[["batch_id"]].assign(response=answers)

    rows = [record(f"{i:040x}", i, "x" * i, title="silent" if i == 4 else f"t{i}") for i in range(12)]
    routed = S.prescore_and_route(records(spark, rows), {}, 3.0, "v1")
    got = {int(r["job_id"], 16): (r["fit_score"], r["fit_confidence"], r["fit_reason"]) for r in
           S.score_round_trip(routed, scorer, "v2").collect()}
    assert got == {i: (5.0, 0.3, None) if i == 4 else (float(i), 0.5, f"t{i}") for i in range(12)}


def test_batches_tell_rows_of_one_posting_apart(spark):
    df = spark.range(1000).select(F.lit("ab" * 20).alias("job_id"), F.col("id").alias("seq"))
    got = K.assign_batches(df, 5, order=["seq"]).collect()
    sizes = collections.Counter(r["batch_id"] for r in got)
    assert len(got) == 1000 and set(sizes.values()) == {5} and len(sizes) == 200
    assert len({(r["batch_id"], r["pos"]) for r in got}) == 1000


@pytest.mark.parametrize("n", [0, 1, 50, 52])
def test_only_the_last_batch_is_short(spark, n):
    df = spark.range(n).select(F.sha1(F.col("id").cast("string")).alias("job_id"))
    sizes = collections.Counter(r["batch_id"] for r in K.assign_batches(df).collect())
    assert len(sizes) == -(-n // 5) and sorted(sizes.values(), reverse=True) == [5] * (n // 5) + [n % 5] * (n % 5 > 0)


def test_one_failing_batch_loses_no_other(spark):
    import json

    def scorer(batches):
        for frame in batches:
            answers = []
            for payload in frame["payload"]:
                rows = json.loads(payload)
                if any("broken" in r["title"] for r in rows):
                    raise RuntimeError("no connection")
                answers.append(json.dumps([{"s": 9} for _ in rows]))
            yield frame[["batch_id"]].assign(response=answers)

    rows = [record(f"{i:040x}", i, "x", title="broken" if i == 7 else "t") for i in range(15)]
    routed = S.prescore_and_route(records(spark, rows), {}, 3.0, "v1")
    got = {int(r["job_id"], 16): (r["fit_score"], r["ranker_version"]) for r in S.score_round_trip(routed, scorer, "v2").collect()}
    assert got == {i: (5.0, None) if 5 <= i < 10 else (9.0, "v2") for i in range(15)}


@pytest.mark.parametrize("response, want", [
    ('[{"s":"7"}]', [(7.0, True)]), ('[{"s":7}] trailing', []), ('[1,{"s":3}]', [None, (3.0, True)]), ('{"s":2}', [(2.0, True)]),
    ('[{"s":"x"}]', [(None, False)]), ('[{"s":null}]', [(None, False)]), ("7", []), (None, []), ("```json\n[{}]\n```", [(None, True)]),
])
def test_parse_scores_reads_element_by_element(spark, response, want):
    df = spark.createDataFrame([(response,)], "t string").select(S.parse_scores("t").alias("s"))
    assert [None if e is None else (e["s"], e["usable"]) for e in df.first()["s"]] == want


def test_keywords_that_are_no_list_change_nothing(spark):
    batched = spark.createDataFrame([("0", i, 1.0, 0.3, "", ["old"], None) for i in range(3)],
        "batch_id string, pos int, fit_score double, fit_confidence double, fit_reason string, matched_keywords array<string>, ranker_version string")
    answers = spark.createDataFrame([("0", '[{"s":1,"k":"x"},{"s":2,"k":[1,"b"]},{"s":3}]')], "batch_id string, response string")
    got = {r["pos"]: r["matched_keywords"] for r in S.apply_scores(batched, answers, "v").collect()}
    assert got == {0: ["old"], 1: ["1", "b"], 2: []}


def test_edits_apply_row_by_row(spark):
    jobs = {j: {**record(j, 0, "x"), "first_seen": RUN_DAY, "last_seen": RUN_DAY, "status": "new", "notes": "n",
                "last_user_edit": dt.datetime(2025, 3, 1) if j == "b" else None} for j in "abc"}
    early, late = dt.datetime(2025, 2, 1), dt.datetime(2025, 4, 1)
    rows = [("a", "applied", "", late, 1), ("a", "", "", late, 2), ("a", "maybe", "zz", late, 3), ("b", "new", "n", early, 4), ("b", "offer", "x", early, 5),
            ("b", "closed", "y", late, 0), ("c", "new", "n", late, 6), ("d", "new", "n", late, 7)]
    edits = spark.createDataFrame(rows, "job_id string, status string, notes string, edited_at timestamp, row_no int")
    got = {r["job_id"]: (r["status"], r["notes"], r["edits_applied"], r["conflict"]) for r in G.import_edits(history(spark, jobs), edits).collect()}
    # A blank status always differs, so the second row of a is applied as well.
    assert got == {"a": ("applied", "", 2, False), "b": ("closed", "y", 2, True), "c": ("new", "n", 0, False)}


def test_generate_queries(spark):
    base = R.default_profile(spark.createDataFrame([("p",)], "profile_id string")).withColumns({
        "location": F.col("location").withField("city", F.lit("Leeds")),
        "target_roles": F.struct(F.array(F.lit("Data  Clerk")).alias("core"), F.array(F.lit("Senior Clerk")).alias("adjacent"), F.array(F.lit("Buyer")).alias("stretch")),
        "core_skills": F.array(F.lit("SQL")), "supplied_queries": F.array(F.lit("buyer leeds"), F.lit("first one")),
    })
    got = [r["query"] for r in R.generate_queries(base).orderBy("position").collect()]
    assert got == [
        "buyer leeds", "first one", "Data Clerk", "Data Clerk Leeds", "junior Data Clerk", "graduate Data Clerk", "entry level Data Clerk",
        "junior/graduate Data Clerk", "Data Clerk remote", "Buyer", "SQL engineer", "SQL Leeds", "SQL remote"]
    assert len(R.generate_queries(base, 3).collect()) == 3


def test_forms(spark):
    body = "﻿### Domain\n\nHealthcare\n\n### Search radius miles\n25 miles\n### Remote jobs\nno\n### Core skills\n- A\n- B, C\n### Companies to exclude\n_No response_\n"
    row = R.profiles_from_forms(spark.createDataFrame([("p", body)], "profile_id string, body string")).first()
    assert (row["domain"], row["search_radius_miles"], row["remote_ok"], row["core_skills"]) == ("healthcare", 25, False, ["A", "B", "C"])
    assert row["filters"]["exclude_companies"] == [] and row["negative_signals"]["title_excludes"][0] == "senior"


def folded(df):
    return sorted((r["job_id"], r["first"]["salary_min"], r["changed"] and r["changed"]["salary_min"], r["first_at"]["seq"], r["last_at"]["seq"]) for r in df.collect())


def test_records_of_a_run_are_dealt_out_once(spark, monkeypatch):
    rng = random.Random(21)
    rows = random_rows(rng, 400, jobs=[f"k{n}" for n in range(40)])
    rows += [record("end", 901, None), record("end", 902, "q"), record("end", 903, None), record("same", 904, "p"), record("same", 905, "p")]
    # Records without an id are of no posting.
    incoming = records(spark, rows).withColumn("job_id", F.expr("if(job_id = 'k7', NULL, job_id)")).repartition(5)
    want = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        n, text = r["seq"], r["jd_content_hash"]
        first, changed, _, last = want.get(r["job_id"], (n, None, n, text))
        want[r["job_id"]] = (first, n if text != last else changed, n, text)
    want = sorted((k, v[0], v[1], v[0], v[2]) for k, v in want.items() if k != "k7")
    found = G.fold_run(incoming, ORDER)
    assert folded(found) == want
    # No posting is frequent, so the adaptive plan ends with one exchange of records; the others are of counts.
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[:plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    final = final[:final.index("Subqueries")] if "Subqueries" in final else final
    assert final.count("Exchange hashpartitioning(job_id") == 1 and "explode" not in final
    # The same with one posting that is spread.
    monkeypatch.setattr(G, "FREQUENT", 50)
    monkeypatch.setattr(G, "SHARE", 4)
    assert folded(G.fold_run(incoming, ORDER)) == want


def test_facts_travel_with_both_sides_of_a_pair(spark):
    words = ["python", "sales", "law"]
    rows = [record(f"j{n}", n, f"{words[n % 3]} and {words[n % 2]}", lat=50.0 + n % 4, lon=0.0, location="x") for n in range(30)]
    postings = records(spark, rows).repartition(3)
    profiles = R.default_profile(spark.createDataFrame(
        [(f"p{n}", [words[n % 3]] if n < 8 else [], {"lat": 50.0 + n % 3, "lon": 0.0, "city": ""}, n % 4 == 0) for n in range(9)],
        "profile_id string, core_skills array<string>, location struct<city: string, lat: double, lon: double>, remote_ok boolean"))
    # A posting without facts makes no pair; a profile that has them twice makes each pair twice.
    about = postings.filter("salary_min < 25").select("job_id", F.col("salary_min").alias("pay"))
    rules = profiles.select("profile_id", F.upper("profile_id").alias("rule"))
    rules = rules.unionByName(rules.filter("profile_id = 'p1'"))
    want = Q.profiles_x_postings(profiles, postings, in_reach=True).join(about, "job_id").join(rules, "profile_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Q.profiles_x_postings(profiles, postings, in_reach=True, facts_of_postings=about, facts_of_profiles=rules)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "python" not in plan and "regexp_extract_all" not in plan  # texts were cut into grams once, before
        found = [r for r in got.collect() if r["job_id"]]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    key = lambda r: (r["profile_id"], r["job_id"], r["score"], r["pay"], r["rule"])
    assert len(found) > 30 and sorted(map(key, found)) == sorted(map(key, want.collect()))
    assert [r["profile_id"] for r in got.collect() if r["job_id"] is None] == ["p8"]
    with pytest.raises(ValueError):
        Q.profiles_x_postings(profiles, postings, facts_of_postings=about)
