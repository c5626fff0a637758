"""Policy filters over postings and the history table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import with_once
from ..functions.money import parse_salary
from ..operators import filters as P
from ..schema import HISTORY
from ..session import scratch_path
from .registry import query
from .sql_inputs import FILTER_DAY, REPORT_DAY
from .values import SALARY_PARTS

# The profile of the registered filter queries.
PROFILE = {
    "location": {"city": "Leeds", "lat": 53.8, "lon": -1.5},
    "search_radius_miles": 150,
    "remote_ok": False,
    "core_skills": ["tion", "Ther", "With"],
    "adjacent_skills": ["ering", "über", "anea"],
    "negative_signals": {
        "title_excludes": ["Lead", "small specialist", " promo "],
        "description_excludes": ["thble thst", "erstlyat"],
        "company_blocklist": ["supplier#000000003"],
    },
    "filters": {
        "salary_floor_gbp": 30000,
        "max_days_since_posted": 2000,
        "exclude_companies": ["SUPPLIER#000000007", "nobody"],
        "rejected_company_cooldown_days": 20,
    },
}


def _day():
    return F.lit(FILTER_DAY).cast("date")


# What the cooldown reads of the history.
_COOLING = ("company", "status", "last_seen")
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_SQL_KEYS = "p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey"

_FLOOR = "(salary_max IS NULL OR salary_max >= 30000)"
_AGE = f"datediff('day', posted_date, DATE '{FILTER_DAY}') <= 2000"
_BLOCK = "lower(company) NOT IN ('supplier#000000003', 'supplier#000000007', 'nobody')"
_TITLE = "NOT regexp_matches(title, '\\b(lead|small specialist|promo)\\b', 'i')"
_COOL = f"""lower(company) NOT IN (SELECT lower(company) FROM jobs
    WHERE status = 'rejected' AND last_seen >= DATE '{FILTER_DAY}' - 20)"""
_MILES = """3958.8 * 2 * atan2(sqrt({a}), sqrt(1 - {a}))""".format(
    a="""(pow(sin(radians(lat - 53.8::DOUBLE) / 2), 2) + cos(radians(53.8::DOUBLE)) * cos(radians(lat))
        * pow(sin(radians(lon + 1.5::DOUBLE) / 2), 2))""")
_RADIUS = f"(location = 'Remote' OR lat IS NULL OR {_MILES} <= 150)"
_PRICED = f"""WITH {SALARY_PARTS},
    p AS (SELECT a.*, s.salary_min, s.salary_max FROM keyed a
        LEFT JOIN salaries s ON a.salary_raw IS NOT DISTINCT FROM s.salary_raw)"""


def priced(t):
    rows = with_once(t.inputs.keyed(), "_pay", parse_salary("salary_raw"))
    return rows.withColumns({"salary_min": F.col("_pay.min"), "salary_max": F.col("_pay.max")}).drop("_pay")


@query("salary_floor", uses=("keyed",), sql=f"{_PRICED} SELECT {_SQL_KEYS}, salary_max FROM p WHERE {_FLOOR}")
def salary_floor(t):
    return priced(t).filter(P.f_salary_floor(30000)).select(*_KEYS, "salary_max")


@query("max_age", uses=("postings",), sql=f"SELECT {_SQL_KEYS}, posted_date FROM postings p WHERE {_AGE}")
def max_age(t):
    return t.inputs.postings().filter(P.f_max_age(2000, _day())).select(*_KEYS, "posted_date")


@query("company_block", uses=("postings",), sql=f"SELECT company, count(*) AS n FROM postings WHERE {_BLOCK} GROUP BY ALL")
def company_block(t):
    names = [*PROFILE["filters"]["exclude_companies"], *PROFILE["negative_signals"]["company_blocklist"]]
    return t.inputs.postings().filter(P.f_company_block(names)).groupBy("company").agg(F.count(F.lit(1)).alias("n"))


@query("company_block_table", uses=("postings",), sql="""
    SELECT company, count(*) AS n FROM postings
    WHERE lower(company) NOT IN (SELECT lower(s_name) FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""")
def company_block_table(t):
    blocked = t.supplier.filter("s_acctbal < 0").select(F.upper("s_name").alias("company"))
    return P.block_companies(t.inputs.postings().select("company"), blocked).groupBy("company").agg(
        F.count(F.lit(1)).alias("n"))


@query("title_exclude", uses=("postings",), sql=f"SELECT title, count(*) AS n FROM postings WHERE {_TITLE} GROUP BY ALL")
def title_exclude(t):
    terms = PROFILE["negative_signals"]["title_excludes"]
    return t.inputs.postings().filter(P.f_title_exclude(terms)).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query("cooldown_anti", uses=("jobs",), sql=f"SELECT company, count(*) AS n FROM keyed WHERE {_COOL} GROUP BY ALL")
def cooldown_anti(t):
    rows = t.inputs.keyed().select("company")
    return P.f_cooldown(rows, t.inputs.jobs(*_COOLING), _day(), 20).groupBy("company").agg(F.count(F.lit(1)).alias("n"))


@query("radius_filter", uses=("postings",), sql=f"SELECT location, lat, lon, count(*) AS n FROM postings WHERE {_RADIUS} GROUP BY ALL")
def radius_filter(t):
    rule = P.f_radius(53.8, -1.5, 150, False)
    return t.inputs.postings().filter(rule).groupBy("location", "lat", "lon").agg(F.count(F.lit(1)).alias("n"))


@query("apply_filters", uses=("jobs",), sql=f"""{_PRICED}
    SELECT {_SQL_KEYS}, job_id FROM p WHERE {_FLOOR} AND {_AGE} AND {_BLOCK} AND {_TITLE} AND {_COOL} AND {_RADIUS}""")
def apply_filters(t):
    return P.apply_filters(priced(t), PROFILE, t.inputs.jobs(*_COOLING), FILTER_DAY).select(*_KEYS, "job_id")


@query("explain_filters", uses=("jobs",), sql=f"""{_PRICED}
    SELECT CASE WHEN NOT {_FLOOR} THEN 'salary_floor' WHEN NOT {_AGE} THEN 'max_age' WHEN NOT {_BLOCK} THEN 'company_block'
        WHEN NOT {_TITLE} THEN 'title_exclude' WHEN NOT ({_COOL}) THEN 'cooldown' WHEN NOT {_RADIUS} THEN 'radius' END AS drop_reason,
        count(*) AS n FROM p GROUP BY ALL""")
def explain_filters(t):
    rows = P.explain_filters(priced(t), PROFILE, t.inputs.jobs(*_COOLING), FILTER_DAY)
    return rows.groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query("years_required_filter", sql="""
    SELECT doc_id FROM (SELECT doc_id, list_max(list_transform(regexp_extract_all(lower(concat(text, ' needs ', doc_id % 9, '+ years')),
        '(?:^|[^0-9])([0-9]{1,2})\\s*\\+?\\s*(?:years?|yrs?)', 1), lambda y: CAST(y AS INTEGER))) AS years FROM documents)
    WHERE years <= 3 OR years IS NULL""")
def years_required(t):
    text = F.expr("concat(text, ' needs ', doc_id % 9, '+ years')")
    return t.documents.filter(P.f_years_required(3, text)).select("doc_id")


@query("f_open_status", uses=("jobs",), sql="""
    SELECT job_id, status FROM jobs WHERE status NOT IN ('rejected', 'ignore', 'archive', 'closed')""")
def open_status(t):
    return t.inputs.jobs().filter(P.f_open_status()).select("job_id", "status")


@query("f_status_valid", sql="""
    SELECT o_orderstatus, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'offer' WHEN 'O' THEN '' ELSE o_orderstatus END
        AS o_orderstatus FROM orders) WHERE o_orderstatus IN ('', 'offer') GROUP BY ALL""")
def status_valid(t):
    status = F.when(F.col("o_orderstatus") == "F", "offer").when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus"))
    rows = t.orders.select(status.alias("o_orderstatus"))
    return rows.filter(P.f_status_valid("o_orderstatus")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("f_prescore", uses=("jobs",), sql="SELECT job_id, coalesce(fit_score, 0) >= 3.0 AS queued FROM jobs")
def prescore_split(t):
    return t.inputs.jobs().select("job_id", P.f_prescore().alias("queued"))


@query("f_source", uses=("postings",), sql="""
    SELECT company, count(*) AS n, min(seen_date) AS first_seen FROM postings WHERE source = 'src2' GROUP BY ALL""")
def one_source(t):
    from ..sources.landing import f_source

    return f_source(t.inputs.postings(), "src2").groupBy("company").agg(
        F.count(F.lit(1)).alias("n"), F.min("seen_date").alias("first_seen"))


@query("point_lookup", uses=("jobs",), sql="""
    SELECT job_id, company, title FROM jobs WHERE job_id = (SELECT max(job_id) FROM jobs)""")
def point_lookup(t):
    from ..sources.tables import point_lookup as lookup

    jobs = t.inputs.jobs()
    return lookup(jobs, jobs.agg(F.max("job_id")).scalar()).select("job_id", "company", "title")


@query("scan_jobs", uses=("jobs",), sql=f"""
    SELECT job_id, source, status, last_seen FROM jobs WHERE last_seen < DATE '{REPORT_DAY}'""")
def scan_jobs(t):
    """Columns of the stored table, filtered; the scan reads these columns alone."""
    from ..sources import tables as B

    root = scratch_path(t.spark, "scanned")
    kept = [f.name for f in HISTORY.fields if f.name in t.inputs.JOB_COLUMNS]
    rows = t.inputs.jobs(*kept)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in HISTORY.fields if f.name not in rows.columns]
    B.write_version(rows.select("*", *missing).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HISTORY.fields]), root, 1)
    found = B.scan_jobs(t.spark, root, "job_id", "source", "status", "last_seen")
    return found.filter(F.col("last_seen") < F.lit(REPORT_DAY).cast("date"))
