"""Pay, date, place and label functions over postings, orders and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import dates as D
from ..functions import geo as G
from ..functions import money as M
from .registry import query
from .sql_inputs import AS_OF, REPORT_DAY, SALARY_TEXT

# --- pay ----------------------------------------------------------------------------------

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

# Amounts, band and unit of a pay text, written independently of the Spark expressions.
SALARY_PARTS = f"""
    given AS (SELECT DISTINCT salary_raw FROM (SELECT {SALARY_TEXT} AS salary_raw FROM lineitem)),
    pounds AS (SELECT salary_raw, list_transform(regexp_extract_all(salary_raw, '£\\s*[0-9,]+(\\.[0-9]+)?\\s*k?', 0, 'i'),
        lambda m: TRY_CAST(replace(regexp_extract(m, '([0-9,]+(\\.[0-9]+)?)', 1), ',', '') AS DOUBLE)
            * CASE WHEN lower(m) LIKE '%k' THEN 1000 ELSE 1 END) AS ps FROM given),
    ranges AS (SELECT *, list_transform(
        regexp_extract_all(salary_raw, '\\b[0-9,]+(\\.[0-9]+)?k?\\s*(-|to|–)\\s*[0-9,]+(\\.[0-9]+)?k?\\b', 0, 'i'),
        lambda m: [TRY_CAST(replace(regexp_extract(m, '^([0-9,]+(\\.[0-9]+)?)', 1), ',', '') AS DOUBLE)
                * CASE WHEN regexp_matches(m, '^[0-9,.]+k', 'i') THEN 1000 ELSE 1 END,
            TRY_CAST(replace(regexp_extract(m, '([0-9,]+(\\.[0-9]+)?)k?$', 1, 'i'), ',', '') AS DOUBLE)
                * CASE WHEN lower(m) LIKE '%k' THEN 1000 ELSE 1 END]) AS rs FROM pounds),
    amounts AS (SELECT salary_raw, list_filter(list_concat(ps,
        flatten(list_filter(rs, lambda r: r[1] > 5000 AND r[2] > 5000))), lambda a: a IS NOT NULL) AS am FROM ranges),
    banded AS (SELECT *, lower(regexp_extract(salary_raw, '\\bband\\s+([0-9]+[abcd]?)\\b', 1, 'i')) AS b,
        CASE WHEN regexp_matches(lower(salary_raw), '/hr|per hour|p/h|hourly|per hr') THEN 'hourly'
            WHEN regexp_matches(lower(salary_raw), '/day|per day|daily|p/d') THEN 'daily'
            WHEN regexp_matches(lower(salary_raw), 'per session|/session|sessional') THEN 'sessional'
            ELSE 'annual' END AS unit FROM amounts),
    numbered AS (SELECT *, CASE b WHEN '8a' THEN 8 WHEN '8b' THEN 9 WHEN '8c' THEN 10 WHEN '8d' THEN 11
        ELSE TRY_CAST(b AS INT) END AS bn FROM banded),
    with_band AS (SELECT n.*, lo AS band_min, hi AS band_max FROM numbered n LEFT JOIN (VALUES
        (1, 22383, 22383), (2, 23615, 25674), (3, 24071, 25674), (4, 26530, 29114), (5, 29970, 36483),
        (6, 37338, 44962), (7, 46148, 52809), (8, 53755, 60504), (9, 62215, 72293), (10, 74290, 85601),
        (11, 88168, 102585)) v(n, lo, hi) ON bn = v.n),
    unit1 AS (SELECT *, CASE WHEN unit = 'annual' AND list_max(am) < 5000 THEN 'hourly' ELSE unit END AS u1 FROM with_band),
    unit2 AS (SELECT *, CASE WHEN u1 = 'hourly' AND list_max(am) > 500 THEN 'annual' ELSE u1 END AS u2 FROM unit1),
    factored AS (SELECT *, CASE u2 WHEN 'hourly' THEN 1880 WHEN 'daily' THEN 230 WHEN 'sessional' THEN 400 ELSE 1 END AS f,
        lower(salary_raw) IN ('competitive', 'doe', 'negotiable', 'tbc', 'tba') AS sentinel FROM unit2),
    salaries AS (SELECT salary_raw, am, b, band_min, band_max, unit,
        CASE WHEN sentinel OR salary_raw IS NULL THEN NULL
            WHEN band_min IS NOT NULL THEN CASE WHEN len(am) >= 2 THEN CAST(trunc(list_min(am)) AS BIGINT) ELSE band_min END
            WHEN len(am) > 0 THEN CAST(trunc(list_min(am) * f) AS BIGINT) END AS salary_min,
        CASE WHEN sentinel OR salary_raw IS NULL THEN NULL
            WHEN band_min IS NOT NULL THEN CASE WHEN len(am) >= 2 THEN CAST(trunc(list_max(am)) AS BIGINT) ELSE band_max END
            WHEN len(am) > 0 THEN CAST(trunc(list_max(am) * f) AS BIGINT) END AS salary_max
        FROM factored)"""


def _pay_texts(t):
    return t.lineitem.select(F.expr(SALARY_TEXT).alias("salary_raw")).distinct()


@query("find_amounts", sql=f"""WITH {SALARY_PARTS}
    SELECT salary_raw, CAST(len(am) AS INTEGER) AS n, list_min(am) AS low, list_max(am) AS high,
        round(coalesce(list_sum(am), 0), 2) AS total FROM salaries WHERE salary_raw IS NOT NULL""")
def find_amounts(t):
    rows = _pay_texts(t).filter("salary_raw is not null").withColumn("am", M.find_amounts("salary_raw"))
    bounds = rows.withColumn("b", M.salary_bounds(F.col("am")))
    total = F.aggregate("am", F.lit(0.0), lambda a, x: a + x)
    return bounds.select(
        "salary_raw", F.size("am").alias("n"), F.col("b.min").alias("low"), F.col("b.max").alias("high"),
        F.round(total, 2).alias("total"),
    )


@query("afc_band", sql=f"""WITH {SALARY_PARTS} SELECT salary_raw, unit, CAST(band_min AS BIGINT) AS band_min,
    CAST(band_max AS BIGINT) AS band_max FROM salaries WHERE salary_raw IS NOT NULL""")
def afc_band(t):
    rows = _pay_texts(t).filter("salary_raw is not null").withColumn("band", M.afc_band("salary_raw"))
    return rows.select(
        "salary_raw", M.detect_unit("salary_raw").alias("unit"), F.col("band.min").alias("band_min"),
        F.col("band.max").alias("band_max"),
    )


@query("parse_salary", sql=f"""WITH {SALARY_PARTS}
    SELECT {_LINE}, l.salary_raw, salary_min, salary_max
    FROM (SELECT *, {SALARY_TEXT} AS salary_raw FROM lineitem) l
    LEFT JOIN salaries s ON l.salary_raw IS NOT DISTINCT FROM s.salary_raw""")
def parse_salary(t):
    rows = t.lineitem.select(*_LINE.split(", "), F.expr(SALARY_TEXT).alias("salary_raw"))
    return rows.withColumn("p", M.parse_salary("salary_raw")).select(
        *_LINE.split(", "), "salary_raw", F.col("p.min").alias("salary_min"), F.col("p.max").alias("salary_max")
    )


@query("annualise", sql=f"""
    SELECT {_LINE}, unit, CAST(trunc(l_extendedprice * CASE unit WHEN 'hourly' THEN 1880 WHEN 'daily' THEN 230
        WHEN 'sessional' THEN 400 ELSE 1 END) AS BIGINT) AS annual
    FROM (SELECT *, ['annual', 'hourly', 'daily', 'sessional'][1 + l_linenumber % 4] AS unit FROM lineitem)""")
def annualise(t):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("annual", "hourly", "daily", "sessional")]), F.col("l_linenumber") % 4 + 1)
    return t.lineitem.withColumn("unit", unit).select(
        *_LINE.split(", "), "unit", M.annualise("l_extendedprice", "unit").alias("annual")
    )


@query("salary_with_pack_unit", sql=f"""WITH {SALARY_PARTS},
    units AS (SELECT *, ['hourly', 'daily', 'annual'][i] AS pack FROM salaries, (VALUES (1), (2), (3)) v(i)
        WHERE salary_raw IS NOT NULL AND len(am) > 0 AND band_min IS NULL
            AND lower(salary_raw) NOT IN ('competitive', 'negotiable')),
    one AS (SELECT *, CASE WHEN unit = 'annual' THEN pack ELSE unit END AS u0, list_max(am) AS hi FROM units),
    two AS (SELECT *, CASE WHEN u0 = 'annual' AND hi < 5000 THEN 'hourly' ELSE u0 END AS u1 FROM one),
    three AS (SELECT *, CASE WHEN u1 = 'hourly' AND hi > 500 THEN 'annual' ELSE u1 END AS u2 FROM two)
    SELECT salary_raw, pack, CAST(trunc(hi * CASE u2 WHEN 'hourly' THEN 1820 WHEN 'daily' THEN 220
        WHEN 'sessional' THEN 400 ELSE 1 END) AS BIGINT) AS salary_max FROM three""")
def salary_with_pack_unit(t):
    packs = F.array(*[F.lit(u) for u in ("hourly", "daily", "annual")])
    rows = _pay_texts(t).select("salary_raw", F.explode(packs).alias("pack"))
    parsed = rows.withColumn(
        "p", M.parse_salary("salary_raw", F.concat("pack", F.lit("_gbp")), 1820, 220, F.lit(False))
    )
    no_band = M.afc_band("salary_raw").isNull()
    return parsed.filter(F.col("p.max").isNotNull() & no_band).select(
        "salary_raw", "pack", F.col("p.max").alias("salary_max"))


@query("salary_fallback", sql="""
    SELECT p_partkey, CASE
        WHEN p_partkey % 4 = 0 THEN 'Competitive'
        WHEN p_partkey % 4 = 1 THEN concat('£', p_retailprice, ' - £', p_retailprice + 10)
        WHEN p_partkey % 4 = 2 THEN concat('£', p_retailprice, ' - £') END AS salary_raw,
        CASE WHEN p_partkey % 4 = 1 THEN concat('£', format('{:,}', CAST(floor(p_retailprice) AS BIGINT)), ' - £',
                format('{:,}', CAST(floor(p_retailprice + 10) AS BIGINT)))
            WHEN p_partkey % 4 = 2 THEN concat('£', format('{:,}', CAST(floor(p_retailprice) AS BIGINT))) END AS shown
    FROM part""")
def salary_fallback(t):
    kind = F.col("p_partkey") % 4
    rows = t.part.select(
        "p_partkey",
        F.when(kind == 0, "Competitive").alias("raw"),
        F.when(kind.isin(1, 2), F.col("p_retailprice")).alias("low"),
        F.when(kind == 1, F.col("p_retailprice") + 10).alias("high"),
    )
    return rows.select(
        "p_partkey", M.salary_fallback("raw", "low", "high").alias("salary_raw"),
        M.range_text("low", "high").alias("shown"),
    )


@query("api_cost", uses=("calls",), sql="SELECT event_id, operation, round(est_cost_gbp, 6) AS est_cost_gbp FROM calls")
def api_cost(t):
    return t.inputs.calls().select("event_id", "operation", "est_cost_gbp")


# --- dates --------------------------------------------------------------------------------

_LAYOUTS = {
    0: ("d MMMM yyyy", "%-d %B %Y"),
    1: ("d MMM yyyy", "%-d %b %Y"),
    2: ("dd/MM/yyyy", "%d/%m/%Y"),
    3: ("dd-MM-yyyy", "%d-%m-%Y"),
    4: ("yyyy-MM-dd", "%Y-%m-%d"),
    5: ("d MMMM", "%-d %B"),
    6: ("d MMM", "%-d %b"),
    7: ("dd/MM/yy", "%d/%m/%y"),
    8: ("'next' d MMMM yyyy", "next %-d %B %Y"),
}


def _date_text():
    out = F.lit("31 February 2001")
    for n, (java, _) in _LAYOUTS.items():
        out = F.when(F.col("o_orderkey") % 10 == n, F.date_format("o_orderdate", java)).otherwise(out)
    ordinal = F.regexp_replace(out, r"^(\d+) ", "$1th  ")
    return F.concat(F.lit(" "), F.when(F.col("o_orderkey") % 3 == 0, ordinal).otherwise(out), F.lit(" .."))


_SQL_DATE_TEXT = "CASE CAST(o_orderkey % 10 AS INT) " + " ".join(
    f"WHEN {n} THEN strftime(o_orderdate, '{c}')" for n, (_, c) in _LAYOUTS.items()
) + " ELSE '31 February 2001' END"

# Formats with a year by the engine's own parser; the year-less ones against the reference day.
_SQL_PARSED = f"""CASE WHEN CAST(o_orderkey % 10 AS INT) IN (8, 9) THEN NULL
    WHEN CAST(o_orderkey % 10 AS INT) IN (5, 6) THEN (
        CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL
            WHEN make_date(2001, month(o_orderdate), day(o_orderdate)) < DATE '{AS_OF}'
            THEN make_date(2002, month(o_orderdate), day(o_orderdate))
            ELSE make_date(2001, month(o_orderdate), day(o_orderdate)) END)
    ELSE CAST(o_orderdate AS DATE) END"""


@query("try_parse_date", sql=f"SELECT o_orderkey, {_SQL_PARSED} AS parsed FROM orders")
def try_parse_date(t):
    # A trailing blank before the dots makes the text unreadable, so it is trimmed here.
    text = F.regexp_replace(_date_text(), r" \.\.$", "..")
    return t.orders.select("o_orderkey", D.try_parse_date(text, F.lit(AS_OF).cast("date")).alias("parsed"))


@query("closing_date", sql=f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN DATE '2003-05-04' ELSE {_SQL_PARSED} END AS closes_on
    FROM orders JOIN documents ON doc_id = o_orderkey % (SELECT count(*) FROM documents)""")
def closing_date(t):
    docs = t.documents.agg(F.count(F.lit(1))).scalar()
    lead = F.element_at(
        F.array(*[F.lit(x) for x in ("Closing date: ", "Deadline:\n ", "APPLICATION CLOSES\t", "Expires: soon\nclosing on 4th May 2003.\nApply by ")]),
        (F.col("o_orderkey") % 4 + 1).cast("int"),
    )
    text = F.regexp_replace(_date_text(), r" \.\.$", "..")
    rows = t.orders.withColumn("doc_id", F.col("o_orderkey") % docs).join(t.documents.select("doc_id", "text"), "doc_id")
    body = F.concat("text", F.lit("\n"), F.when(F.col("o_orderkey") % 4 == 3, F.concat(lead, F.lit("nothing"))).otherwise(F.concat(lead, text)), F.lit("\nEnd."))
    return rows.select("o_orderkey", D.extract_closing_date(body, F.lit(AS_OF).cast("date")).alias("closes_on"))


@query("parse_posted_date", sql="""
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderdate AS DATE) END AS posted_date,
        CASE WHEN o_orderkey % 4 <> 3 OR epoch_ms(o_orderdate) >= 100000000000
            THEN CAST(o_orderdate AS DATE) END AS extended_date
    FROM orders""")
def parse_posted_date(t):
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 2, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string"))
    )
    return t.orders.select(
        "o_orderkey", D.parse_posted_date(text).alias("posted_date"),
        D.parse_posted_date(text, extended=True).alias("extended_date"),
    )


@query("date_arithmetic", uses=("jobs",), sql=f"""
    SELECT job_id, CAST(datediff('day', DATE '{REPORT_DAY}', closes_on) AS INTEGER) AS days_left,
        CAST(datediff('day', posted_date, DATE '{REPORT_DAY}') AS INTEGER) AS age_days,
        (epoch(TIMESTAMP '{REPORT_DAY} 06:00:00') - epoch(CAST(last_seen AS TIMESTAMP))) / 86400 > 14 AS stale
    FROM jobs""")
def date_arithmetic(t):
    day = F.lit(REPORT_DAY).cast("date")
    return t.inputs.jobs().select(
        "job_id", D.days_left("closes_on", day).alias("days_left"), D.age_days("posted_date", day).alias("age_days"),
        D.is_stale("last_seen", F.lit(REPORT_DAY + " 06:00:00").cast("timestamp"), 14).alias("stale"),
    )


# --- places -------------------------------------------------------------------------------

_HOME = (53.5, -2.2)


@query("haversine", sql=f"""
    SELECT s_suppkey, round(3958.8 * 2 * atan2(sqrt(a), sqrt(1 - a)), 6) AS miles FROM (
        SELECT s_suppkey, pow(sin(radians(50 + 0.4::DOUBLE * s_nationkey - {_HOME[0]}::DOUBLE) / 2), 2)
            + cos(radians({_HOME[0]}::DOUBLE)) * cos(radians(50 + 0.4::DOUBLE * s_nationkey))
            * pow(sin(radians(-5 + 0.3::DOUBLE * s_nationkey - {_HOME[1]}::DOUBLE) / 2), 2) AS a FROM supplier)""")
def haversine(t):
    lat, lon = F.lit(50) + F.lit(0.4) * F.col("s_nationkey"), F.lit(-5) + F.lit(0.3) * F.col("s_nationkey")
    miles = G.haversine_miles(F.lit(_HOME[0]), F.lit(_HOME[1]), lat, lon)
    return t.supplier.select("s_suppkey", F.round(miles, 6).alias("miles"))


@query("geocode", uses=("postings",), sql="""
    SELECT location, p.l_linenumber, count(*) AS n, min(CASE WHEN location <> 'Remote' THEN 50 + 0.4::DOUBLE * n_nationkey END) AS lat,
        max(CASE WHEN location <> 'Remote' THEN -5 + 0.3::DOUBLE * n_nationkey END) AS lon
    FROM postings p LEFT JOIN nation ON n_name = location GROUP BY ALL""")
def geocode(t):
    places = t.nation.select(
        G.location_key("n_name").alias("location_key"), (F.lit(50) + F.lit(0.4) * F.col("n_nationkey")).alias("lat"),
        (F.lit(-5) + F.lit(0.3) * F.col("n_nationkey")).alias("lon"),
    )
    found = G.geocode(t.inputs.postings().select("location", "l_linenumber"), places)
    return found.groupBy("location", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.min("lat").alias("lat"), F.max("lon").alias("lon"))


@query("geo_index_scan", uses=("jobs",), sql=f"""
    SELECT job_id FROM (SELECT *, pow(sin(radians(lat - {_HOME[0]}::DOUBLE) / 2), 2)
            + cos(radians({_HOME[0]}::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - {_HOME[1]}::DOUBLE) / 2), 2) AS a FROM jobs)
    WHERE 3958.8 * 2 * atan2(sqrt(a), sqrt(1 - a)) <= 60""")
def geo_index_scan(t):
    return t.inputs.jobs().filter(G.within_miles("lat", "lon", *_HOME, 60)).select("job_id")


# --- labels -------------------------------------------------------------------------------

_TITLE = """concat(CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Product Owner ' WHEN 2 THEN 'Summer intern '
    WHEN 3 THEN 'Trainee ' WHEN 4 THEN 'Entry-Level ' WHEN 5 THEN 'Associate ' WHEN 6 THEN 'Mid level ' ELSE 'Leading ' END, 'clerk')"""
_BODY = """concat(text, ' ', CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN concat('Needs ', doc_id % 13, '+ years or 2 yrs.')
    WHEN 1 THEN 'No experience required.' WHEN 2 THEN 'An experienced person.' WHEN 3 THEN 'Work with staff.'
    WHEN 4 THEN 'Junior level' WHEN 5 THEN concat('At least 123 years, ', doc_id % 8, ' yr') ELSE '' END)"""
_YEARS = """list_max(list_transform(regexp_extract_all(body, '(?:^|[^0-9])([0-9]{1,2})\\s*\\+?\\s*(?:years?|yrs?)', 1),
    lambda y: CAST(y AS INTEGER)))"""


def sql_level(title: str, body: str, years: str) -> str:
    """The level by SQL, from the fixed wordings of :mod:`..functions.classify`."""
    cases = [f"WHEN regexp_matches({title}, '{p}') THEN '{level}'" for level, p in C.TITLE_LEVELS.items()]
    cases += [f"WHEN regexp_matches({body}, '{p}') THEN '{level}'" for level, p in C.TEXT_LEVELS.items()]
    return f"""CASE {" ".join(cases)} WHEN {years} >= 6 THEN 'Senior/Lead' WHEN {years} >= 3 THEN 'Mid-level'
        WHEN {years} >= 1 THEN 'Junior' WHEN {years} >= 0 THEN 'Graduate/Entry' ELSE 'Unspecified' END"""


# Jobs with their texts and what the level is read from.
LEVELLED = f"""levelled AS (SELECT *, {_YEARS} AS years FROM (SELECT jobs.*, text AS description, lower(title) AS low_title,
    lower(concat(title, ' ', text)) AS body FROM jobs JOIN documents d ON d.doc_id = jobs.doc_id))"""
SQL_LEVEL = sql_level("low_title", "body", "years")


@query("experience_level", sql=f"""
    WITH d AS (SELECT doc_id, lower({_TITLE}) AS title, lower(concat({_TITLE}, ' ', {_BODY})) AS body FROM documents),
    y AS (SELECT *, {_YEARS} AS years FROM d)
    SELECT doc_id, {sql_level('title', 'body', 'years')} AS level, years
    FROM y""")
def experience_level(t):
    rows = t.documents.select("doc_id", F.expr(_TITLE).alias("title"), F.expr(_BODY).alias("body"))
    return rows.select(
        "doc_id", C.experience_level("title", "body").alias("level"),
        C.max_years(F.concat("title", F.lit(" "), "body")).alias("years"),
    )


SQL_PRIORITY = f"""CASE WHEN status <> 'new' THEN concat(upper(status[1]), status[2:])
    WHEN fit_score IS NULL THEN 'Unscored'
    WHEN fit_score >= 8 AND (closes_on IS NULL OR datediff('day', DATE '{REPORT_DAY}', closes_on) <= 14) THEN 'P1 Apply'
    WHEN fit_score >= 7 THEN 'P2 Strong' WHEN fit_score >= 5 THEN 'P3 Maybe' ELSE 'P4 Low' END"""
SQL_RANK = """list_position(['P1 Apply', 'P2 Strong', 'Interview', 'Applied', 'Offer', 'P3 Maybe', 'P4 Low',
    'Unscored', 'Rejected', 'Closed', 'Ignore', 'Archive'], priority) - 1"""


@query("priority_label", uses=("jobs",), sql=f"""
    SELECT job_id, priority, CAST({SQL_RANK} AS INTEGER) AS rank, CASE status WHEN 'applied' THEN 'Follow up'
            WHEN 'interview' THEN 'Prep interview' WHEN 'offer' THEN 'Compare offer' WHEN 'rejected' THEN 'Archive lessons'
            WHEN 'ignore' THEN 'No action' WHEN 'archive' THEN 'No action' WHEN 'closed' THEN 'Closed'
            ELSE CASE priority WHEN 'P1 Apply' THEN 'Apply today' WHEN 'P2 Strong' THEN 'Review next'
                WHEN 'P3 Maybe' THEN 'Save if interesting' ELSE 'Skip unless useful' END END AS next_step
    FROM (SELECT *, {SQL_PRIORITY} AS priority FROM jobs)""")
def priority_label(t):
    label = C.priority_label("status", "fit_score", "closes_on", F.lit(REPORT_DAY).cast("date"))
    rows = t.inputs.jobs().withColumn("priority", label)
    return rows.select(
        "job_id", "priority", C.priority_order("priority").alias("rank"), C.next_step("status", "priority").alias("next_step"))


@query("score_bands", uses=("jobs",), sql=f"""
    SELECT job_id, CASE WHEN fit_score IS NULL THEN 'Unscored' WHEN fit_score >= 9 THEN 'Excellent 9-10'
            WHEN fit_score >= 7 THEN 'Strong 7-8' WHEN fit_score >= 5 THEN 'Possible 5-6'
            WHEN fit_score >= 3 THEN 'Weak 3-4' ELSE 'Low 0-2' END AS band,
        CASE WHEN fit_score >= 8 THEN 'green' WHEN fit_score >= 5 THEN 'amber' WHEN fit_score < 5 THEN 'red' END AS colour,
        CASE WHEN fit_score >= 9 THEN 'excellent' WHEN fit_score >= 7 THEN 'strong' END AS row_band,
        CASE status WHEN 'new' THEN 'EAF3F8' WHEN 'applied' THEN 'D9EAD3' WHEN 'interview' THEN 'D9E2F3'
            WHEN 'offer' THEN 'B6D7A8' WHEN 'rejected' THEN 'F4CCCC' WHEN 'archive' THEN 'D3D3D3'
            WHEN 'closed' THEN 'BEBEBE' WHEN 'ignore' THEN 'F0E68C' END AS fill,
        coalesce(datediff('day', DATE '{REPORT_DAY}', closes_on) BETWEEN 0 AND 7, false) AS soon
    FROM jobs""")
def score_bands(t):
    return t.inputs.jobs().select(
        "job_id", C.score_band("fit_score").alias("band"), C.score_colour("fit_score").alias("colour"),
        C.row_band("fit_score").alias("row_band"), C.status_label("status").alias("fill"),
        C.closes_soon("closes_on", F.lit(REPORT_DAY).cast("date")).alias("soon"),
    )
