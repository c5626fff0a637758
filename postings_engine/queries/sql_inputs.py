"""The derived inputs of ``inputs.py`` once more, as SQL for the checking engine."""

from __future__ import annotations

# Fixed values of the registered queries.
AS_OF = "2001-08-01"
FILTER_DAY = "2001-10-30"
REPORT_DAY = "1995-09-15"
SPLIT_DAY = "2000-01-01"
COST_DAY = "2024-01-30"

SALARY_TEXT = """CASE CAST(l_partkey % 16 AS INT)
    WHEN 0 THEN 'Competitive'
    WHEN 1 THEN concat('£', CAST(floor(l_extendedprice) AS BIGINT))
    WHEN 2 THEN concat('£', CAST(l_quantity AS BIGINT), 'k')
    WHEN 3 THEN concat('£', CAST(l_quantity AS BIGINT), ' per hour')
    WHEN 4 THEN concat('£', CAST(l_quantity * 10 AS BIGINT), ' - £', CAST(l_quantity * 12 AS BIGINT), ' per day')
    WHEN 5 THEN concat('Band ', 1 + l_suppkey % 13)
    WHEN 6 THEN NULL
    WHEN 7 THEN concat('£', CAST(l_quantity AS BIGINT), '-', CAST(l_quantity AS BIGINT) + 5, 'k')
    WHEN 8 THEN concat(CAST(l_quantity AS BIGINT) + 10, 'k to ', CAST(l_quantity AS BIGINT) + 20, 'K pa')
    WHEN 9 THEN concat('£', CAST(l_quantity AS BIGINT), ',000 - ', CAST(l_quantity AS BIGINT) + 7, ',500')
    WHEN 10 THEN concat('Band 8', substring('abcde', CAST(1 + l_suppkey % 5 AS INT), 1))
    WHEN 11 THEN concat('Band 6 (£', CAST(l_quantity AS BIGINT) + 30, ',392 - £', CAST(l_quantity AS BIGINT) + 42, ',618)')
    WHEN 12 THEN concat('£', CAST(l_quantity * 8 AS BIGINT), ' per session')
    WHEN 13 THEN concat('£', CAST(l_quantity AS BIGINT), '.50/hr DOE')
    WHEN 14 THEN 'from £, depending'
    ELSE 'Negotiable' END"""

STATUS_LIST = "'new','applied','interview','offer','rejected','ignore','archive','closed'"
ORDER = (
    "seen_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
    "l_discount, l_tax"
)

INPUTS = {
    "postings": """
        SELECT concat('src', l_linenumber % 5) AS source, s_name AS company,
            concat(CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Senior ' WHEN '2' THEN 'Lead '
                WHEN '3' THEN 'Graduate ' WHEN '5' THEN 'Junior ' ELSE '' END,
                lower(p_type), ' specialist') AS title,
            concat('https://jobs.example.org/', l_suppkey, '?utm_source=feed&jobId=', l_partkey % 5, '#apply') AS raw_url,
            concat('https://jobs.example.org/', l_suppkey, '?jobId=', l_partkey % 5) AS url,
            CASE WHEN l_linenumber = 1 THEN 'Remote' ELSE n_name END AS location,
            CASE WHEN l_linenumber <> 1 THEN 50 + 0.4::DOUBLE * n_nationkey END AS lat,
            CASE WHEN l_linenumber <> 1 THEN -5 + 0.3::DOUBLE * n_nationkey END AS lon,
            """ + SALARY_TEXT + """ AS salary_raw,
            CAST(o_orderdate AS DATE) AS posted_date, CAST(l_shipdate AS DATE) AS seen_date,
            l_orderkey % (SELECT count(*) FROM documents) AS doc_id,
            (l_suppkey * 2 + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)
                % (SELECT count(*) FROM documents) AS version_doc,
            l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "keyed": """
        SELECT sha1(concat(lower(company), lower(title), url)) AS job_id, * FROM postings""",
    "jobs": f"""
        SELECT job_id, source, title, company, url, location, lat, lon, salary_raw, posted_date,
            first_seen, last_seen, doc_id, l_partkey, l_quantity,
            [{STATUS_LIST}][CAST((l_partkey + l_suppkey + length(title)) % 8 AS INT) + 1] AS status,
            CASE WHEN l_partkey % 11 <> 0 THEN round(l_quantity / 5, 1) END AS fit_score,
            CASE WHEN l_linenumber <> 7 THEN posted_date + CAST(20 + l_partkey % 60 AS INTEGER) END AS closes_on,
            concat('v', l_partkey % 2 + 1) AS ranker_version
        FROM (SELECT *, min(seen_date) OVER (PARTITION BY job_id) AS first_seen,
                max(seen_date) OVER (PARTITION BY job_id) AS last_seen,
                row_number() OVER (PARTITION BY job_id ORDER BY {ORDER}) AS rn FROM keyed)
        WHERE rn = 1""",
    "texts": """
        SELECT doc_id, text, lang, source,
            concat('<div class="a > b">', replace(text, '. ', '.</p><p>'), '</p></div><!-- note -->',
                '<script>if (a<b) go("</p>");</script> We offer ', source, ' perks &amp; &quot;more&quot;.',
                '   Founded in 1999 by ', lang, ' people. Equal  Opportunities for all.', chr(10), chr(10),
                chr(10), chr(10), 'To apply &lt;write&gt;. End') AS html
        FROM documents""",
    "versions": """
        SELECT k.*, d.text AS description,
            sha1(lower(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g'))) AS jd_content_hash
        FROM keyed k JOIN documents d ON d.doc_id = k.version_doc""",
    "calls": """
        SELECT event_id, ts AS timestamp, event_type AS operation, concat('m', user_id % 3) AS model,
            CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS input_tokens,
            CAST(json_extract_string(props, '$.k') AS BIGINT) * 40 AS cached_input_tokens,
            CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 AS output_tokens,
            round(CAST(json_extract_string(props, '$.k') AS BIGINT) * CASE event_type
                WHEN 'view' THEN 60 * 2.40::DOUBLE + 40 * 0.24::DOUBLE + 7 * 12.00::DOUBLE
                WHEN 'click' THEN 60 * 0.64::DOUBLE + 40 * 0.064::DOUBLE + 7 * 3.20::DOUBLE
                WHEN 'purchase' THEN 60 * 2.40::DOUBLE + 40 * 0.24::DOUBLE + 7 * 12.00::DOUBLE
                ELSE 0 END / 1000000, 6) AS est_cost_gbp
        FROM events""",
    "runs": """
        SELECT source, CAST(datediff('day', DATE '2024-01-01', day) AS BIGINT) * 5
                + CAST(substring(source, 4, 1) AS BIGINT) AS id,
            CAST(day AS TIMESTAMP) AS started_at, scraped AS jobs_scraped, fresh AS jobs_new,
            failed AS sources_failed
        FROM (SELECT concat('src', user_id % 5) AS source, CAST(ts AS DATE) AS day, count(*) AS scraped,
                count(*) FILTER (WHERE event_type = 'purchase' AND value > 60) AS fresh,
                count(*) FILTER (WHERE event_type = 'error') AS failed
            FROM events GROUP BY 1, 2)""",
}

NEEDS = {"keyed": ("postings",), "jobs": ("keyed",), "versions": ("keyed",)}


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for needed in (*_ordered(NEEDS.get(name, ())), name):
            if needed not in out:
                out.append(needed)
    return out


def with_inputs(sql: str, names: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the derived inputs it names and those they need."""
    if not names:
        return sql
    parts = ", ".join(f"{name} AS ({INPUTS[name]})" for name in _ordered(names))
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {parts}, {body[5:]}"
    return f"WITH {parts} {body}"
