"""Report and cost views over the history, the run log and the call log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import costs as C
from ..plans import reports as R
from ..sources.landing import parse_cost_log
from .registry import query
from .sql_inputs import COST_DAY, REPORT_DAY, STATUS_LIST
from .values import LEVELLED, SQL_LEVEL, SQL_PRIORITY, SQL_RANK

_DAY = f"DATE '{REPORT_DAY}'"
_LABELS = "['P1 Apply', 'P2 Strong', 'P3 Maybe', 'P4 Low', 'Applied', 'Interview', 'Offer']"


@query("status_counts", uses=("jobs",), sql="SELECT status, count(*) AS cnt FROM jobs GROUP BY status ORDER BY cnt DESC, status")
def status_counts(t):
    return R.status_counts(t.inputs.jobs())


@query("status_counts_full", uses=("jobs",), sql=f"""
    SELECT CAST(i - 1 AS INTEGER) AS position, s AS status, (SELECT count(*) FROM jobs WHERE status = s AND status <> 'offer') AS cnt
    FROM (SELECT unnest([{STATUS_LIST}]) AS s, generate_subscripts([{STATUS_LIST}], 1) AS i)""")
def status_counts_full(t):
    return R.status_counts_full(t.inputs.jobs().filter(F.col("status") != "offer"))


@query("priority_counts", uses=("jobs",), sql=f"""
    WITH p AS (SELECT {SQL_PRIORITY} AS priority FROM jobs)
    SELECT CAST(i - 1 AS INTEGER) AS position, s AS priority, (SELECT count(*) FROM p WHERE priority = s) AS cnt
    FROM (SELECT unnest({_LABELS}) AS s, generate_subscripts({_LABELS}, 1) AS i)""")
def priority_counts(t):
    return R.priority_counts(t.inputs.jobs(), REPORT_DAY)


@query("jobs_sorted", uses=("jobs",), sql="""
    SELECT job_id, fit_score, first_seen FROM jobs ORDER BY fit_score DESC NULLS LAST, first_seen DESC, job_id""")
def jobs_sorted(t):
    return R.jobs_sorted(t.inputs.jobs().select("job_id", "fit_score", "first_seen"))


_CANDIDATES = """SELECT * FROM jobs WHERE fit_score IS NULL OR fit_score >= 5 OR status <> 'new'
    ORDER BY fit_score DESC NULLS LAST, closes_on IS NULL, closes_on, first_seen DESC, job_id LIMIT 50"""


@query("overview_candidates", uses=("jobs",), sql=f"SELECT job_id, fit_score, closes_on, first_seen FROM ({_CANDIDATES})")
def overview_candidates(t):
    return R.overview_candidates(t.inputs.jobs()).select("job_id", "fit_score", "closes_on", "first_seen")


@query("overview_top15", uses=("jobs",), sql=f"""WITH {LEVELLED}
    SELECT job_id, priority, fit_score, status, closes_on, {SQL_LEVEL} AS experience
    FROM (SELECT *, {SQL_PRIORITY} AS priority FROM ({_CANDIDATES.replace('FROM jobs', 'FROM levelled')}))
    ORDER BY {SQL_RANK}, fit_score DESC NULLS LAST, coalesce(closes_on, DATE '9999-12-31'), job_id LIMIT 15""")
def overview_top15(t):
    return R.overview_top(t.inputs.jobs_with_text(
        "job_id", "title", "status", "fit_score", "closes_on", "first_seen"), REPORT_DAY).select("job_id", "priority", "fit_score", "status", "closes_on", "experience")


# Days of one year count as its first day here, so that the day's lists are longer than their limits.
_NEW_YEAR = "1995-01-01"
_YEARLY = "jobs_of_year AS (SELECT * REPLACE (CAST(date_trunc('year', first_seen) AS DATE) AS first_seen) FROM jobs)"


def _yearly(t):
    return t.inputs.jobs().withColumn("first_seen", F.trunc("first_seen", "year"))


@query("new_today", uses=("jobs",), sql=f"""WITH {_YEARLY}
    SELECT job_id, fit_score, closes_on, closes_on <= DATE '{_NEW_YEAR}' + 7 AS closes_soon FROM jobs_of_year
    WHERE first_seen = DATE '{_NEW_YEAR}' AND status = 'new' ORDER BY fit_score DESC NULLS LAST, job_id LIMIT 50""")
def new_today(t):
    return R.new_today(_yearly(t), _NEW_YEAR).select("job_id", "fit_score", "closes_on", "closes_soon")


def _sql_closing(rows: int) -> str:
    return f"""SELECT job_id, title, fit_score, closes_on, status FROM jobs WHERE closes_on <= {_DAY} + 7
        AND status NOT IN ('rejected', 'ignore', 'archive', 'closed') ORDER BY closes_on, job_id LIMIT {rows}"""


@query("closing_soon", uses=("jobs",), sql=_sql_closing(20))
def closing_soon(t):
    return R.closing_soon(t.inputs.jobs(), REPORT_DAY).select("job_id", "title", "fit_score", "closes_on", "status")


@query("closing_soon_digest", uses=("jobs",), sql=_sql_closing(10))
def closing_soon_digest(t):
    return R.digest_tables(t.inputs.jobs(), REPORT_DAY)["closing_soon"].select("job_id", "title", "fit_score", "closes_on", "status")


_FRESH = f"first_seen = DATE '{_NEW_YEAR}' AND status = 'new'"
_HIGH = f"SELECT job_id, fit_score FROM jobs_of_year WHERE {_FRESH} AND fit_score >= 7 ORDER BY fit_score DESC, job_id LIMIT 20"
_MID = f"SELECT job_id, fit_score FROM jobs_of_year WHERE {_FRESH} AND fit_score >= 5 AND fit_score < 7 ORDER BY fit_score DESC, job_id LIMIT 10"


@query("high_fit", uses=("jobs",), sql=f"WITH {_YEARLY} {_HIGH}")
def high_fit(t):
    return R.high_fit(_yearly(t), _NEW_YEAR).select("job_id", "fit_score")


@query("mid_fit", uses=("jobs",), sql=f"WITH {_YEARLY} {_MID}")
def mid_fit(t):
    return R.mid_fit(_yearly(t), _NEW_YEAR).select("job_id", "fit_score")


@query("digest_counts", uses=("jobs",), sql=f"""WITH {_YEARLY}
    SELECT (SELECT count(*) FROM ({_HIGH})) + (SELECT count(*) FROM ({_MID})) AS jobs_new,
        (SELECT count(*) FROM ({_HIGH})) AS jobs_high_fit""")
def digest_counts(t):
    return R.digest_counts(_yearly(t), _NEW_YEAR)


@query("passive_digest", uses=("jobs",), sql=f"""
    SELECT job_id, fit_score FROM jobs WHERE first_seen > {_DAY} - 7 AND first_seen <= {_DAY} AND fit_score >= 9""")
def passive_digest(t):
    return R.passive_digest(t.inputs.jobs(), REPORT_DAY).select("job_id", "fit_score")


@query("export_jobs_view", uses=("jobs",), sql=f"""WITH {LEVELLED}
    SELECT {SQL_PRIORITY} AS "Action", fit_score AS "Score", {SQL_LEVEL} AS "Experience", title AS "Title", company AS "Company",
        location AS "Location", salary_raw AS "Salary", closes_on AS "Closes", CAST(datediff('day', {_DAY}, closes_on) AS INTEGER) AS "Days Left",
        url AS "Apply", 'because ' || l_partkey AS "Fit Reason", status AS "Status", CASE WHEN l_partkey % 3 = 0 THEN 'seen' ELSE '' END AS "Notes",
        job_id AS "Job ID", posted_date AS "Posted", source AS "Source", 'a, ' || source AS "Matched Keywords",
        CASE WHEN l_partkey % 4 > 0 THEN lower(title) END AS "Query", CAST(l_quantity AS BIGINT) * 1000 AS "Salary Min",
        CAST(l_quantity AS BIGINT) * 1100 AS "Salary Max", first_seen AS "First Seen", ranker_version AS "Ranker Ver." FROM levelled""")
def export_jobs_view(t):
    key, pay = F.col("l_partkey"), F.col("l_quantity").cast("bigint")
    jobs = t.inputs.jobs_with_text().withColumns({
        "fit_reason": F.concat(F.lit("because "), key.cast("string")), "notes": F.when(key % 3 == 0, "seen").otherwise(""),
        "matched_query": F.when(key % 4 > 0, F.lower("title")), "matched_keywords": F.array(F.lit("a"), F.col("source")),
        "salary_min": pay * 1000, "salary_max": pay * 1100})
    return R.export_jobs_view(jobs, REPORT_DAY)


@query("next_steps", uses=("jobs",), sql=f"""
    SELECT priority, count(*) AS n, count(*) FILTER (WHERE datediff('day', {_DAY}, closes_on) BETWEEN 0 AND 7) AS due
    FROM (SELECT *, {SQL_PRIORITY} AS priority FROM jobs) GROUP BY ALL""")
def next_steps(t):
    return R.next_steps(t.inputs.jobs(), REPORT_DAY).groupBy("priority").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("due_soon").alias("due"))


@query("kanban", uses=("jobs",), sql=f"""
    SELECT CAST(list_position([{STATUS_LIST}], status) - 1 AS INTEGER) AS column_no, status, job_id, title, company, fit_score FROM jobs""")
def kanban(t):
    return R.kanban(t.inputs.jobs("job_id", "status", "title", "company", "fit_score"))


@query("top_employers_month", uses=("jobs",), sql="""
    SELECT company, count(*) AS cnt FROM jobs WHERE first_seen BETWEEN DATE '1995-09-01' AND DATE '1995-09-30'
    GROUP BY company ORDER BY cnt DESC, company LIMIT 10""")
def top_employers_month(t):
    return R.top_employers_month(t.inputs.jobs(), REPORT_DAY)


@query("calibration_pairs", uses=("jobs",), sql="""
    SELECT count(*) FILTER (WHERE fit_score >= 7 AND status = 'rejected') AS rejected_high, count(*) AS total FROM jobs""")
def calibration_pairs(t):
    return R.calibration_pairs(t.inputs.jobs())


@query("rerank_stale", uses=("jobs",), sql="SELECT job_id, ranker_version FROM jobs WHERE fit_score IS NOT NULL AND ranker_version <> 'v2'")
def rerank_stale(t):
    return R.rerank_stale(t.inputs.jobs(), "v2").select("job_id", "ranker_version")


@query("rank_expiry", uses=("jobs",), sql=f"""
    SELECT job_id, scored_on FROM (SELECT *, CASE WHEN fit_score IS NOT NULL THEN last_seen - CAST(l_partkey % 40 AS INTEGER) END AS scored_on FROM jobs)
    WHERE datediff('day', scored_on, {_DAY}) > 30""")
def rank_expiry(t):
    scored = F.when(F.col("fit_score").isNotNull(), F.date_sub("last_seen", (F.col("l_partkey") % 40).cast("int")))
    return R.rank_expiry(t.inputs.jobs().withColumn("scored_on", scored), REPORT_DAY, "scored_on").select("job_id", "scored_on")


# --- runs ----------------------------------------------------------------------------------


@query("latest_run", uses=("runs",), sql="SELECT * FROM runs ORDER BY id DESC LIMIT 1")
def latest_run(t):
    return R.latest_run(t.inputs.runs()).withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query("recent_runs", uses=("runs",), sql="SELECT id, source, jobs_scraped, jobs_new FROM runs ORDER BY id DESC LIMIT 30")
def recent_runs(t):
    return R.recent_runs(t.inputs.runs()).select("id", "source", "jobs_scraped", "jobs_new")


@query("quiet_streak", uses=("runs",), sql="""
    SELECT id, source, sum(jobs_new % 3) OVER w = 0 AND count(*) OVER w = 3 AS quiet FROM runs
    WINDOW w AS (PARTITION BY source ORDER BY id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def quiet_streak(t):
    runs = t.inputs.runs().withColumn("jobs_new", F.col("jobs_new") % 3)
    return R.quiet_streak(runs, "source").select("id", "source", "quiet")


@query("heartbeat_due", uses=("runs",), sql="""
    SELECT sent, quiet, quiet AND (sent IS NULL OR datediff('day', sent, DATE '2024-01-30') >= 7) AS due
    FROM (SELECT sum(n) = 0 AS quiet FROM (SELECT CASE WHEN id < 10000 THEN 0 ELSE jobs_new END AS n FROM runs ORDER BY id DESC LIMIT 3)),
        (SELECT unnest([DATE '2024-01-20', DATE '2024-01-24', NULL]) AS sent)""")
def heartbeat_due(t):
    """Once with the last mail long ago, once lately, and once without any."""
    quiet = F.when(F.col("id") < 10000, F.lit(0)).otherwise(F.col("jobs_new"))
    runs, out = t.inputs.runs().withColumn("jobs_new", quiet), None
    for sent in ("2024-01-20", "2024-01-24", None):
        one = R.heartbeat_due(runs, "2024-01-30", sent).select(F.lit(sent).cast("date").alias("sent"), "quiet", "due")
        out = one if out is None else out.union(one)
    return out


# --- costs ---------------------------------------------------------------------------------

_COSTS = f"""SELECT CAST(timestamp AS DATE) AS day, operation, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
        CAST(sum(cached_input_tokens) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
        round(sum(est_cost_gbp), 4) AS est_cost_gbp FROM calls WHERE timestamp >= DATE '{COST_DAY}' - {{days}} GROUP BY ALL"""


@query("cost_by_day_op_model", uses=("calls",), sql=_COSTS.format(days=30))
def cost_by_day_op_model(t):
    return C.cost_by_day_op_model(t.inputs.calls(), COST_DAY)


@query("cost_sorted", uses=("calls",), sql=_COSTS.format(days=30) + " ORDER BY day DESC, est_cost_gbp DESC, operation, model")
def cost_sorted(t):
    return C.cost_sorted(t.inputs.calls(), COST_DAY)


@query("cost_today", uses=("calls",), sql=f"""
    SELECT round(sum(est_cost_gbp), 6) AS today_gbp FROM calls WHERE CAST(timestamp AS DATE) = DATE '{COST_DAY}'""")
def cost_today(t):
    return C.cost_today(t.inputs.calls(), COST_DAY)


@query("cost_month_projection", uses=("calls",), sql=f"""
    SELECT round(sum(est_cost_gbp), 4) AS month_gbp, round(sum(est_cost_gbp) / 30 * 30, 2) AS projected_gbp FROM calls
    WHERE timestamp >= DATE '2024-01-01'""")
def cost_month_projection(t):
    return C.cost_projection(t.inputs.calls(), COST_DAY).select(
        F.round("month_gbp", 4).alias("month_gbp"), F.round("projected_gbp", 2).alias("projected_gbp"))


@query("cost_month", uses=("calls",), sql="SELECT round(sum(est_cost_gbp), 4) AS month_gbp FROM calls WHERE timestamp >= DATE '2024-01-01'")
def cost_month(t):
    return C.cost_month(t.inputs.calls(), COST_DAY).select(F.round("month_gbp", 4).alias("month_gbp"))


@query("cache_hit_rate", uses=("calls",), sql=f"""
    SELECT concat(CAST(round(100.0 * sum(cached_input_tokens) / sum(input_tokens)) AS BIGINT), '%') AS cache_hit_rate
    FROM calls WHERE CAST(timestamp AS DATE) = DATE '{COST_DAY}'""")
def cache_hit_rate(t):
    return C.cache_hit_rate(t.inputs.calls(), COST_DAY)


@query("soft_cap_status", uses=("calls",), sql=f"""
    SELECT round(sum(est_cost_gbp), 6) AS today_gbp, sum(est_cost_gbp) > 0.5 AS over_cap FROM calls WHERE CAST(timestamp AS DATE) = DATE '{COST_DAY}'""")
def soft_cap_status(t):
    return C.soft_cap_status(t.inputs.calls(), COST_DAY, 0.5)


@query("scan_cost_log", uses=("calls",), sql="""
    SELECT operation, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM calls
    WHERE event_id % 7 NOT IN (0, 1) GROUP BY ALL""")
def scan_cost_log(t):
    calls = t.inputs.calls().withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = F.to_json(F.struct("timestamp", "operation", "model", "input_tokens", "cached_input_tokens", "output_tokens", "est_cost_gbp"))
    kind = F.col("event_id") % 7
    text = F.when(kind == 0, F.lit("")).when(kind == 1, F.concat(F.lit("{broken "), line)).otherwise(line)
    return parse_cost_log(calls.select(text.alias("line")), "line").groupBy("operation").agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"))


@query("dashboard_costs", uses=("calls", "runs"), sql=f"""
    SELECT (SELECT round(sum(est_cost_gbp), 6) FROM calls WHERE CAST(timestamp AS DATE) = DATE '{COST_DAY}') AS today_gbp,
        (SELECT round(sum(est_cost_gbp), 4) FROM calls WHERE timestamp >= DATE '2024-01-01') AS month_gbp,
        (SELECT count(*) FROM (SELECT 1 FROM runs LIMIT 1)) AS last_runs""")
def dashboard_costs(t):
    tables = R.dashboard_tables(t.inputs.jobs(), t.inputs.runs(), t.inputs.calls(), COST_DAY)
    month = tables["cost_projection"].select(F.round("month_gbp", 4).alias("month_gbp")).scalar()
    runs = tables["last_run"].agg(F.count(F.lit(1)).alias("n")).scalar()
    return tables["cost_today"].withColumns({"month_gbp": month, "last_runs": runs})
