"""Table schemas and the closed value sets used across the package."""

from __future__ import annotations

from pyspark.sql import types as T

# The status set a user may pick from, in display order.
STATUSES = ("new", "applied", "interview", "offer", "rejected", "ignore", "archive", "closed")

# Statuses that take a posting out of the "still open" views.
NOT_OPEN = ("rejected", "ignore", "archive", "closed")

# Priority labels shown in the overview, in display order.
OVERVIEW_PRIORITIES = (
    "P1 Apply", "P2 Strong", "P3 Maybe", "P4 Low", "Applied", "Interview", "Offer",
)

POSTING = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("matched_query", T.StringType()),
    T.StructField("title", T.StringType(), False),
    T.StructField("company", T.StringType(), False),
    T.StructField("location", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("url", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("posted_date", T.DateType()),
    T.StructField("closes_on", T.DateType()),
    T.StructField("salary_raw", T.StringType()),
    T.StructField("salary_min", T.LongType()),
    T.StructField("salary_max", T.LongType()),
    T.StructField("fit_score", T.DoubleType()),
    T.StructField("fit_confidence", T.DoubleType()),
    T.StructField("fit_reason", T.StringType()),
    T.StructField("matched_keywords", T.ArrayType(T.StringType())),
    T.StructField("ranker_version", T.StringType()),
    T.StructField("jd_content_hash", T.StringType()),
])

# What the history table adds to a posting.
HISTORY_FIELDS = [
    T.StructField("first_seen", T.DateType(), False),
    T.StructField("last_seen", T.DateType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("notes", T.StringType(), False),
    T.StructField("last_user_edit", T.TimestampType()),
]
HISTORY = T.StructType(POSTING.fields + HISTORY_FIELDS)

# Columns a changed description may overwrite on a known posting.
CONTENT_COLUMNS = (
    "description", "jd_content_hash", "salary_raw", "salary_min", "salary_max",
    "closes_on", "lat", "lon",
)
SCORE_COLUMNS = ("fit_score", "fit_confidence", "fit_reason", "matched_keywords", "ranker_version")

RUN = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("duration_s", T.DoubleType()),
    T.StructField("sources_ok", T.IntegerType()),
    T.StructField("sources_failed", T.IntegerType()),
    T.StructField("jobs_scraped", T.LongType()),
    T.StructField("jobs_new", T.LongType()),
    T.StructField("jobs_closed", T.LongType()),
    T.StructField("errors", T.ArrayType(T.StringType())),
])

API_CALL = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("operation", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("cached_input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("est_cost_gbp", T.DoubleType()),
])

_WORDS = T.ArrayType(T.StringType())

PROFILE = T.StructType([
    T.StructField("profile_id", T.StringType(), False),
    T.StructField("domain", T.StringType()),
    T.StructField("secondary_domains", _WORDS),
    T.StructField("location", T.StructType([
        T.StructField("city", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ])),
    T.StructField("search_radius_miles", T.IntegerType()),
    T.StructField("remote_ok", T.BooleanType()),
    T.StructField("core_skills", _WORDS),
    T.StructField("adjacent_skills", _WORDS),
    T.StructField("negative_signals", T.StructType([
        T.StructField("title_excludes", _WORDS),
        T.StructField("requires_years_above", T.IntegerType()),
        T.StructField("description_excludes", _WORDS),
        T.StructField("company_blocklist", _WORDS),
    ])),
    T.StructField("target_roles", T.StructType([
        T.StructField("core", _WORDS),
        T.StructField("adjacent", _WORDS),
        T.StructField("stretch", _WORDS),
    ])),
    T.StructField("filters", T.StructType([
        T.StructField("salary_floor_gbp", T.IntegerType()),
        T.StructField("max_days_since_posted", T.IntegerType()),
        T.StructField("exclude_companies", _WORDS),
        T.StructField("rejected_company_cooldown_days", T.IntegerType()),
    ])),
])

DOMAIN_PACK = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("display_name", T.StringType()),
    T.StructField("enable_by_default", _WORDS),
    T.StructField("disable_by_default", _WORDS),
    T.StructField("domain_adapters", T.MapType(T.StringType(), T.StructType([
        T.StructField("enabled", T.BooleanType()),
        T.StructField("base_url", T.StringType()),
    ]))),
    T.StructField("salary", T.StructType([
        T.StructField("default_unit", T.StringType()),
        T.StructField("agenda_for_change_bands", T.BooleanType()),
        T.StructField("hourly_to_annual_multiplier", T.IntegerType()),
        T.StructField("daily_to_annual_multiplier", T.IntegerType()),
    ])),
    T.StructField("senior_words", _WORDS),
    T.StructField("closing_date_patterns", _WORDS),
    T.StructField("ranker_context", T.StringType()),
    T.StructField("cv_parser_context", T.StringType()),
    T.StructField("skills_core", _WORDS),
    T.StructField("skills_adjacent", _WORDS),
    T.StructField("roles_core", _WORDS),
    T.StructField("roles_adjacent", _WORDS),
    T.StructField("roles_stretch", _WORDS),
])
