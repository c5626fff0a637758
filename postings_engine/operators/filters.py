"""Policy filters. Each rule is a column that is true for rows to keep, NULL-safe by design.

Rules that need another table (blocklist table, cooldown) are anti joins; adaptive execution
broadcasts the small side when it measures it small and splits a company that holds too many rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import max_years
from ..functions.columns import ColumnLike, col, strings
from ..functions.geo import haversine_miles, is_remote
from ..schema import NOT_OPEN, STATUSES

# Limits used when a profile does not state them.
DEFAULT_MAX_AGE_DAYS = 30
DEFAULT_COOLDOWN_DAYS = 90
DEFAULT_RADIUS_MILES = 60
DEFAULT_PRESCORE_THRESHOLD = 3.0


def f_salary_floor(floor: int, salary_max: ColumnLike = "salary_max") -> Column:
    """Unknown pay passes; a floor of zero switches the rule off."""
    if not floor:
        return F.lit(True)
    return col(salary_max).isNull() | (col(salary_max) >= floor)


def f_max_age(max_days: int, as_of: ColumnLike, posted: ColumnLike = "posted_date") -> Column:
    return col(posted).isNull() | (F.datediff(col(as_of), col(posted)) <= max_days)


def f_company_block(companies, company: ColumnLike = "company") -> Column:
    """For a profile's short list; use :func:`block_companies` for a table of companies."""
    names = sorted({c.lower() for c in companies})
    return ~F.lower(col(company)).isin(*names) if names else F.lit(True)


def block_companies(df: DataFrame, blocked: DataFrame, column: str = "company") -> DataFrame:
    names = blocked.select(F.lower(column).alias("_blocked")).distinct()
    return df.join(names, F.lower(df[column]) == F.col("_blocked"), "left_anti")


def title_exclude_pattern(terms) -> str | None:
    """Whole-word, case-insensitive alternation of literal terms; None when there are none."""
    literal = [r"\Q" + t.strip().replace(r"\E", r"\E\\E\Q") + r"\E" for t in terms if t.strip()]
    return r"(?iU)\b(?:" + "|".join(literal) + r")\b" if literal else None


def f_title_exclude(terms, title: ColumnLike = "title") -> Column:
    pattern = title_exclude_pattern(terms)
    return ~F.coalesce(col(title), F.lit("")).rlike(pattern) if pattern else F.lit(True)


def cooling_companies(jobs: DataFrame, as_of: ColumnLike, cooldown_days: int) -> DataFrame:
    """Companies with a rejection seen within the cooldown, one row each, lower-cased."""
    cutoff = F.date_sub(col(as_of), cooldown_days)
    recent = jobs.filter((F.col("status") == "rejected") & (F.col("last_seen") >= cutoff))
    return recent.select(F.lower("company").alias("_cooling")).distinct()


def f_cooldown(df: DataFrame, jobs: DataFrame, as_of: ColumnLike, cooldown_days: int) -> DataFrame:
    cooling = cooling_companies(jobs, as_of, cooldown_days)
    return df.join(cooling, F.lower(df["company"]) == F.col("_cooling"), "left_anti")


def f_radius(
    home_lat: float | None, home_lon: float | None, radius: float, remote_ok: bool,
    location: ColumnLike = "location", lat: ColumnLike = "lat", lon: ColumnLike = "lon",
) -> Column:
    """Remote postings and postings without coordinates pass."""
    if remote_ok or home_lat is None or home_lon is None:
        return F.lit(True)
    distance = haversine_miles(F.lit(home_lat), F.lit(home_lon), lat, lon)
    return is_remote(location) | col(lat).isNull() | col(lon).isNull() | (distance <= radius)


def f_years_required(limit: int, description: ColumnLike = "description") -> Column:
    """Drop postings that ask for more years than the profile's limit."""
    return F.coalesce(max_years(description) <= limit, F.lit(True))


def f_open_status(status: ColumnLike = "status") -> Column:
    return ~col(status).isin(*NOT_OPEN)


def f_status_valid(status: ColumnLike = "status") -> Column:
    """Blank means "keep the current status" and is valid."""
    status = F.coalesce(col(status), F.lit(""))
    return (status == "") | status.isin(*STATUSES)


def f_prescore(threshold: float = DEFAULT_PRESCORE_THRESHOLD, score: ColumnLike = "fit_score") -> Column:
    return F.coalesce(col(score), F.lit(0.0)) >= threshold


def _profile_rules(profile: Mapping, as_of: Column) -> list[tuple[str, Column]]:
    filters, negative = profile.get("filters", {}), profile.get("negative_signals", {})
    home = profile.get("location", {})
    companies = [*filters.get("exclude_companies", []), *negative.get("company_blocklist", [])]
    return [
        ("salary_floor", f_salary_floor(filters.get("salary_floor_gbp", 0))),
        ("max_age", f_max_age(filters.get("max_days_since_posted", DEFAULT_MAX_AGE_DAYS), as_of)),
        ("company_block", f_company_block(companies)),
        ("title_exclude", f_title_exclude(negative.get("title_excludes", []))),
        ("cooldown", F.lit(True)),
        (
            "radius",
            f_radius(
                home.get("lat"), home.get("lon"),
                profile.get("search_radius_miles", DEFAULT_RADIUS_MILES),
                profile.get("remote_ok", True),
            ),
        ),
    ]


def _cooldown_days(profile: Mapping) -> int:
    return profile.get("filters", {}).get("rejected_company_cooldown_days", DEFAULT_COOLDOWN_DAYS)


def apply_filters(df: DataFrame, profile: Mapping, jobs: DataFrame | None, as_of) -> DataFrame:
    """Rows passing all rules of one profile: cheap column rules first, then the cooldown join."""
    as_of = F.lit(as_of).cast("date")
    for _, rule in _profile_rules(profile, as_of):
        df = df.filter(rule)
    return df if jobs is None else f_cooldown(df, jobs, as_of, _cooldown_days(profile))


def explain_filters(df: DataFrame, profile: Mapping, jobs: DataFrame | None, as_of) -> DataFrame:
    """Every row with ``drop_reason``: the first rule that drops it, NULL when it is kept."""
    as_of = F.lit(as_of).cast("date")
    rules = dict(_profile_rules(profile, as_of))
    if jobs is not None:
        cooling = cooling_companies(jobs, as_of, _cooldown_days(profile))
        df = df.join(cooling, F.lower(df["company"]) == F.col("_cooling"), "left")
        rules["cooldown"] = F.col("_cooling").isNull()
    reason = F.coalesce(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])
    return df.withColumn("drop_reason", reason).drop("_cooling")


def last_rejections(jobs: DataFrame) -> DataFrame:
    """``(_company, _rejected)``: the day each company was last seen with a rejection; companies in lower case."""
    return jobs.filter(F.col("status") == "rejected").groupBy(F.lower("company").alias("_company")).agg(F.max("last_seen").alias("_rejected"))


def with_last_rejection(df: DataFrame, jobs: DataFrame, name: str = "rejected") -> DataFrame:
    """Postings with the day their company was last seen with a rejection, NULL for none."""
    found = df.join(last_rejections(jobs), F.lower(df["company"]) == F.col("_company"), "left")
    return found.withColumn(name, F.col("_rejected")).drop("_company", "_rejected")


def filter_for_profiles(
    pairs: DataFrame, as_of, posting: str = "p", profile: str = "f", jobs: DataFrame | None = None, rejected: str | None = None,
) -> DataFrame:
    """The rules of :func:`apply_filters` for (posting, profile) pairs held as two struct columns.

    The pairs come from an equi join (see ``operators.matching``), never from a cross join.  ``jobs`` is the
    history for the cooldown: the last rejection of a company is compared with each profile's own limit.  ``rejected`` names a
    field of the posting that holds it already (:func:`with_last_rejection`): pairs then join nothing.
    """
    as_of = F.lit(as_of).cast("date")

    def p(name: str) -> Column:
        return F.col(f"{posting}.{name}")

    def f(name: str) -> Column:
        return F.col(f"{profile}.{name}")

    blocked = F.concat(
        F.coalesce(f("filters.exclude_companies"), strings([])),
        F.coalesce(f("negative_signals.company_blocklist"), strings([])),
    )
    terms = F.filter(
        F.transform(F.coalesce(f("negative_signals.title_excludes"), strings([])), lambda t: F.trim(t)),
        lambda t: t != "",
    )
    floor = F.coalesce(f("filters.salary_floor_gbp"), F.lit(0))
    max_age = F.coalesce(f("filters.max_days_since_posted"), F.lit(DEFAULT_MAX_AGE_DAYS))
    home_lat, home_lon = f("location.lat"), f("location.lon")
    distance = haversine_miles(home_lat, home_lon, p("lat"), p("lon"))
    near = F.coalesce(
        distance <= F.coalesce(f("search_radius_miles"), F.lit(DEFAULT_RADIUS_MILES)), F.lit(True)
    )
    title_hit = F.exists(
        terms, lambda t: F.rlike(F.coalesce(p("title"), F.lit("")), F.concat(F.lit(r"(?iU)\b\Q"), t, F.lit(r"\E\b")))
    )
    days = F.coalesce(f("filters.rejected_company_cooldown_days"), F.lit(DEFAULT_COOLDOWN_DAYS))

    def cooling(last: Column) -> Column:
        return F.coalesce(last >= F.date_sub(as_of, days), F.lit(False))

    if jobs is not None:
        pairs = pairs.join(last_rejections(jobs), F.lower(p("company")) == F.col("_company"), "left").filter(
            ~cooling(F.col("_rejected"))).drop("_company", "_rejected")
    if rejected is not None:
        pairs = pairs.filter(~cooling(p(rejected)))
    return pairs.filter(
        p("salary_max").isNull() | (floor == 0) | (p("salary_max") >= floor)
    ).filter(
        p("posted_date").isNull() | (F.datediff(as_of, p("posted_date")) <= max_age)
    ).filter(
        ~F.exists(blocked, lambda c: F.lower(c) == F.lower(F.coalesce(p("company"), F.lit(""))))
    ).filter(~title_hit).filter(
        F.coalesce(f("remote_ok"), F.lit(True)) | is_remote(p("location")) | near
    )
