"""Record shapes of the supported feeds and their mapping to one common set of columns.

Each feed has a schema for its landed JSON, an ``*_items`` function that turns landed responses
into one row per raw posting, and a ``map_*`` function that renames and assembles its fields.
Mapped rows share :data:`COMMON`; :func:`postings_engine.sources.landing.conform` does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_filled, strip
from ..functions.money import range_text
from ..operators.dedup import cap_per_group, keep_first, keep_first_known

# The name each feed stamps on its rows, and how a missing address is built.
SOURCE_NAMES = {
    "paged_api": "adzuna",
    "list_detail": "reed",
    "board": "greenhouse",
    "postings": "lever",
    "tenant": "workday",
    "widget": "workable",
    "frame": "jobspy",
}
BOARD_URL = "https://boards.greenhouse.io/{slug}/jobs/{id}"
WIDGET_URL = "https://apply.workable.com/{slug}/j/{id}"

COMMON = (
    "title", "company", "url", "location", "description",
    "salary_raw", "salary_min", "salary_max", "created", "matched_query", "source",
)

PAGED_API = (
    "query string, query_pos int, page int, results array<struct<"
    "id: string, title: string, company: struct<display_name: string>,"
    "location: struct<display_name: string, area: array<string>>, description: string,"
    "salary_min: double, salary_max: double, salary_is_predicted: boolean,"
    "contract_type: string, redirect_url: string, created: string>>"
)
LIST_PAGE = (
    "query string, query_pos int, page int, results array<struct<"
    "jobId: bigint, jobTitle: string, employerName: string, jobUrl: string, locationName: string,"
    "jobDescription: string, minimumSalary: double, maximumSalary: double, date: string>>"
)
DETAIL = "jobId bigint, jobDescription string"
BOARD = (
    "slug string, jobs array<struct<id: string, title: string, location: string,"
    "content: string, absolute_url: string, updated_at: string>>"
)
POSTINGS = (
    "slug string, text string, descriptionBody string, description string,"
    "lists array<struct<text: string, content: string>>, closing string,"
    "categories struct<location: string, team: string>, hostedUrl string, applyUrl string,"
    "createdAt bigint"
)
TENANT = (
    "company string, api_base string, `offset` int, total bigint, jobPostings array<struct<"
    "title: string, externalPath: string, bulletFields: array<struct<fieldValue: string>>,"
    "locationsText: string, location: string, jobDescription: string, briefDescription: string,"
    "url: string>>"
)
WIDGET = (
    "slug string, results array<struct<title: string, shortcode: string, url: string,"
    "description: string, requirements: string, benefits: string, location: string,"
    "created_at: string>>"
)


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _common(df: DataFrame, **fields: Column) -> DataFrame:
    """Select the common columns; fields a feed does not have become NULL."""
    missing = {
        "salary_raw": "string", "salary_min": "double", "salary_max": "double",
        "created": "string", "matched_query": "string",
    }
    return df.select(
        *[fields.get(name, F.lit(None).cast(missing.get(name, "string"))).alias(name) for name in COMMON]
    )


def _exploded(df: DataFrame, items: str, *keep: str) -> DataFrame:
    """One row per element, with its position and the element's fields at top level."""
    return df.select(*keep, F.posexplode(items).alias("pos", "item")).select(*keep, "pos", "item.*")


def _named(df: DataFrame, companies: DataFrame) -> DataFrame:
    """Stamp the company name; a company without a name goes by its slug."""
    names = companies.select("slug", F.col("name").alias("_name"))
    joined = df.join(names, "slug", "left")
    return joined.withColumn("company_name", F.coalesce("_name", "slug")).drop("_name")


def paged_items(pages: DataFrame, results_per_query: int | None = None) -> DataFrame:
    """Rows of paged responses, all or at most N per query; first query wins, empty ids all kept."""
    rows = _exploded(pages, "results", "query", "query_pos", "page")
    capped = cap_per_group(rows, ["query"], ["page", "pos"], results_per_query) if results_per_query else rows
    return keep_first_known(capped, "id", ["query_pos", "page", "pos"])


def map_paged_api(items: DataFrame, name: str = SOURCE_NAMES["paged_api"]) -> DataFrame:
    place = F.split(_or_empty(F.col("location.display_name")), ", ")
    return _common(
        items,
        title=_or_empty(F.col("title")),
        company=_or_empty(F.col("company.display_name")),
        url=_or_empty(F.col("redirect_url")),
        location=F.array_join(F.slice(place, 1, 2), ", "),
        description=_or_empty(F.col("description")),
        salary_raw=range_text("salary_min", "salary_max"),
        salary_min=F.col("salary_min"),
        salary_max=F.col("salary_max"),
        created=_or_empty(F.col("created")),
        matched_query=F.col("query"),
        source=F.lit(name),
    )


def list_items(
    pages: DataFrame, details: DataFrame, results_per_query: int | None = None
) -> DataFrame:
    """List rows, one per id, with the full text from the per-id detail responses."""
    rows = _exploded(pages, "results", "query", "query_pos", "page")
    capped = cap_per_group(rows, ["query"], ["page", "pos"], results_per_query) if results_per_query else rows
    first = keep_first(capped, ["jobId"], ["query_pos", "page", "pos"])
    text = details.select("jobId", _or_empty(F.col("jobDescription")).alias("detail"))
    return first.join(text, "jobId", "left").withColumn(
        # Only a missing detail falls back; an empty one stays empty.
        "description", F.coalesce("detail", "jobDescription", F.lit(""))
    ).drop("detail")


def map_list_detail(items: DataFrame, name: str = SOURCE_NAMES["list_detail"]) -> DataFrame:
    return _common(
        items,
        title=_or_empty(F.col("jobTitle")),
        company=_or_empty(F.col("employerName")),
        url=_or_empty(F.col("jobUrl")),
        location=_or_empty(F.col("locationName")),
        description=F.col("description"),
        salary_raw=range_text("minimumSalary", "maximumSalary"),
        salary_min=F.col("minimumSalary"),
        salary_max=F.col("maximumSalary"),
        created=_or_empty(F.col("date")),
        matched_query=F.col("query"),
        source=F.lit(name),
    )


def board_items(boards: DataFrame, companies: DataFrame) -> DataFrame:
    return _named(_exploded(boards, "jobs", "slug"), companies)


def _url(template: str, slug: Column, ident: Column) -> Column:
    before, after = template.split("{slug}")
    middle, end = after.split("{id}")
    return F.concat(F.lit(before), slug, F.lit(middle), _or_empty(ident), F.lit(end))


def map_board(items: DataFrame, name: str = SOURCE_NAMES["board"]) -> DataFrame:
    # The location is an object in some boards and plain text in others; both land as text.
    place = F.when(
        F.col("location").startswith("{"), _or_empty(F.get_json_object("location", "$.name"))
    ).otherwise(_or_empty(F.col("location")))
    return _common(
        items,
        title=_or_empty(F.col("title")),
        company=F.col("company_name"),
        url=F.coalesce(first_filled("absolute_url"), _url(BOARD_URL, F.col("slug"), F.col("id"))),
        location=place,
        description=_or_empty(F.col("content")),
        created=_or_empty(F.col("updated_at")),
        source=F.concat(F.lit(name + ":"), F.col("slug")),
    )


def postings_items(postings: DataFrame, companies: DataFrame) -> DataFrame:
    return _named(postings, companies)


def map_postings(items: DataFrame, name: str = SOURCE_NAMES["postings"]) -> DataFrame:
    sections = F.flatten(F.transform("lists", lambda s: F.array(s["text"], s["content"])))
    parts = F.concat(
        F.array(first_filled("descriptionBody", "description")),
        F.coalesce(sections, F.array().cast("array<string>")),
        F.array(F.col("closing")),
    )
    filled = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return _common(
        items,
        title=_or_empty(F.col("text")),
        company=F.col("company_name"),
        url=_or_empty(first_filled("hostedUrl", "applyUrl")),
        location=_or_empty(first_filled("categories.location", "categories.team")),
        description=F.array_join(filled, "\n\n"),
        created=_or_empty(F.col("createdAt").cast("string")),
        source=F.concat(F.lit(name + ":"), F.col("slug")),
    )


def tenant_items(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows of offset pages, all or at most ``cap`` per company."""
    rows = _exploded(pages, "jobPostings", "company", "api_base", "offset")
    return cap_per_group(rows, ["company"], ["offset", "pos"], cap) if cap else rows


def map_tenant(items: DataFrame, name: str = SOURCE_NAMES["tenant"]) -> DataFrame:
    path = first_filled(F.col("externalPath"), F.get("bulletFields", F.lit(0))["fieldValue"])
    host = F.split_part(F.col("api_base"), F.lit("/wday/"), F.lit(1))
    built = F.when(F.col("api_base") != "", F.concat(host, path))
    return _common(
        items,
        title=_or_empty(F.col("title")),
        company=F.col("company"),
        url=F.coalesce(built, F.col("url"), F.lit("")),
        location=_or_empty(first_filled("locationsText", "location")),
        description=_or_empty(first_filled("jobDescription", "briefDescription")),
        source=F.lit(name),
    )


def widget_items(pages: DataFrame, companies: DataFrame) -> DataFrame:
    return _named(_exploded(pages, "results", "slug"), companies)


def map_widget(items: DataFrame, name: str = SOURCE_NAMES["widget"]) -> DataFrame:
    parsed = F.from_json("location", "city string, country string")
    place = F.when(
        F.col("location").startswith("{"),
        F.concat_ws(", ", first_filled(parsed["city"]), first_filled(parsed["country"])),
    ).otherwise(_or_empty(F.col("location")))
    return _common(
        items,
        title=_or_empty(F.col("title")),
        company=F.col("company_name"),
        url=F.coalesce(first_filled("url"), _url(WIDGET_URL, F.col("slug"), F.col("shortcode"))),
        location=place,
        description=F.concat_ws(
            "\n\n", *[first_filled(c) for c in ("description", "requirements", "benefits")]
        ),
        created=_or_empty(F.col("created_at")),
        source=F.concat(F.lit(name + ":"), F.col("slug")),
    )


def frame_items(frame: DataFrame) -> DataFrame:
    """Tabular rows, one per address; rows without an address are dropped."""
    rows = frame.withColumn("job_url", strip(_or_empty(F.col("job_url").cast("string"))))
    return keep_first(rows.filter(F.col("job_url") != ""), ["job_url"], ["query_pos", "pos"])


def safe_float(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def map_frame(items: DataFrame, name: str = SOURCE_NAMES["frame"]) -> DataFrame:
    def text(field: str) -> Column:
        return _or_empty(F.col(field).cast("string"))

    amount = F.nullif(F.nullif(text("min_amount"), F.lit("0")), F.lit("0.0"))
    return _common(
        items,
        title=text("title"),
        company=text("company"),
        url=F.col("job_url"),
        location=text("location"),
        description=text("description"),
        salary_raw=_or_empty(first_filled(text("salary_source"), amount)),
        salary_min=safe_float(F.col("min_amount")),
        salary_max=safe_float(F.col("max_amount")),
        created=text("date_posted"),
        matched_query=F.col("query"),
        source=F.lit(name),
    )
