"""Reading landed feeds, keeping bad records apart, and conforming good ones to one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import strip, with_once
from ..functions.dates import (
    extract_closing_date, extract_closing_date_with_packs, parse_posted_date,
)
from ..functions.geo import geocode
from ..functions.money import parse_salary, salary_fallback
from ..functions.text import DEFAULT_MAX_TOKENS, clean_text, jd_hash, make_job_id
from ..functions.urls import canonical_url
from ..schema import API_CALL, POSTING
from .arrays import read_array_records

CORRUPT = "_corrupt_record"

# Alternative spellings of a field in feeds that are not mapped by their own function.
ALIASES = {
    "title": ("title",),
    "company": ("company", "employer"),
    "url": ("url", "redirect_url"),
    "location": ("location", "location_name"),
    "description": ("description", "job_description"),
    "created": ("created", "posted_date", "date_posted"),
    "salary_raw": ("salary_raw", "salary", "salary_min_str"),
    "salary_min": ("salary_min", "minimum_salary"),
    "salary_max": ("salary_max", "maximum_salary"),
    "source": ("source",),
    "matched_query": ("matched_query",),
}


Schema = T.StructType | str


def _with_corrupt(schema: Schema) -> Schema:
    if isinstance(schema, str):
        return f"{schema}, {CORRUPT} string"
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_landed(
    spark: SparkSession, path: str, schema: Schema, multi_line: bool = False
) -> DataFrame:
    """Landed JSON with an explicit schema; unreadable records keep their text in a side column.

    By default every line is a record.  With ``multi_line`` every file is one object, or an array
    of them; a large array is read by several tasks.
    """
    texts = read_array_records(spark, path) if multi_line else spark.read.text(path)
    return parse_landed(texts.filter(strip("value") != ""), "value", schema)


def parse_landed(texts: DataFrame, text_column: str, schema: Schema, *keep: str) -> DataFrame:
    """As :func:`read_landed`, for JSON held in a text column of a table."""
    parsed = F.from_json(
        text_column, _with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    return texts.select(*keep, parsed.alias("_parsed")).select(*keep, "_parsed.*")


def good_records(landed: DataFrame) -> DataFrame:
    return landed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantine(landed: DataFrame, source: str) -> DataFrame:
    return landed.filter(F.col(CORRUPT).isNotNull()).select(
        F.lit(source).alias("source"), F.col(CORRUPT).alias("record")
    )


def union_sources(mapped: list[DataFrame]) -> DataFrame:
    """All feeds appended; a feed without some column contributes NULLs."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), mapped)


def f_source(df: DataFrame, source: str) -> DataFrame:
    return df.filter(F.col("source") == source)


def source_health(landed: DataFrame, *keys: str) -> DataFrame:
    """Records read and records that could not be parsed, per key (source and day, usually)."""
    bad = F.col(CORRUPT).isNotNull()
    return landed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(bad).alias("corrupt"),
        (F.count_if(~bad) > 0).alias("ok"),
    )


def _aliased(df: DataFrame, field: str) -> Column:
    """First filled alias among those the table has."""
    present = [F.col(a).cast("string") for a in ALIASES[field] if a in df.columns]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in present]) if present else F.lit(None).cast("string")


def _number(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string").try_cast("double") if name in df.columns else F.lit(None).cast("double")


def require_fields(df: DataFrame) -> DataFrame:
    """Rows that have a title, a company and an address."""
    wanted = [F.coalesce(strip(c), F.lit("")) != "" for c in ("title", "company", "url")]
    return df.filter(wanted[0] & wanted[1] & wanted[2])


def conform(
    raw: DataFrame,
    as_of,
    locations: DataFrame | None = None,
    packs: DataFrame | None = None,
    default_source: str = "unknown",
    max_jd_tokens: int = DEFAULT_MAX_TOKENS,
) -> DataFrame:
    """Mapped or raw rows to :data:`postings_engine.schema.POSTING`, without any shuffle but the lookups.

    ``locations`` adds coordinates by lookup.  With ``packs`` and a ``domain`` column in ``raw``
    each row uses its domain's pay unit, multipliers and closing-date patterns.
    """
    as_of = F.lit(as_of).cast("date")
    fields = {name: _aliased(raw, name) for name in ALIASES}
    keep = [c for c in ("seq", "domain", "lat", "lon") if c in raw.columns]
    df = raw.select(
        *keep,
        *[strip(F.coalesce(fields[n], F.lit(""))).alias(n) for n in ("title", "company", "url", "location")],
        fields["description"].alias("_raw_text"),
        fields["created"].alias("_created"),
        salary_fallback(fields["salary_raw"], fields["salary_min"], fields["salary_max"]).alias("salary_raw"),
        # The aliases may make up the text; numbers are taken over from the columns of these names alone.
        _number(raw, "salary_min").alias("_low"),
        _number(raw, "salary_max").alias("_high"),
        F.coalesce(fields["source"], F.lit(default_source)).alias("source"),
        fields["matched_query"].alias("matched_query"),
    )
    df = require_fields(df).withColumn("url", canonical_url("url"))

    salary, closes = parse_salary("salary_raw"), extract_closing_date("description", as_of)
    if packs is not None and "domain" in raw.columns:
        rules = packs.select(
            F.col("name").alias("domain"),
            F.col("salary").alias("_pay"),
            F.col("closing_date_patterns").alias("_patterns"),
        )
        df = df.join(rules, "domain", "left")
        salary = parse_salary(
            "salary_raw", "_pay.default_unit",
            F.coalesce("_pay.hourly_to_annual_multiplier", F.lit(1880)),
            F.coalesce("_pay.daily_to_annual_multiplier", F.lit(230)),
        )
        closes = extract_closing_date_with_packs("description", as_of, "_patterns")
    if locations is not None:
        df = geocode(df.drop("lat", "lon"), locations)
    for coordinate in ("lat", "lon"):
        if coordinate not in df.columns:
            df = df.withColumn(coordinate, F.lit(None).cast("double"))

    # Filters on the cleaned columns must not pull the cleaning along when they are pushed down.
    df = with_once(df, "description", clean_text("_raw_text", max_jd_tokens))
    df = with_once(df, "_parsed", F.struct(salary.alias("pay"), closes.alias("closes_on")))
    df = df.select(
        *[c for c in ("seq", "domain") if c in df.columns],
        make_job_id("company", "title", "url").alias("job_id"),
        "source", "matched_query", "title", "company", "location", "lat", "lon", "url", "description",
        parse_posted_date("_created").alias("posted_date"),
        F.col("_parsed.closes_on").alias("closes_on"),
        "salary_raw",
        F.coalesce(F.col("_parsed.pay.min"), F.nullif(F.col("_low"), F.lit(0.0)).cast("bigint")).alias("salary_min"),
        F.coalesce(F.col("_parsed.pay.max"), F.nullif(F.col("_high"), F.lit(0.0)).cast("bigint")).alias("salary_max"),
        jd_hash("description").alias("jd_content_hash"),
    )
    unscored = [f for f in POSTING.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in unscored])


def scan_cost_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines cost log; blank and unreadable lines are skipped."""
    return spark.read.schema(API_CALL).option("mode", "DROPMALFORMED").json(path)


def parse_cost_log(texts: DataFrame, text_column: str) -> DataFrame:
    """As :func:`scan_cost_log`, for log lines held in a text column."""
    return good_records(parse_landed(texts, text_column, API_CALL)).filter(
        F.col("timestamp").isNotNull()
    )


def scan_edits(df: DataFrame) -> DataFrame:
    """Edits from a sheet with ``Job ID``, ``Status`` and ``Notes`` columns, wherever they stand."""
    def cell(header: str) -> Column:
        return strip(F.coalesce(F.col(f"`{header}`").cast("string"), F.lit("")))

    extra = [c for c in ("row_no", "edited_at") if c in df.columns]
    return df.select(
        cell("Job ID").alias("job_id"), cell("Status").alias("status"), cell("Notes").alias("notes"), *extra
    ).filter(F.col("job_id") != "")


def read_edits_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edits saved as CSV; the file's modification time is the time of the edit."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    rows = rows.withColumn("edited_at", F.col("_metadata.file_modification_time"))
    return scan_edits(rows.withColumn("row_no", F.monotonically_increasing_id()))
