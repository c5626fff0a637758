"""Text, address and identity functions over documents, pages and postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.geo import is_remote, location_key, non_geocodable
from ..functions.urls import canonical_url
from ..sources.landing import conform, require_fields
from .registry import query


@query(
    "job_key", uses=("keyed",),
    sql="SELECT job_id, company, title, url, count(*) AS records FROM keyed GROUP BY ALL",
)
def job_key(t):
    return t.inputs.keyed().groupBy("job_id", "company", "title", "url").agg(
        F.count(F.lit(1)).alias("records")
    )


_CANONICAL = """
    WITH raw AS ({source}),
    cut AS (SELECT *, split_part(raw_url, '#', 1) AS u FROM raw),
    parts AS (SELECT *, split_part(u, '?', 1) AS base,
        list_filter(string_split(substring(u, length(split_part(u, '?', 1)) + 2), '&'),
            lambda p: regexp_matches(p, '^(id|jobId|job_id|vacancyId|reference)=.')) AS kept FROM cut),
    keys AS (SELECT *, list_transform(kept, lambda p: split_part(p, '=', 1)) AS ks FROM parts),
    grouped AS (SELECT *, list_filter(ks, lambda k, i: list_position(ks, k) = i) AS once FROM keys),
    joined AS (SELECT *, array_to_string(flatten(list_transform(once,
        lambda k: list_filter(kept, lambda p: starts_with(p, k || '=')))), '&') AS q FROM grouped)
    SELECT {columns}, CASE WHEN q <> '' THEN base || '?' || q ELSE base END AS url FROM joined"""


@query("canonical_url_postings", uses=("postings",), sql=_CANONICAL.format(
    source="SELECT DISTINCT raw_url FROM postings", columns="raw_url"))
def canonical_url_postings(t):
    return t.inputs.postings().select("raw_url").distinct().withColumn("url", canonical_url("raw_url"))


_PAGE_URL = """concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'id=', page_id,
    '&session=', page_id * 7, '&reference=&jobId=', page_id % 10, '&id=x', page_id, '#frag?id=9')"""


@query("canonical_url_pages", sql=_CANONICAL.format(
    source=f"""SELECT page_id, replace(url, '#top', '') AS url,
        {_PAGE_URL.replace('url,', "replace(url, '#top', ''),").replace('(url,', "(replace(url, '#top', ''),")} AS raw_url FROM pages""",
    columns="page_id"))
def canonical_url_pages(t):
    clean = t.pages.select("page_id", F.replace("url", F.lit("#top"), F.lit("")).alias("url"))
    return clean.select("page_id", canonical_url(F.expr(_PAGE_URL)).alias("url"))


_ENTITIES = """replace(replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""


def _sql_strip(x: str) -> str:
    out = f"regexp_replace({x}, '<!--.*?-->', ' ', 'gs')"
    for tag in ("script", "style", "template"):
        out = f"regexp_replace({out}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'gis')"
    tags = """</?[A-Za-z][^''">]*(?:"[^"]*"[^''">]*|''[^'']*''[^''">]*)*>|<![^>]*>|<\\?[^>]*>"""
    return _ENTITIES.format(x=f"regexp_replace({out}, '{tags}', ' ', 'g')")


def _sql_boilerplate(x: str) -> str:
    for pattern in X.BOILERPLATE_PATTERNS:
        x = f"regexp_replace({x}, '{pattern}', ' ', 'gis')"
    return x


def _sql_ws(x: str) -> str:
    x = f"regexp_replace(regexp_replace({x}, '[^\\S\\n]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sql_truncate(x: str, n: int) -> str:
    head = int(n * 0.6)
    return (
        f"CASE WHEN length({x}) > {n} THEN concat(left({x}, {head}), chr(10), '[... truncated ...]', chr(10), "
        f"right({x}, {n - head})) ELSE {x} END"
    )


def _summary(text: str) -> list:
    """A long text as its size and digest, which compare whole texts cheaply."""
    return [F.length(text).alias("chars"), F.md5(text).alias("digest")]


_DIGEST = "length(x) AS chars, md5(x) AS digest"
_INT_DIGEST = "CAST(length(x) AS INTEGER) AS chars, md5(x) AS digest"


@query("strip_html", sql=f"SELECT page_id, {_INT_DIGEST} FROM (SELECT page_id, {_sql_strip('html')} AS x FROM pages)")
def strip_html(t):
    return t.pages.select("page_id", X.strip_html("html").alias("x")).select("page_id", *_summary("x"))


@query("remove_boilerplate", uses=("texts",),
       sql=f"SELECT doc_id, {_INT_DIGEST} FROM (SELECT doc_id, {_sql_boilerplate('html')} AS x FROM texts)")
def remove_boilerplate(t):
    return t.inputs.texts().select("doc_id", X.remove_boilerplate("html").alias("x")).select(
        "doc_id", *_summary("x"))


@query("normalise_ws", uses=("texts",),
       sql=f"SELECT doc_id, {_INT_DIGEST} FROM (SELECT doc_id, {_sql_ws('html')} AS x FROM texts)")
def normalise_ws(t):
    return t.inputs.texts().select("doc_id", X.normalise_ws("html").alias("x")).select(
        "doc_id", *_summary("x"))


@query("middle_truncate",
       sql=f"SELECT doc_id, {_INT_DIGEST} FROM (SELECT doc_id, {_sql_truncate('text', 1000)} AS x FROM documents)")
def middle_truncate(t):
    return t.documents.select("doc_id", X.middle_truncate("text", 1000).alias("x")).select(
        "doc_id", *_summary("x"))


@query("jd_hash", sql="""SELECT doc_id,
    sha1(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS jd_content_hash FROM documents""")
def jd_hash(t):
    return t.documents.select("doc_id", X.jd_hash("text").alias("jd_content_hash"))


@query("clean_jd", uses=("texts",), sql=f"""
    WITH a AS (SELECT doc_id, {_sql_strip('html')} AS x FROM texts),
    b AS (SELECT doc_id, {_sql_boilerplate('x')} AS x FROM a),
    c AS (SELECT doc_id, {_sql_ws('x')} AS x FROM b),
    d AS (SELECT doc_id, {_sql_truncate('x', 6000)} AS x FROM c)
    SELECT doc_id, {_INT_DIGEST},
        sha1(lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS jd_content_hash FROM d""")
def clean_jd(t):
    cleaned = t.inputs.texts().select("doc_id", X.clean_text("html").alias("x"))
    return cleaned.select("doc_id", *_summary("x"), X.jd_hash("x").alias("jd_content_hash"))


@query("clean_pages", sql=f"""
    WITH a AS (SELECT page_id, {_sql_strip('html')} AS x FROM pages),
    b AS (SELECT page_id, {_sql_boilerplate('x')} AS x FROM a),
    c AS (SELECT page_id, {_sql_ws('x')} AS x FROM b),
    d AS (SELECT page_id, {_sql_truncate('x', 6000)} AS x FROM c)
    SELECT page_id, {_INT_DIGEST} FROM d""")
def clean_pages(t):
    return t.pages.select("page_id", X.clean_text("html").alias("x")).select("page_id", *_summary("x"))


@query("is_remote", uses=("postings",), sql="""
    SELECT location, contains(lower(location), 'remote') AS remote,
        CASE WHEN lower(location) NOT IN ('', 'remote', 'uk-wide', 'nationwide', 'flexible')
            THEN location END AS place, count(*) AS n FROM postings GROUP BY ALL""")
def remote(t):
    return t.inputs.postings().groupBy(
        "location", is_remote("location").alias("remote"), non_geocodable("location").alias("place")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("location_key", sql="""SELECT doc_id, left(regexp_replace(
    regexp_replace(text, '[^\\p{L}\\p{N} _-]', '_', 'g'), '^\\s+|\\s+$', '', 'g'), 80) AS key
    FROM documents""")
def key_of_location(t):
    return t.documents.select("doc_id", location_key("text").alias("key"))


@query("truncate_jd_payload",
       sql=f"SELECT doc_id, {_INT_DIGEST} FROM (SELECT doc_id, left(text, 3000) AS x FROM documents)")
def payload(t):
    return t.documents.select("doc_id", X.truncate_payload("text").alias("x")).select(
        "doc_id", *_summary("x"))


_LISTED = "concat('- ', replace(text, '.', ';'), chr(10), '* last item,,', lang)"


@query("split_list", sql=f"""
    SELECT doc_id, CAST(len(items) AS INTEGER) AS n, md5(array_to_string(items, '|')) AS digest,
        items[len(items)] AS last FROM (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_LISTED}, '[\\n,;]+'),
            lambda x: regexp_replace(x, '^[ *\\t\\r-]+|[ *\\t\\r-]+$', '', 'g')), lambda x: x <> '') AS items
        FROM documents)""")
def split_list(t):
    return t.documents.select("doc_id", X.split_list(F.expr(_LISTED.replace("chr(10)", "char(10)"))).alias("items")).select(
        "doc_id", F.size("items").alias("n"), F.md5(F.array_join("items", "|")).alias("digest"),
        F.element_at("items", -1).alias("last"))


_ANSWER = """CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN ' Yes ' WHEN 1 THEN 'no' WHEN 2 THEN 'Y' WHEN 3 THEN '0'
    WHEN 4 THEN concat('about ', c_custkey, ' miles or 9') WHEN 5 THEN '_No response_' ELSE '' END"""


@query("parse_answers", sql=f"""
    SELECT c_custkey, CASE WHEN w IN ('yes', 'true', 'y', '1') THEN true
            WHEN w IN ('no', 'false', 'n', '0') THEN false ELSE c_acctbal > 0 END AS flag,
        TRY_CAST(nullif(regexp_extract(a, '([0-9]+)', 1), '') AS BIGINT) AS number,
        CASE WHEN trim(a) NOT IN ('', '_No response_', 'No response') THEN trim(a) END AS answer
    FROM (SELECT *, {_ANSWER} AS a, lower(trim({_ANSWER})) AS w FROM customer)""")
def parse_answers(t):
    a = F.expr(_ANSWER)
    return t.customer.select(
        "c_custkey", X.parse_bool(a, F.col("c_acctbal") > 0).alias("flag"), X.parse_int(a).alias("number"),
        X.no_response_null(a).alias("answer"),
    )


_FENCED = """CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN concat(' ```json', char(10), '[', c_custkey, ']', char(10), '``` tail')
    WHEN 1 THEN concat('```[', c_custkey, ']') WHEN 2 THEN concat('[', c_custkey, '] ') ELSE concat('a ```', c_custkey, '```') END"""


@query("strip_fences", sql=f"""
    SELECT c_custkey, CASE CAST(c_custkey % 4 AS INT) WHEN 3 THEN concat('a ```', c_custkey, '```')
        ELSE concat('[', c_custkey, ']') END AS body FROM customer""")
def strip_fences(t):
    return t.customer.select("c_custkey", X.strip_fences(F.expr(_FENCED)).alias("body"))


@query("keywords_text", sql="""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN array_to_string(string_split(p_name, ' '), ', ')
            ELSE p_name END AS shown,
        concat('["', array_to_string(string_split(p_name, ' '), '","'), '"]') AS stored FROM part""")
def keywords_text(t):
    words = F.split("p_name", " ")
    stored = X.keywords_to_json(words)
    return t.part.select(
        "p_partkey", X.format_keywords(F.when(F.col("p_partkey") % 3 == 0, stored).otherwise(F.col("p_name"))).alias("shown"),
        stored.alias("stored"),
    )


@query("require_fields", sql="""
    SELECT p_partkey, p_name AS title FROM part
    WHERE p_partkey % 5 <> 0 AND p_size % 4 <> 0""")
def required(t):
    raw = t.part.select(
        "p_partkey", F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).otherwise(F.lit("  ")).alias("company"),
        F.when(F.col("p_size") % 4 != 0, F.lit("https://x.example/")).alias("url"),
    )
    return require_fields(raw).select("p_partkey", "title")


_CONFORM = f"""
    WITH raw AS (SELECT p_partkey, p_name, p_brand, p_retailprice, p_size, d.text,
            concat(d.text, chr(10), 'Closing date: ', 1 + p_partkey % 28, ' March 200', 2 + p_partkey % 5, '.') AS body
        FROM part JOIN documents d ON d.doc_id = p_partkey % (SELECT count(*) FROM documents)),
    a AS (SELECT *, {_sql_strip('body')} AS x FROM raw),
    b AS (SELECT * EXCLUDE (x), {_sql_boilerplate('x')} AS x FROM a),
    c AS (SELECT * EXCLUDE (x), {_sql_ws('x')} AS x FROM b),
    d AS (SELECT * EXCLUDE (x), {_sql_truncate('x', 6000)} AS x FROM c)
    SELECT sha1(concat(lower(p_brand), lower(p_name), 'https://x.example/a?id=', p_partkey)) AS job_id,
        'unknown' AS source, p_name AS title, p_brand AS company, concat('https://x.example/a?id=', p_partkey) AS url,
        {_INT_DIGEST.replace('x)', 'd.x)')},
        sha1(lower(regexp_replace(d.x, '^\\s+|\\s+$', '', 'g'))) AS jd_content_hash,
        make_date(CAST(2002 + p_partkey % 5 AS INT), 3, CAST(1 + p_partkey % 28 AS INT)) AS closes_on,
        DATE '2001-01-01' + CAST(p_size AS INT) AS posted_date,
        CASE WHEN p_partkey % 3 = 0 THEN 'Competitive' ELSE concat('£', p_size, '.0 - £', p_size + 20000, '.0') END AS salary_raw,
        CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN CAST(NULLIF(p_size, 0) AS BIGINT) END
            ELSE CAST(p_size AS BIGINT) END AS salary_min,
        CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size + 20000 AS BIGINT) END
            ELSE CAST(p_size + 20000 AS BIGINT) END AS salary_max
    FROM d"""


@query("conform", sql=_CONFORM)
def conformed(t):
    docs = t.documents.agg(F.count(F.lit(1))).scalar()
    parts = t.part.withColumn("doc_id", F.col("p_partkey") % docs)
    even = F.col("p_partkey") % 2 == 0
    low, high = F.col("p_size").cast("double"), (F.col("p_size") + 20000).cast("double")
    raw = parts.join(t.documents.select("doc_id", "text"), "doc_id").select(
        F.col("p_name").alias("title"),
        F.lit("").alias("company"),
        F.col("p_brand").alias("employer"),
        F.concat(F.lit("HTTPS://x.example/a?utm=1&id="), F.col("p_partkey").cast("string")).alias("redirect_url"),
        F.concat(
            "text", F.lit("\nClosing date: "), (1 + F.col("p_partkey") % 28).cast("string"), F.lit(" March 200"),
            (2 + F.col("p_partkey") % 5).cast("string"), F.lit("."),
        ).alias("job_description"),
        F.concat(F.date_add(F.lit("2001-01-01").cast("date"), F.col("p_size")).cast("string"), F.lit("T09:00:00Z")).alias("date_posted"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("Competitive")).alias("salary"),
        # Half of the rows name their numbers by aliases, which make up a text but are no fallback for one.
        *[F.when(even, number).alias(name) for name, number in (("salary_min", low), ("salary_max", high))],
        *[F.when(~even, number).alias(name) for name, number in (("minimum_salary", low), ("maximum_salary", high))],
    )
    return conform(raw, "2001-08-01").select(
        "job_id", "source", "title", "company", "url", *_summary("description"), "jd_content_hash",
        "closes_on", "posted_date", "salary_raw", "salary_min", "salary_max",
    )


@query("conform_with_packs", sql="""
    SELECT 'https://x.example/p/' || p_partkey AS url, CAST((10 + p_size) * CASE WHEN p_partkey % 2 = 0 THEN 1820 ELSE 1880 END AS BIGINT) AS salary_min,
        CASE WHEN p_partkey % 2 = 0 THEN make_date(2002, 3, CAST(1 + p_partkey % 28 AS INT)) END AS closes_on,
        CASE WHEN p_partkey % 3 = 0 THEN 53.8::DOUBLE END AS lat, CASE WHEN p_partkey % 3 = 0 THEN -1.5::DOUBLE END AS lon FROM part""")
def conformed_with_packs(t):
    """Half of the rows have a domain with its own pay rules and closing wording; a third have a known place."""
    even = F.col("p_partkey") % 2 == 0
    raw = t.part.select(
        F.col("p_name").alias("title"), F.col("p_brand").alias("company"),
        F.concat(F.lit("https://x.example/p/"), F.col("p_partkey").cast("string")).alias("url"),
        F.when(F.col("p_partkey") % 3 == 0, "Leeds").when(F.col("p_partkey") % 3 == 1, "Remote").otherwise("Elsewhere").alias("location"),
        F.concat(F.lit("£"), (F.col("p_size") + 10).cast("string")).alias("salary"),
        F.concat(F.col("p_type"), F.lit("\nDoors shut: "), (1 + F.col("p_partkey") % 28).cast("string"), F.lit(" March 2002")).alias("description"),
        F.when(even, "care").otherwise("other").alias("domain"))
    packs = t.region.limit(1).select(
        F.lit("care").alias("name"),
        F.struct(F.lit("hourly_gbp").alias("default_unit"), F.lit(True).alias("agenda_for_change_bands"),
                 F.lit(1820).alias("hourly_to_annual_multiplier"), F.lit(230).alias("daily_to_annual_multiplier")).alias("salary"),
        F.array(F.lit(r"Doors shut: ([^\n]+)"), F.lit("a signal")).alias("closing_date_patterns"))
    places = t.region.limit(1).select(F.lit("Leeds").alias("location_key"), F.lit(53.8).alias("lat"), F.lit(-1.5).alias("lon"))
    return conform(raw, "2001-08-01", places, packs).select("url", "salary_min", "closes_on", "lat", "lon")
