"""The feeds: landed JSON made from the tables, parsed, kept apart when broken, and mapped."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.reports import source_health_rag
from ..session import scratch_path
from ..sources import landing as L
from ..sources import shapes as H
from ..sources.feeds import Frame, Postings, Tenant, gather
from .registry import query

_PLACE = "concat('City ', p_size, ', Region ', p_size % 5, ', UK')"
_LOW = "CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 0 ELSE p_retailprice * 20 END"
_HIGH = "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice * 25 END"
_SHOW = "concat('£', format('{{:,}}', CAST(floor({x}) AS BIGINT)))"


def _sql_range() -> str:
    low, high = f"nullif({_LOW}, 0)", f"nullif({_HIGH}, 0)"
    return (
        f"CASE WHEN {low} IS NOT NULL AND {high} IS NOT NULL THEN {_SHOW.format(x=low)} || ' - ' || {_SHOW.format(x=high)} "
        f"WHEN {low} IS NOT NULL THEN {_SHOW.format(x=low)} WHEN {high} IS NOT NULL THEN {_SHOW.format(x=high)} END"
    )


def _range_fields():
    low = F.when(F.col("p_partkey") % 3 == 1, F.lit(0.0)).when(F.col("p_partkey") % 3 == 2, F.col("p_retailprice") * 20)
    return low, F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice") * 25)


def _pages(rows, keys: list[str], items: str, item, order: str):
    """Landed responses: one JSON text per page.  Pages are cut by key ranges, so each is short."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), item.alias("i")))), lambda x: x["i"])
    return rows.groupBy(*keys).agg(listed.alias(items))


def _text(pages, *columns: str):
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _broken(text, when):
    return F.when(when, F.concat(F.lit("{\"oops\""), text)).otherwise(text)


# --- paged API -----------------------------------------------------------------------------


def paged_landed(t):
    low, high = _range_fields()
    item = F.struct(
        F.when(F.col("p_partkey") % 7 == 0, "").otherwise((F.col("p_partkey") % 700).cast("string")).alias("id"),
        F.col("p_name").alias("title"), F.struct(F.col("p_brand").alias("display_name")).alias("company"),
        F.struct(F.expr(_PLACE).alias("display_name")).alias("location"), F.col("p_type").alias("description"),
        low.alias("salary_min"), high.alias("salary_max"),
        F.concat(F.lit("https://a.example/x?id="), F.col("p_partkey").cast("string")).alias("redirect_url"),
        F.lit("2001-07-01T10:00:00Z").alias("created"),
    )
    rows = t.part.withColumns({
        "query": F.lower("p_type"), "query_pos": F.length("p_type") * 100 + F.ascii("p_type"), "page": F.floor(F.col("p_partkey") / 50).cast("int")})
    pages = _pages(rows, ["query", "query_pos", "page"], "results", item, "p_partkey")
    text = _text(pages, "query", "query_pos", "page", "results")
    broken = (F.col("page") % 5 == 4) & (F.col("query") == "large")
    texts = pages.select(F.lit("2001-07-0").alias("d"), F.col("page").alias("p"), _broken(text, broken).alias("body"))
    return L.parse_landed(texts.withColumn("day", F.concat("d", (F.col("p") % 3 + 1).cast("string"))), "body", H.PAGED_API, "day")


_PAGED = """pages AS (SELECT *, lower(p_type) AS query, length(p_type) * 100 + ascii(p_type) AS query_pos, p_partkey // 50 AS page FROM part),
    good AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY p_partkey) AS n FROM pages
        WHERE NOT (page % 5 = 4 AND query = 'large')),
    capped AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CAST(p_partkey % 700 AS VARCHAR) END AS id FROM good),
    items AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_pos, p_partkey) AS k FROM capped) WHERE k = 1 OR id = '')"""


@query("map_paged_api", sql=f"""WITH {_PAGED}
    SELECT p_name AS title, p_brand AS company, 'https://a.example/x?id=' || p_partkey AS url, 'City ' || p_size || ', Region ' || (p_size % 5) AS location,
        {_sql_range()} AS salary_raw, query AS matched_query, 'adzuna' AS source FROM items""")
def map_paged_api(t):
    mapped = H.map_paged_api(H.paged_items(L.good_records(paged_landed(t))))
    return mapped.select("title", "company", "url", "location", "salary_raw", "matched_query", "source")


@query("source_health", sql="""
    WITH p AS (SELECT DISTINCT lower(p_type) AS query, p_partkey // 50 AS page FROM part)
    SELECT '2001-07-0' || (page % 3 + 1) AS day, count(*) AS records, count(*) FILTER (WHERE page % 5 = 4 AND query = 'large') AS corrupt,
        count(*) FILTER (WHERE NOT (page % 5 = 4 AND query = 'large')) > 0 AS ok FROM p GROUP BY ALL""")
def source_health(t):
    return L.source_health(paged_landed(t), "day")


@query("source_health_rag", sql="""
    WITH p AS (SELECT DISTINCT lower(p_type) AS query, p_partkey // 50 AS page FROM part),
    h AS (SELECT '2001-07-0' || (page % 3 + 1) AS day, count(*) AS records, count(*) FILTER (WHERE page % 5 = 4 AND query = 'large') AS corrupt FROM p GROUP BY 1)
    SELECT 'paged' AS source, day, records, corrupt, CASE WHEN corrupt = 0 THEN 'green' WHEN corrupt < records THEN 'amber' ELSE 'red' END AS colour
    FROM h ORDER BY day DESC LIMIT 1""")
def health_rag(t):
    health = L.source_health(paged_landed(t), "day").withColumn("source", F.lit("paged"))
    return source_health_rag(health, "source", "day")


@query("quarantine", sql="""
    SELECT 'paged' AS source, count(*) AS n FROM (SELECT DISTINCT lower(p_type), p_partkey // 50 FROM part
        WHERE (p_partkey // 50) % 5 = 4 AND p_type = 'LARGE') HAVING count(*) > 0""")
def quarantine(t):
    return L.quarantine(paged_landed(t), "paged").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# --- list and detail -----------------------------------------------------------------------


def _list_items(t):
    low, high = _range_fields()
    item = F.struct(
        (F.col("p_partkey") % 900).alias("jobId"), F.col("p_name").alias("jobTitle"), F.col("p_brand").alias("employerName"),
        F.concat(F.lit("https://r.example/"), F.col("p_partkey").cast("string")).alias("jobUrl"), F.lit("Leeds").alias("locationName"),
        F.concat(F.lit("short "), F.col("p_type")).alias("jobDescription"), low.alias("minimumSalary"), high.alias("maximumSalary"),
        F.lit("2001-07-02").alias("date"))
    rows = t.part.withColumns({
        "query": F.lower("p_brand"), "query_pos": F.substring("p_brand", 7, 9).cast("int"), "page": F.floor(F.col("p_partkey") / 100).cast("int")})
    pages = _pages(rows, ["query", "query_pos", "page"], "results", item, "p_partkey")
    parsed = L.parse_landed(pages.select(_text(pages, "query", "query_pos", "page", "results").alias("body")), "body", H.LIST_PAGE)
    details = t.documents.select(
        F.to_json(F.struct(F.col("doc_id").alias("jobId"), F.when(F.col("doc_id") % 6 != 0, F.col("text")).otherwise("").alias("jobDescription"))).alias("body"))
    return H.list_items(L.good_records(parsed), L.good_records(L.parse_landed(details, "body", H.DETAIL)))


@query("map_list_detail", sql=f"""
    WITH pages AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
    items AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 900 ORDER BY CAST(p_brand[7:] AS INT), p_partkey) AS k FROM pages) WHERE k = 1)
    SELECT p_name AS title, p_brand AS company, 'https://r.example/' || p_partkey AS url, 'Leeds' AS location, {_sql_range()} AS salary_raw,
        md5(CASE WHEN doc_id IS NULL THEN 'short ' || p_type WHEN doc_id % 6 = 0 THEN '' ELSE text END) AS digest, lower(p_brand) AS matched_query
    FROM items LEFT JOIN documents ON doc_id = p_partkey % 900""")
def map_list_detail(t):
    return H.map_list_detail(_list_items(t)).select(
        "title", "company", "url", "location", "salary_raw", F.md5("description").alias("digest"), "matched_query")


# --- boards, postings, widgets -------------------------------------------------------------


def companies(t):
    return t.supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"),
        F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("name"))


def _slugged(t):
    n = t.supplier.agg(F.count(F.lit(1))).scalar()
    return t.part.withColumn("slug", F.concat(F.lit("s"), (F.col("p_partkey") % n).cast("string")))


_NAMED = """named AS (SELECT part.*, 's' || s_suppkey AS slug, CASE WHEN s_suppkey % 4 = 0 THEN 's' || s_suppkey ELSE s_name END AS company
    FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier))"""


def _sql_url(template: str, ident: str) -> str:
    """The address template as an SQL expression over slug and ``ident``."""
    return "'" + template.replace("{slug}", "' || slug || '").replace("{id}", f"' || {ident} || '") + "'"


@query("map_board", sql=f"""WITH {_NAMED}
    SELECT p_name AS title, company, CASE WHEN p_partkey % 5 = 0 THEN {_sql_url(H.BOARD_URL, 'p_partkey')}
            ELSE 'https://b.example/' || p_partkey END AS url,
        CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'Town ' || p_size WHEN 1 THEN 'Plain ' || p_size ELSE '' END AS location,
        p_type AS description, 'greenhouse:' || slug AS source FROM named""")
def map_board(t):
    kind = F.col("p_partkey") % 3
    place = F.when(kind == 0, F.to_json(F.struct(F.concat(F.lit("Town "), F.col("p_size").cast("string")).alias("name")))).when(
        kind == 1, F.to_json(F.struct(F.concat(F.lit("Plain "), F.col("p_size").cast("string")).alias("x")))).otherwise("null")
    # The location is an object, a text or missing: its JSON is put in as it stands.
    place = F.when(kind == 1, F.concat(F.lit('"Plain '), F.col("p_size").cast("string"), F.lit('"'))).otherwise(place)
    job = F.concat(
        F.lit('{"id":'), F.col("p_partkey").cast("string"), F.lit(',"title":"'), F.col("p_name"), F.lit('","location":'), place,
        F.lit(',"content":"'), F.col("p_type"), F.lit('","absolute_url":"'),
        F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("https://b.example/"), F.col("p_partkey").cast("string"))).otherwise(""),
        F.lit('","updated_at":"2001-01-01"}'))
    texts = _slugged(t).groupBy("slug", F.floor(F.col("p_partkey") / 1000)).agg(F.array_join(F.collect_list(job), ",").alias("jobs")).select(
        F.concat(F.lit('{"slug":"'), F.col("slug"), F.lit('","jobs":['), F.col("jobs"), F.lit("]}")).alias("body"))
    boards = L.good_records(L.parse_landed(texts, "body", H.BOARD))
    return H.map_board(H.board_items(boards, companies(t))).select("title", "company", "url", "location", "description", "source")


@query("map_postings", sql=f"""WITH {_NAMED}
    SELECT p_name AS title, company, CASE WHEN p_partkey % 4 = 0 THEN 'https://apply.example/' ELSE 'https://l.example/' END || p_partkey AS url,
        CASE WHEN p_partkey % 3 = 0 THEN 'Team' ELSE 'City ' || p_size END AS location,
        CASE WHEN p_partkey % 2 = 0 THEN 'body' ELSE 'plain' END || chr(10) || chr(10) || 'Needs' || chr(10) || chr(10) || '<li>' || p_type || '</li>'
            || chr(10) || chr(10) || 'Offers' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE chr(10) || chr(10) || 'bye' END AS description,
        CAST(1000000000000 + p_partkey AS VARCHAR) AS created, 'lever:' || slug AS source FROM named""")
def map_postings(t):
    parsed = L.good_records(L.parse_landed(_postings_texts(t), "body", H.POSTINGS))
    return H.map_postings(H.postings_items(parsed, companies(t))).select("title", "company", "url", "location", "description", "created", "source")


def _postings_texts(t):
    key = F.col("p_partkey").cast("string")
    row = F.struct(
        "slug", F.col("p_name").alias("text"), F.when(F.col("p_partkey") % 2 == 0, "body").otherwise("").alias("descriptionBody"),
        F.lit("plain").alias("description"),
        F.array(F.struct(F.lit("Needs").alias("text"), F.concat(F.lit("<li>"), F.col("p_type"), F.lit("</li>")).alias("content")),
                F.struct(F.lit("Offers").alias("text"), F.lit("").alias("content"))).alias("lists"),
        F.when(F.col("p_partkey") % 5 != 0, "bye").alias("closing"),
        F.struct(F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("City "), F.col("p_size").cast("string"))).alias("location"), F.lit("Team").alias("team")).alias("categories"),
        F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("https://l.example/"), key)).alias("hostedUrl"),
        F.concat(F.lit("https://apply.example/"), key).alias("applyUrl"), (F.lit(1000000000000) + F.col("p_partkey")).alias("createdAt"))
    return _slugged(t).select("p_partkey", F.to_json(row).alias("body"))


@query("map_widget", sql=f"""WITH {_NAMED}
    SELECT p_name AS title, company, CASE WHEN p_partkey % 5 = 0 THEN {_sql_url(H.WIDGET_URL, "'X' || p_partkey")} ELSE 'https://w.example/' || p_partkey END AS url,
        CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'Town, UK' WHEN 1 THEN 'UK' ELSE 'Text' END AS location,
        p_type || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || 'needs' ELSE '' END || chr(10) || chr(10) || 'perks' AS description, 'workable:' || slug AS source FROM named""")
def map_widget(t):
    kind = F.col("p_partkey") % 3
    place = F.when(kind == 0, F.lit('{"city":"Town","country":"UK"}')).when(kind == 1, F.lit('{"city":"","country":"UK"}')).otherwise('"Text"')
    job = F.concat(
        F.lit('{"title":"'), F.col("p_name"), F.lit('","shortcode":"X'), F.col("p_partkey").cast("string"), F.lit('","url":'),
        F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit('"https://w.example/'), F.col("p_partkey").cast("string"), F.lit('"'))).otherwise("null"),
        F.lit(',"description":"'), F.col("p_type"), F.lit('","requirements":"'), F.when(F.col("p_partkey") % 2 == 0, "needs").otherwise(""),
        F.lit('","benefits":"perks","location":'), place, F.lit("}"))
    texts = _slugged(t).groupBy("slug", F.floor(F.col("p_partkey") / 1000)).agg(F.array_join(F.collect_list(job), ",").alias("jobs")).select(
        F.concat(F.lit('{"slug":"'), F.col("slug"), F.lit('","results":['), F.col("jobs"), F.lit("]}")).alias("body"))
    pages = L.good_records(L.parse_landed(texts, "body", H.WIDGET))
    return H.map_widget(H.widget_items(pages, companies(t))).select("title", "company", "url", "location", "description", "source")


# --- tenants and frames --------------------------------------------------------------------


@query("map_tenant", sql="""
    SELECT p_name AS title, p_brand AS company, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'https://t.example/job/' || p_partkey WHEN 1 THEN 'https://t.example/alt/' || p_partkey
            ELSE 'https://u.example/' || p_partkey END AS url,
        CASE WHEN p_partkey % 2 = 0 THEN 'Here' ELSE 'There' END AS location, CASE WHEN p_partkey % 4 = 0 THEN 'brief' ELSE p_type END AS description
    FROM part""")
def map_tenant(t):
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    item = F.struct(
        F.col("p_name").alias("title"), F.when(kind == 0, F.concat(F.lit("/job/"), key)).alias("externalPath"),
        F.array(F.struct(F.when(kind == 1, F.concat(F.lit("/alt/"), key)).alias("fieldValue"))).alias("bulletFields"),
        F.when(F.col("p_partkey") % 2 == 0, "Here").alias("locationsText"), F.lit("There").alias("location"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).otherwise("").alias("jobDescription"), F.lit("brief").alias("briefDescription"),
        F.concat(F.lit("https://u.example/"), key).alias("url"))
    rows = t.part.withColumns({
        "company": F.col("p_brand"), "api_base": F.lit("https://t.example/wday/cxs/t/site/jobs"), "offset": (F.floor(F.col("p_partkey") / 20) * 20).cast("int")})
    pages = _pages(rows, ["company", "api_base", "offset"], "jobPostings", item, "p_partkey")
    parsed = L.parse_landed(pages.select(_text(pages, "company", "api_base", "offset", "jobPostings").alias("body")), "body", H.TENANT)
    return H.map_tenant(H.tenant_items(L.good_records(parsed))).select("title", "company", "url", "location", "description")


def _frame(t):
    return t.part.select(
        F.concat(F.lit(" https://f.example/"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise((F.col("p_partkey") % 800).cast("string"))).alias("u"),
        F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 8 != 0, F.col("p_brand")).alias("company"), F.lit(None).cast("string").alias("location"),
        F.col("p_type").alias("description"), F.when(F.col("p_partkey") % 5 == 0, "listed £30k").alias("salary_source"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice").cast("string")).when(F.col("p_partkey") % 2 == 0, "n/a").alias("min_amount"),
        F.lit(0).alias("max_amount"), F.lit("2001-05-05").cast("date").alias("date_posted"), F.lower("p_type").alias("query"),
        F.length("p_type").alias("query_pos"), F.col("p_partkey").alias("pos"),
    ).withColumn("job_url", F.when(F.col("pos") % 9 != 0, F.col("u"))).drop("u")


@query("map_frame", sql="""
    SELECT p_name AS title, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_brand END AS company, 'https://f.example/' || (p_partkey % 800) AS url, '' AS location,
        CASE WHEN p_partkey % 5 = 0 THEN 'listed £30k' WHEN p_partkey % 3 <> 0 THEN CAST(p_retailprice AS VARCHAR) WHEN p_partkey % 2 = 0 THEN 'n/a' ELSE '' END AS salary_raw,
        CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS salary_min, 0.0::DOUBLE AS salary_max, '2001-05-05' AS created
    FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 800 ORDER BY length(p_type), p_partkey) AS k FROM part WHERE p_partkey % 9 <> 0) WHERE k = 1""")
def map_frame(t):
    return H.map_frame(H.frame_items(_frame(t))).select(
        "title", "company", "url", "location", "salary_raw", "salary_min", "salary_max", "created")


@query("union_sources", sql=f"""WITH {_PAGED}
    SELECT 'adzuna' AS source, count(*) AS n, count({_sql_range()}) AS priced FROM items
    UNION ALL SELECT 'jobspy', count(DISTINCT p_partkey % 800), count(DISTINCT p_partkey % 800) FROM part WHERE p_partkey % 9 <> 0""")
def union_sources(t):
    mapped = [H.map_paged_api(H.paged_items(L.good_records(paged_landed(t)))), H.map_frame(H.frame_items(_frame(t)))]
    return L.union_sources(mapped).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("salary_raw").alias("priced"))


@query("gather_feeds", sql=f"""WITH {_NAMED},
    frames AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 800 ORDER BY length(p_type), p_partkey) AS k FROM part WHERE p_partkey % 9 <> 0) WHERE k = 1)
    SELECT p_name AS title, company, CASE WHEN p_partkey % 4 = 0 THEN 'https://apply.example/' ELSE 'https://l.example/' END || p_partkey AS url,
        'lever:' || slug AS source, 'workday' AS failed FROM named
    UNION ALL SELECT p_name, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_brand END, 'https://f.example/' || (p_partkey % 800), 'jobspy', 'workday' FROM frames""")
def gather_feeds(t):
    """Array files and a Parquet table, landed first, read as feeds beside one that is not there."""
    root = scratch_path(t.spark, "feeds")
    arrays = _postings_texts(t).groupBy(F.floor(F.col("p_partkey") / 500)).agg(F.array_join(F.collect_list("body"), ",\n").alias("items"))
    arrays.select(F.concat(F.lit("["), "items", F.lit("]"))).write.text(f"{root}/arrays")
    _frame(t).write.parquet(f"{root}/frame")
    found = gather(t.spark, [(Postings(companies(t)), f"{root}/arrays"), (Frame(), f"{root}/frame"), (Tenant(), f"{root}/absent")])
    return found.postings.select("title", "company", "url", "source", F.lit(",".join(found.failed)).alias("failed"))


@query("scan_edits", uses=("jobs",), sql="""
    SELECT job_id, status, 'note ' || l_partkey AS notes FROM jobs WHERE l_partkey % 5 <> 0""")
def scan_edits(t):
    sheet = t.inputs.jobs().select(
        F.lit("x").alias("Title"), F.concat(F.lit("\t"), F.col("status"), F.lit(" ")).alias("Status"),
        F.when(F.col("l_partkey") % 5 != 0, F.concat("job_id", F.lit(" "))).alias("Job ID"),
        F.concat(F.lit(" note "), F.col("l_partkey").cast("string"), F.lit("\n")).alias("Notes"))
    return L.scan_edits(sheet)
