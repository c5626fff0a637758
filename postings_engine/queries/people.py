"""Profiles, forms, domain packs and search phrases, one profile per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as R
from ..schema import DOMAIN_PACK, PROFILE
from .registry import query


def with_profile_defaults(rows):
    return R.default_profile(rows)


# --- forms ---------------------------------------------------------------------------------

_FORM = r"""concat('﻿', '### Domain\n\n', c_mktsegment, '\n\n### Search city\n', 'City ', c_nationkey,
    '\r\n\n###  Minimum salary GBP  \n', CASE WHEN c_custkey % 3 = 0 THEN '_No response_' ELSE concat('£', c_custkey + 20000, ' or so') END,
    '\n\n### Remote jobs\n', CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'No' WHEN 1 THEN 'yes' WHEN 2 THEN 'perhaps' ELSE '' END,
    '\n\n### Core skills\n- ', c_mktsegment, ' work\n- skill ', c_custkey % 17, '; Python, \n',
    '\n### Core target roles\n', lower(c_mktsegment), ' clerk\n', '### Title words to exclude\n', CASE WHEN c_custkey % 5 = 0 THEN 'clerk' ELSE '' END,
    '\n### Remote  jobs?\nlast one ', c_custkey, '\n#### not a heading')"""


def forms(t):
    return t.customer.select(F.col("c_custkey").cast("string").alias("profile_id"), F.expr(_FORM).alias("body"))


@query("split_sections", sql="""
    SELECT CAST(c_custkey AS VARCHAR) AS profile_id, CAST(7 AS INTEGER) AS n, c_mktsegment AS domain, concat('City ', c_nationkey) AS city,
        concat('last one ', c_custkey, chr(10), '#### not a heading') AS remote,
        concat('- ', c_mktsegment, ' work', chr(10), '- skill ', c_custkey % 17, '; Python,') AS skills FROM customer""")
def split_sections(t):
    rows = forms(t).withColumn("s", R.split_sections("body"))
    return rows.select(
        "profile_id", F.size("s").alias("n"), F.try_element_at("s", F.lit("domain")).alias("domain"),
        F.try_element_at("s", F.lit("search city")).alias("city"), F.try_element_at("s", F.lit("remote jobs")).alias("remote"),
        F.try_element_at("s", F.lit("core skills")).alias("skills"),
    )


@query("overlay_preferences", sql="""
    SELECT CAST(c_custkey AS VARCHAR) AS profile_id, lower(c_mktsegment) AS domain, concat('City ', c_nationkey) AS city,
        CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey + 20000 END AS INTEGER) AS salary_floor, true AS remote_ok,
        [c_mktsegment || ' work', 'skill ' || (c_custkey % 17), 'Python'] AS core_skills, [lower(c_mktsegment) || ' clerk'] AS roles,
        CASE WHEN c_custkey % 5 = 0 THEN ['clerk'] ELSE ['senior', 'staff', 'principal', 'lead', 'head of', 'director'] END AS title_excludes,
        CAST(60 AS INTEGER) AS search_radius_miles FROM customer""")
def overlay_preferences(t):
    return R.profiles_from_forms(forms(t)).select(
        "profile_id", "domain", F.col("location.city").alias("city"), F.col("filters.salary_floor_gbp").alias("salary_floor"),
        "remote_ok", "core_skills", F.col("target_roles.core").alias("roles"),
        F.col("negative_signals.title_excludes").alias("title_excludes"), "search_radius_miles",
    )


# --- search phrases ------------------------------------------------------------------------


def people(t):
    """One profile per customer with roles, skills, a city for some and exclusions."""
    none = F.array().cast("array<string>")
    segment = F.initcap("c_mktsegment")
    rows = t.customer.select(
        F.col("c_custkey").cast("string").alias("profile_id"),
        F.lower("c_mktsegment").alias("domain"),
        F.array(F.lower(F.element_at(F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "nowhere")]), (F.col("c_custkey") % 3 + 1).cast("int")))).alias("secondary_domains"),
        F.struct(
            F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("City "), F.col("c_nationkey").cast("string"))).otherwise("").alias("city"),
            F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")).alias("location"),
        (F.col("c_custkey") % 3 != 0).alias("remote_ok"),
        F.when(F.col("c_custkey") % 4 == 0, none).otherwise(F.array(F.lit("Excel"), segment)).alias("core_skills"),
        F.struct(
            F.array(F.concat(segment, F.lit("  Clerk"))).alias("core"), F.array(F.lit("clerk "), F.lit("Buyer")).alias("adjacent"),
            F.array(F.lit("Head Buyer")).alias("stretch")).alias("target_roles"),
        F.struct(
            F.when(F.col("c_custkey") % 5 == 0, none).otherwise(F.array(F.lit("Head"))).alias("title_excludes"),
            F.lit(3).alias("requires_years_above"), none.alias("description_excludes"),
            F.array(F.lit("excel city")).alias("company_blocklist")).alias("negative_signals"),
    )
    return R.default_profile(rows)


_PEOPLE = """people AS (SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg,
        CASE WHEN c_custkey % 2 = 0 THEN 'City ' || c_nationkey END AS city, c_custkey % 3 <> 0 AS remote,
        c_custkey % 4 <> 0 AS skilled, c_custkey % 5 <> 0 AS no_head FROM customer)"""


@query("generate_queries", sql=f"""
    WITH {_PEOPLE},
    roles AS (SELECT *, seg || '  Clerk' AS role, 1 AS tier, 0 AS n FROM people
        UNION ALL SELECT *, 'clerk ', 2, 0 FROM people UNION ALL SELECT *, 'Buyer', 2, 1 FROM people
        UNION ALL SELECT *, 'Head Buyer', 3, 0 FROM people
        UNION ALL SELECT *, 'Excel', 4, 0 FROM people WHERE skilled UNION ALL SELECT *, seg, 4, 1 FROM people WHERE skilled),
    phrases AS (
        SELECT *, role AS q, 0 AS v FROM roles WHERE tier < 4
        UNION ALL SELECT *, role || ' engineer', 0 FROM roles WHERE tier = 4
        UNION ALL SELECT *, role || ' ' || city, 1 FROM roles WHERE city IS NOT NULL
        UNION ALL SELECT roles.*, m.w || ' ' || role, m.i FROM roles, (VALUES ('junior', 2), ('graduate', 3), ('entry level', 4), ('junior/graduate', 5)) m(w, i) WHERE tier = 1
        UNION ALL SELECT *, role || ' remote', 6 FROM roles WHERE remote AND tier <> 3),
    clean AS (SELECT c_custkey, tier, n, v, no_head, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS q FROM phrases),
    kept AS (SELECT * FROM clean WHERE NOT (no_head AND contains(lower(q), 'head')) AND NOT contains(lower(q), 'excel city')),
    once AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, lower(q) ORDER BY tier, n, v) AS rn FROM kept),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY tier, n, v) AS position FROM once WHERE rn = 1)
    SELECT CAST(c_custkey AS VARCHAR) AS profile_id, CAST(position AS INTEGER) AS position, left(q, 100) AS query FROM ranked WHERE position <= 12""")
def generate_queries(t):
    return R.generate_queries(people(t), max_queries=12)


@query("parse_query_response", sql="""
    SELECT c_custkey, CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN ['clerk ' || c_custkey, 'b'] WHEN 1 THEN ['x ' || c_custkey]
        WHEN 2 THEN CAST([] AS VARCHAR[]) ELSE CAST([] AS VARCHAR[]) END AS phrases FROM customer""")
def parse_query_response(t):
    text = F.expr("""CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN concat('```json\\n["clerk ', c_custkey, '", 5, null, " ", "b", {"a": 1}]\\n```')
        WHEN 1 THEN concat('{"queries": ["x ', c_custkey, '", false]}') WHEN 2 THEN 'no json' ELSE '{"other": 1}' END""")
    return t.customer.select("c_custkey", R.parse_query_response(text).alias("phrases"))


# --- packs -----------------------------------------------------------------------------------


def packs(t):
    """One pack per market segment found in the customer table."""
    def listed(*values):
        return F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values])

    segment = F.col("name")
    rows = t.customer.select(F.lower("c_mktsegment").alias("name")).distinct()
    adapters = F.map_from_arrays(
        listed("shared", F.concat(segment, F.lit("_board"))),
        F.array(*[F.struct(F.lit(on).alias("enabled"), F.concat(F.lit("https://"), segment).alias("base_url")) for on in (True, False)]))
    made = {
        "display_name": F.initcap(segment),
        "enable_by_default": listed("all", segment),
        "disable_by_default": listed(F.concat(segment, F.lit("_off"))),
        "domain_adapters": adapters,
        "salary": F.struct(
            F.when(segment == "building", "hourly_gbp").otherwise("annual_gbp").alias("default_unit"), F.lit(True).alias("agenda_for_change_bands"),
            F.lit(1820).alias("hourly_to_annual_multiplier"), F.lit(220).alias("daily_to_annual_multiplier")),
        "senior_words": listed("senior", F.concat(F.lit("chief "), segment)),
        "closing_date_patterns": listed(r"closing date[:\s]+([^\n]+)", F.concat(segment, F.lit(r" ends[:\s]+([^\n]+)")), "interviews to be held"),
        "ranker_context": F.when(segment == "automobile", "").otherwise(F.concat(F.lit("About "), segment)),
        "cv_parser_context": F.concat(F.lit("Extract "), segment, F.lit(" ")),
        "skills_core": listed("Python", segment),
        "skills_adjacent": listed(segment, "Email"),
        "roles_core": listed(F.concat(segment, F.lit(" officer")), "Officer"),
        "roles_adjacent": listed("Officer"),
        "roles_stretch": listed("Director"),
    }
    return rows.withColumns(made).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DOMAIN_PACK.fields])


_SECOND = "['automobile', 'building', 'nowhere'][c_custkey % 3 + 1]"


@query("merge_packs", sql=f"""
    WITH segs AS (SELECT DISTINCT lower(c_mktsegment) AS seg FROM customer),
    p AS (SELECT c_custkey, lower(c_mktsegment) AS a, s.seg AS b FROM customer LEFT JOIN segs s ON s.seg = {_SECOND})
    SELECT CAST(c_custkey AS VARCHAR) AS profile_id, a AS name,
        CASE WHEN b IS NULL OR b = a THEN ['Python', a] ELSE ['Python', a, b] END AS skills_core,
        CASE WHEN b IS NULL OR b = a THEN [a, 'Email'] ELSE [a, 'Email', b] END AS skills_adjacent,
        CASE WHEN b IS NULL OR b = a THEN [a || ' officer', 'Officer'] ELSE [a || ' officer', 'Officer', b || ' officer'] END AS roles_core,
        CAST(CASE WHEN b IS NULL OR b = a THEN 2 ELSE 3 END AS INTEGER) AS adapters,
        'https://' || a AS shared_url,
        CASE WHEN b IS NULL OR b = 'automobile' THEN CASE WHEN a = 'automobile' THEN '' ELSE 'About ' || a END
            WHEN a = 'automobile' THEN '--- Additional context from secondary domain ---' || chr(10) || 'About ' || b
            ELSE 'About ' || a || chr(10) || chr(10) || '--- Additional context from secondary domain ---' || chr(10) || 'About ' || b END AS ranker_context,
        CASE WHEN b IS NULL THEN 'Extract ' || a || ' ' ELSE 'Extract ' || a || ' ' || chr(10) || chr(10)
            || '--- Additional extraction hints from secondary domain ---' || chr(10) || 'Extract ' || b END AS cv_parser_context,
        CASE WHEN a = 'building' THEN 'hourly_gbp' ELSE 'annual_gbp' END AS default_unit
    FROM p""")
def merge_packs(t):
    merged = R.merge_packs(people(t), packs(t))
    return merged.select(
        "profile_id", "name", "skills_core", "skills_adjacent", "roles_core", F.size("domain_adapters").alias("adapters"),
        F.try_element_at("domain_adapters", F.lit("shared"))["base_url"].alias("shared_url"), "ranker_context", "cv_parser_context",
        F.col("salary.default_unit").alias("default_unit"),
    )


@query("seed_profile", sql=f"""WITH {_PEOPLE}
    SELECT CAST(c_custkey AS VARCHAR) AS profile_id, CASE WHEN skilled THEN ['Excel', seg] ELSE ['Python', lower(seg)] END AS core_skills,
        [lower(seg), 'Email'] AS adjacent_skills, [seg || '  Clerk'] AS roles FROM people""")
def seed_profile(t):
    return R.seed_profile(people(t), packs(t)).select(
        "profile_id", "core_skills", "adjacent_skills", F.col("target_roles.core").alias("roles"))


@query("seniority_defaults", sql=f"""WITH {_PEOPLE}
    SELECT CAST(c_custkey AS VARCHAR) AS profile_id, CASE WHEN no_head THEN ['Head'] ELSE ['senior', 'chief ' || lower(seg)] END AS title_excludes FROM people""")
def seniority_defaults(t):
    return R.seniority_defaults(people(t), packs(t)).select("profile_id", F.col("negative_signals.title_excludes").alias("title_excludes"))


@query("default_profile", sql="""
    SELECT CAST(c_custkey AS VARCHAR) AS profile_id, 'general' AS domain, CAST(60 AS INTEGER) AS search_radius_miles,
        CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS INTEGER) ELSE 0 END AS salary_floor, CAST(30 AS INTEGER) AS max_days,
        CAST(90 AS INTEGER) AS cooldown FROM customer""")
def default_profile(t):
    filters = next(f for f in PROFILE.fields if f.name == "filters")
    given = F.struct(*[
        (F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("int")) if f.name == "salary_floor_gbp" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in filters.dataType.fields])
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("profile_id"), given.alias("filters"))
    return R.default_profile(rows).select(
        "profile_id", "domain", "search_radius_miles", F.col("filters.salary_floor_gbp").alias("salary_floor"),
        F.col("filters.max_days_since_posted").alias("max_days"), F.col("filters.rejected_company_cooldown_days").alias("cooldown"))


@query("flatten_doc", sql=f"""WITH {_PEOPLE},
    flat AS (SELECT CAST(c_custkey AS VARCHAR) AS profile_id, unnest([
        {{'key': 'domain', 'value': lower(seg)}},
        {{'key': 'secondary_domains', 'value': '["' || ['automobile', 'building', 'nowhere'][c_custkey % 3 + 1] || '"]'}},
        {{'key': 'location.city', 'value': coalesce(city, '')}}, {{'key': 'location.lat', 'value': 'null'}},
        {{'key': 'location.lon', 'value': 'null'}}, {{'key': 'search_radius_miles', 'value': '60'}},
        {{'key': 'remote_ok', 'value': CAST(remote AS VARCHAR)}},
        {{'key': 'core_skills', 'value': CASE WHEN skilled THEN '["Excel","' || seg || '"]' ELSE '[]' END}},
        {{'key': 'adjacent_skills', 'value': '[]'}},
        {{'key': 'negative_signals.title_excludes', 'value': CASE WHEN no_head THEN '["Head"]' ELSE '[]' END}},
        {{'key': 'negative_signals.requires_years_above', 'value': '3'}}, {{'key': 'negative_signals.description_excludes', 'value': '[]'}},
        {{'key': 'negative_signals.company_blocklist', 'value': '["excel city"]'}},
        {{'key': 'target_roles.core', 'value': '["' || seg || '  Clerk"]'}}, {{'key': 'target_roles.adjacent', 'value': '["clerk ","Buyer"]'}},
        {{'key': 'target_roles.stretch', 'value': '["Head Buyer"]'}}, {{'key': 'filters.salary_floor_gbp', 'value': '0'}},
        {{'key': 'filters.max_days_since_posted', 'value': '30'}}, {{'key': 'filters.exclude_companies', 'value': '[]'}},
        {{'key': 'filters.rejected_company_cooldown_days', 'value': '90'}}]) AS e FROM people)
    SELECT profile_id, e.key AS key, e.value AS value FROM flat""")
def flatten_doc(t):
    return R.flatten_doc(people(t), "profile_id")
