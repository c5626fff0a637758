"""Profiles and domain packs as tables: form sections, defaults, pack merging, search phrases."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..functions.columns import bind, col, strings, strip, with_once
from ..functions.text import (
    no_response_null, normalise_heading, parse_bool, parse_int, split_list, strip_fences,
)
from ..schema import PROFILE

# A profile before anyone filled it in.
DEFAULT_PROFILE = {
    "domain": "general",
    "secondary_domains": [],
    "location": {"city": "", "lat": None, "lon": None},
    "search_radius_miles": 60,
    "remote_ok": True,
    "core_skills": [],
    "adjacent_skills": [],
    "negative_signals": {
        "title_excludes": ["senior", "staff", "principal", "lead", "head of", "director"],
        "requires_years_above": 3,
        "description_excludes": [],
        "company_blocklist": [],
    },
    "target_roles": {"core": [], "adjacent": [], "stretch": []},
    "filters": {
        "salary_floor_gbp": 0,
        "max_days_since_posted": 30,
        "exclude_companies": [],
        "rejected_company_cooldown_days": 90,
    },
}

# Form headings and the profile fields they fill.
LIST_SECTIONS = {
    "Core target roles": ("target_roles", "core"),
    "Adjacent target roles": ("target_roles", "adjacent"),
    "Stretch target roles": ("target_roles", "stretch"),
    "Core skills": ("core_skills",),
    "Adjacent skills": ("adjacent_skills",),
    "Title words to exclude": ("negative_signals", "title_excludes"),
    "Description terms to exclude": ("negative_signals", "description_excludes"),
    "Companies to exclude": ("filters", "exclude_companies"),
}

# Search phrases.
JUNIOR_MODIFIERS = ("junior", "graduate", "entry level", "junior/graduate")
DEFAULT_MAX_QUERIES = 30
MAX_QUERY_CHARS = 100
SKILLS_USED = 5

# Separators between the contexts of merged packs.
RANKER_SEPARATOR = "\n\n--- Additional context from secondary domain ---\n"
PARSER_SEPARATOR = "\n\n--- Additional extraction hints from secondary domain ---\n"


def split_sections(body) -> Column:
    """Map of normalised ``### Heading`` to the stripped text below it; a repeated heading's last
    text wins."""
    def entry(block: Column) -> Column:
        end = F.locate("\n", F.concat(block, F.lit("\n")))
        return F.struct(
            normalise_heading(F.substring(block, F.lit(1), end - 1)).alias("key"),
            strip(F.substring(block, end, F.length(block))).alias("value"),
        )

    def last_of_each(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        values = F.transform(
            keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
        )
        return F.map_from_arrays(keys, values)

    text = F.regexp_replace(col(body), "^\ufeff+", "")
    blocks = F.split(F.concat(F.lit("\n"), text), r"\n###[^\S\n]+(?=\S)")
    # What stands before the first heading belongs to no section.
    return bind(
        blocks,
        lambda b: bind(
            F.transform(F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0))), entry), last_of_each
        ),
    )


def section(sections, *names: str) -> Column:
    """First answered section among ``names``, else NULL."""
    from_headings = [normalise_heading(F.lit(n)) for n in names]
    return F.coalesce(*[no_response_null(F.try_element_at(col(sections), h)) for h in from_headings])


def _literal(value, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StructType):
        value = value or {}
        return F.struct(*[_literal(value.get(f.name), f.dataType).alias(f.name) for f in data_type.fields])
    if isinstance(data_type, T.ArrayType):
        return strings(value or [])
    return F.lit(value).cast(data_type)


def _filled(value: Column | None, default, data_type: T.DataType) -> Column:
    """The value with every missing field, at any depth, taken from the default."""
    if value is None:
        return _literal(default, data_type)
    if isinstance(data_type, T.StructType):
        default = default or {}
        return F.struct(*[
            _filled(value[f.name], default.get(f.name), f.dataType).alias(f.name) for f in data_type.fields
        ])
    return F.coalesce(value, _literal(default, data_type))


def default_profile(profiles: DataFrame, default: Mapping = DEFAULT_PROFILE) -> DataFrame:
    """Profiles with missing fields filled; columns the table lacks are added."""
    return profiles.select(*[
        F.col(f.name) if f.name == "profile_id"
        else _filled(
            F.col(f.name) if f.name in profiles.columns else None, default.get(f.name), f.dataType
        ).alias(f.name)
        for f in PROFILE.fields
    ])


def overlay_preferences(profiles: DataFrame, sections: str = "sections") -> DataFrame:
    """Answers of a submitted form over the profile's fields; unanswered ones stay as they are.

    ``profiles`` has the columns of :data:`PROFILE` and a map column of sections.
    """
    def lists(path: tuple[str, ...]) -> Column:
        name = next(n for n, p in LIST_SECTIONS.items() if p == path)
        current = F.col(".".join(path))
        answer = section(sections, name)
        return F.when(answer.isNotNull(), split_list(answer)).otherwise(current)

    remote = section(sections, "Remote jobs")
    fields = {
        "domain": F.coalesce(F.lower(section(sections, "Domain")), "domain"),
        "location": F.col("location").withField(
            "city", F.coalesce(section(sections, "Search city"), "location.city")
        ),
        "search_radius_miles": F.coalesce(
            parse_int(section(sections, "Search radius miles")).cast("int"), "search_radius_miles"
        ),
        "remote_ok": F.when(remote.isNotNull(), parse_bool(remote, "remote_ok")).otherwise(F.col("remote_ok")),
        "core_skills": lists(("core_skills",)),
        "adjacent_skills": lists(("adjacent_skills",)),
        "target_roles": F.struct(*[lists(("target_roles", t)).alias(t) for t in ("core", "adjacent", "stretch")]),
        "negative_signals": F.col("negative_signals")
        .withField("title_excludes", lists(("negative_signals", "title_excludes")))
        .withField("description_excludes", lists(("negative_signals", "description_excludes")))
        .withField("company_blocklist", F.coalesce("negative_signals.company_blocklist", strings([]))),
        "filters": F.col("filters")
        .withField(
            "salary_floor_gbp",
            F.coalesce(
                parse_int(section(sections, "Minimum salary GBP")).cast("int"), "filters.salary_floor_gbp"
            ),
        )
        .withField("exclude_companies", lists(("filters", "exclude_companies"))),
    }
    return profiles.withColumns(fields)


def profiles_from_forms(forms: DataFrame) -> DataFrame:
    """Profiles for ``forms(profile_id, body)``: defaults overlaid with the answers."""
    base = default_profile(forms.select("profile_id"))
    answers = forms.select("profile_id", split_sections("body").alias("sections"))
    return overlay_preferences(base.join(answers, "profile_id")).drop("sections")


# --- domain packs -------------------------------------------------------------------------


def list_union(first, second) -> Column:
    """Items of both lists, the first one's order, each once."""
    def filled(x):
        return F.coalesce(col(x) if isinstance(x, str) else x, strings([]))

    return F.array_distinct(F.concat(filled(first), filled(second)))


def map_union(first, second) -> Column:
    """Entries of both maps; on a shared key the first map wins."""
    extra = F.map_filter(col(second), lambda k, _: ~F.map_contains_key(col(first), k))
    return F.map_concat(extra, col(first))


def joined_context(first, second, separator: str) -> Column:
    first, second = F.coalesce(col(first), F.lit("")), F.coalesce(col(second), F.lit(""))
    return F.when(second != "", strip(F.concat(first, F.lit(separator), second))).otherwise(first)


_PACK_LISTS = (
    "enable_by_default", "disable_by_default", "closing_date_patterns", "skills_core",
    "skills_adjacent", "roles_core", "roles_adjacent", "roles_stretch",
)


def _merge_pair(primary: Column, other: Column, fields: list[T.StructField]) -> Column:
    def merged(name: str) -> Column:
        if name in _PACK_LISTS:
            return list_union(primary[name], other[name])
        if name == "domain_adapters":
            return map_union(primary[name], other[name])
        if name == "ranker_context":
            return joined_context(primary[name], other[name], RANKER_SEPARATOR)
        if name == "cv_parser_context":
            return joined_context(primary[name], other[name], PARSER_SEPARATOR)
        return primary[name]

    return F.struct(*[merged(f.name).cast(f.dataType).alias(f.name) for f in fields])


def merge_packs(profiles: DataFrame, packs: DataFrame) -> DataFrame:
    """The effective pack of each profile: its own, extended by its secondary ones in order.

    ``profiles(profile_id, domain, secondary_domains)``; unknown secondary names are skipped,
    unknown primary ones leave the profile without a row.
    """
    pack_fields = packs.schema.fields
    pack = F.struct(*[f.name for f in pack_fields])
    wanted = profiles.select(
        "profile_id", F.posexplode(F.concat(F.array("domain"), F.coalesce("secondary_domains", strings([])))).alias("pos", "name")
    )
    found = wanted.join(packs.select(F.col("name"), pack.alias("pack")), "name")
    # One entry per domain a single person listed: a short list by nature.  Maps inside a pack
    # cannot be compared, so only the positions are sorted.
    listed = found.groupBy("profile_id").agg(F.collect_list(F.struct("pos", "pack")).alias("all"))
    ordered = F.transform(
        F.array_sort(F.transform("all", lambda x: x["pos"])),
        lambda p: F.element_at(F.filter("all", lambda x: x["pos"] == p), 1),
    )
    with_primary = listed.withColumn("all", ordered).filter(F.get("all", F.lit(0))["pos"] == 0)
    merged = F.aggregate(
        F.slice("all", 2, F.size("all")),
        F.get("all", F.lit(0))["pack"],
        lambda acc, x: _merge_pair(acc, x["pack"], pack_fields),
    )
    return with_primary.select("profile_id", merged.alias("pack")).select("profile_id", "pack.*")


def seed_profile(profiles: DataFrame, packs: DataFrame) -> DataFrame:
    """Empty skills and core roles are filled from the profile's domain pack."""
    seeds = packs.select(
        F.col("name").alias("domain"),
        F.col("skills_core").alias("_core"),
        F.col("skills_adjacent").alias("_adjacent"),
        F.col("roles_core").alias("_roles"),
    )

    def seeded(current: Column, seed: str) -> Column:
        empty = F.size(F.coalesce(current, strings([]))) == 0
        return F.when(empty, F.coalesce(F.col(seed), strings([]))).otherwise(current)

    return profiles.join(seeds, "domain", "left").withColumns({
        "core_skills": seeded(F.col("core_skills"), "_core"),
        "adjacent_skills": seeded(F.col("adjacent_skills"), "_adjacent"),
        "target_roles": F.col("target_roles").withField("core", seeded(F.col("target_roles.core"), "_roles")),
    }).select(*profiles.columns)


def seniority_defaults(profiles: DataFrame, packs: DataFrame) -> DataFrame:
    """Profiles without title exclusions take their pack's senior words."""
    words = packs.select(F.col("name").alias("domain"), F.col("senior_words").alias("_words"))
    current = F.col("negative_signals.title_excludes")
    empty = F.size(F.coalesce(current, strings([]))) == 0
    chosen = F.when(empty, F.coalesce("_words", strings([]))).otherwise(current)
    return profiles.join(words, "domain", "left").withColumn(
        "negative_signals", F.col("negative_signals").withField("title_excludes", chosen)
    ).select(*profiles.columns)


# --- search phrases -----------------------------------------------------------------------


def parse_query_response(text) -> Column:
    """Phrases of a response: a JSON array, or an object with ``queries``; strings only."""
    body = strip_fences(col(text))
    listed = F.when(body.startswith("{"), F.get_json_object(body, "$.queries")).otherwise(body)
    items = F.from_json(F.when(listed.startswith("["), listed), "array<variant>")
    phrases = F.transform(
        F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: F.variant_get(v, "$", "string"),
    )
    return F.filter(F.coalesce(phrases, strings([])), lambda p: strip(p) != "")


def query_variants(profiles: DataFrame) -> DataFrame:
    """``(profile_id, ordinal, phrase)``: every phrase a profile asks for, before cleaning.

    Core roles come bare, with the city, with junior modifiers and as remote; adjacent roles
    without the modifiers; stretch roles bare and with the city; then the first skills.
    """
    city = F.nullif(F.col("location.city"), F.lit(""))
    remote = F.coalesce("remote_ok", F.lit(True))

    def with_city(x: Column) -> Column:
        return F.concat(x, F.lit(" "), city)

    def with_remote(x: Column) -> Column:
        return F.when(remote, F.concat(x, F.lit(" remote")))

    def variants(items: Column, shapes) -> Column:
        listed = F.transform(F.coalesce(items, strings([])), lambda x: F.array(*shapes(x)))
        return F.flatten(listed)

    def junior(x: Column) -> list[Column]:
        return [F.concat(F.lit(m + " "), x) for m in JUNIOR_MODIFIERS]

    phrases = F.concat(
        variants(F.col("target_roles.core"), lambda x: [x, with_city(x), *junior(x), with_remote(x)]),
        variants(F.col("target_roles.adjacent"), lambda x: [x, with_city(x), with_remote(x)]),
        variants(F.col("target_roles.stretch"), lambda x: [x, with_city(x)]),
        variants(
            F.slice(F.coalesce("core_skills", strings([])), 1, SKILLS_USED),
            lambda x: [F.concat(x, F.lit(" engineer")), with_city(x), with_remote(x)],
        ),
    )
    if "supplied_queries" in profiles.columns:
        phrases = F.concat(F.coalesce("supplied_queries", strings([])), phrases)
    return profiles.select(
        "profile_id",
        F.transform(
            F.concat(
                F.coalesce("negative_signals.title_excludes", strings([])),
                F.coalesce("negative_signals.company_blocklist", strings([])),
                F.coalesce("filters.exclude_companies", strings([])),
            ),
            lambda e: F.lower(e),
        ).alias("excluded"),
        F.posexplode(phrases).alias("ordinal", "phrase"),
    )


def normalise_queries(variants: DataFrame, max_queries: int = DEFAULT_MAX_QUERIES) -> DataFrame:
    """Clean phrases of each profile in order: blanks collapsed, excluded words out, each once
    regardless of case, at most ``max_queries``."""
    cleaned = strip(F.regexp_replace("phrase", r"(?U)\s+", " "))
    both = bind(cleaned, lambda c: F.struct(c.alias("phrase"), F.lower(c).alias("lower")))
    df = with_once(variants.filter(F.col("phrase").isNotNull()), "q", both).select(
        "profile_id", "excluded", "ordinal", "q.phrase", F.col("q.lower").alias("_lower")
    )
    df = df.filter(F.col("phrase") != "").filter(
        ~F.exists("excluded", lambda e: (e != "") & F.contains("_lower", e))
    )
    # Dealt by profile before phrases are compared: no scan task sorts all its phrases, however large its file.
    once = df.select("profile_id", "ordinal", "phrase", "_lower").repartition("profile_id").groupBy("profile_id", "_lower").agg(
        F.min(F.struct("ordinal", "phrase")).alias("first")
    ).select("profile_id", "first.*")
    rank = F.row_number().over(Window.partitionBy("profile_id").orderBy("ordinal"))
    return once.withColumn("position", rank).filter(F.col("position") <= max_queries).select(
        "profile_id", "position", F.substring("phrase", 1, MAX_QUERY_CHARS).alias("query")
    )


def generate_queries(profiles: DataFrame, max_queries: int = DEFAULT_MAX_QUERIES) -> DataFrame:
    """Search phrases per profile; a ``supplied_queries`` column, when present, goes first."""
    return normalise_queries(query_variants(profiles), max_queries)


# --- flat view ----------------------------------------------------------------------------


def _leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    out = []
    for field in schema.fields:
        name = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += _leaves(field.dataType, name + ".")
        else:
            out.append(name)
    return out


def flatten_doc(df: DataFrame, id_column: str) -> DataFrame:
    """``(id, key, value)`` with dotted keys; text stays as it is, everything else becomes JSON."""
    leaves = [name for name in _leaves(df.schema) if name != id_column]

    def shown(name: str) -> Column:
        data_type = df.select(name).schema.fields[0].dataType
        if isinstance(data_type, T.StringType):
            return F.coalesce(F.col(name), F.lit("null"))
        if isinstance(data_type, (T.ArrayType, T.MapType)):
            return F.coalesce(F.to_json(name), F.lit("null"))
        return F.coalesce(F.col(name).cast("string"), F.lit(json.dumps(None)))

    pairs = F.array(*[F.struct(F.lit(n).alias("key"), shown(n).alias("value")) for n in leaves])
    return df.select(id_column, F.explode(pairs).alias("e")).select(id_column, "e.*")
