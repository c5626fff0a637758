"""Canonical form of a posting's address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, bind, col, strings

# Query parameters that identify a posting; all others are tracking noise.
KEPT_PARAMS = ("id", "jobId", "job_id", "vacancyId", "reference")


def _decode(text: Column) -> Column:
    """Form decoding; a malformed escape leaves the text as it is, apart from plus signs."""
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _encode(text: Column) -> Column:
    """Form encoding in the variant that keeps ``~`` and escapes ``*``."""
    out = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def kept_query(query: Column) -> Column:
    """The query string reduced to the kept parameters.

    Blank values are dropped; repeated parameters are grouped where the name first occurs.
    """
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p.contains("=")),
        lambda p: F.struct(
            _decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"),
            F.substring(p, F.locate("=", p) + 1, F.length(p)).alias("v"),
        ),
    )
    pairs = F.filter(pairs, lambda p: (p["v"] != "") & F.array_contains(strings(KEPT_PARAMS), p["k"]))

    def grouped(kept: Column) -> Column:
        names = F.array_distinct(F.transform(kept, lambda p: p["k"]))
        parts = F.transform(
            names,
            lambda n: F.transform(
                F.filter(kept, lambda p: p["k"] == n),
                lambda p: F.concat(_encode(n), F.lit("="), _encode(_decode(p["v"]))),
            ),
        )
        return F.array_join(F.flatten(parts), "&")

    return bind(pairs, grouped)


_NAMES = "(?:" + "|".join(KEPT_PARAMS) + ")"
# A parameter that is not kept, with the separator before it.
_NOT_KEPT = rf"(?:^|&)(?!{_NAMES}=[^&])[^&]*"
# One kept parameter that needs neither decoding nor escaping.
_PLAIN = rf"^{_NAMES}=[A-Za-z0-9_.~-]+$"


def canonical_url(url: ColumnLike) -> Column:
    """Fragment removed, scheme lower-cased, only identifying query parameters kept.

    Nearly all addresses are settled by one regular expression; only those with several kept
    parameters or with escapes are taken apart.
    """
    def rebuilt(x: Column) -> Column:
        def chosen(simple: Column) -> Column:
            escaped = x["query"].contains("%") | x["query"].contains("+")
            taken_apart = bind(
                kept_query(x["query"]),
                lambda kept: F.when(kept != "", F.concat(x["base"], F.lit("?"), kept)).otherwise(x["base"]),
            )
            return (
                F.when(escaped, taken_apart)
                .when(simple == "", x["base"])
                .when(simple.rlike(_PLAIN), F.concat(x["base"], F.lit("?"), simple))
                .otherwise(taken_apart)
            )

        return bind(F.ltrim(F.regexp_replace(x["query"], _NOT_KEPT, ""), F.lit("&")), chosen)

    def cut(u: Column) -> Column:
        mark = F.locate("?", u)
        parts = F.struct(
            F.substring(u, F.lit(1), mark - 1).alias("base"), F.substring(u, mark + 1, F.length(u)).alias("query")
        )
        return F.when(mark > 0, bind(parts, rebuilt)).otherwise(u)

    plain = F.substring_index(col(url), "#", 1)
    scheme = F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    lowered = F.concat(F.lower(scheme), F.substring(plain, F.length(scheme) + 1, F.length(plain)))
    return bind(F.when(plain.rlike(r"^[a-z0-9+.-]*:"), plain).otherwise(lowered), cut)
