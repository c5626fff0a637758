"""Text cleaning, hashing and small text parsers, all as native column expressions."""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ColumnLike, bind, col, strip

# Sentences treated as boilerplate, applied in this order.
BOILERPLATE_PATTERNS = (
    r"equal\s+opportunit(?:y|ies)[^.]{0,300}\.",
    r"we\s+(?:are|value|celebrate)\s+(?:an\s+)?divers(?:ity|e)[^.]{0,300}\.",
    r"(?:disability|reasonable\s+adjustment)[^.]{0,200}\.",
    r"(?:we\s+offer|our\s+benefits\s+include|what\s+we\s+offer)[^.]{0,500}\.",
    r"(?:founded\s+in\s+\d{4}|established\s+in\s+\d{4})[^.]{0,300}\.",
    r"(?:to\s+apply|how\s+to\s+apply|please\s+(?:send|email|submit))[^.]{0,300}\.",
    r"(?:attach|include)\s+(?:your\s+)?(?:cv|resume|cover\s+letter)[^.]{0,200}\.",
)

# Size of the cleaned text.
CHARS_PER_TOKEN = 4
DEFAULT_MAX_TOKENS = 1500
TRUNCATION_MARK = "\n[... truncated ...]\n"
PAYLOAD_CHARS = 3000

# Words one of which every match of the pattern at the same position contains.
_BOILERPLATE_WORDS = (
    ("opportunit",), ("divers",), ("disability", "adjustment"), ("offer", "benefits"),
    ("founded", "established"), ("apply", "please"), ("attach", "include"),
)

# Comments, script-like blocks, tags (quoted attribute values may hold ">") and declarations.
_MARKUP = (
    r"(?is)<(?:!--.*?-->"
    r"|(script|style|template)\b[^>]*>.*?</\1\s*>"
    r"""|/?[a-z][^'">]*+(?:"[^"]*"[^'">]*+|'[^']*'[^'">]*+)*+>"""
    r"|[!?][^>]*>)"
)
_BLANK = r"[\t\x0B\f\r\x1c-\x1f\x85\p{Z}]"
_NAMED_ENTITY = r"&[A-Za-z][A-Za-z0-9]*;"
_DECIMAL_ENTITY = r"&#[0-9]{1,7};"
_HEX_ENTITY = r"&#[xX][0-9A-Fa-f]{1,6};"


def _character(code_point: Column) -> Column:
    """The character of a code point; NULL for surrogates and numbers beyond Unicode."""
    valid = code_point.between(1, 0x10FFFF) & ~code_point.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code_point), 8, "0")), "UTF-32"))


def _replace_found(text: Column, pattern: str, meaning) -> Column:
    """Replace every distinct match of ``pattern`` by its meaning, leaving unknown ones alone.

    The ampersand is decoded by the caller afterwards, so that ``&amp;lt;`` becomes ``&lt;``
    and is not decoded twice.
    """
    def replaced(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        return F.aggregate(found, t, lambda acc, e: F.replace(acc, e, F.coalesce(meaning(e), e)))

    return bind(text, replaced)


def decode_entities(text: ColumnLike) -> Column:
    """HTML character references to characters: named, decimal and hexadecimal."""
    names = F.create_map(
        *[F.lit(x) for name, cp in name2codepoint.items() if name != "amp"
          for x in (f"&{name};", chr(cp))],
        F.lit("&apos;"), F.lit("'"),
    )

    def code_point(digits: Column, base: int) -> Column:
        return F.nullif(_character(F.conv(digits, base, 10).cast("int")), F.lit("&"))

    def numbers(t: Column) -> Column:
        out = _replace_found(
            t, _DECIMAL_ENTITY, lambda e: code_point(F.regexp_extract(e, "([0-9]+)", 1), 10)
        )
        out = _replace_found(
            out, _HEX_ENTITY, lambda e: code_point(F.regexp_extract(e, "[xX]([0-9A-Fa-f]+)", 1), 16)
        )
        return F.regexp_replace(out, "&#0*38;|&#[xX]0*26;", "&amp;")

    def decoded(t: Column) -> Column:
        out = _replace_found(t, _NAMED_ENTITY, lambda e: F.try_element_at(names, e))
        out = bind(out, lambda x: F.when(x.contains("&#"), numbers(x)).otherwise(x))
        return F.when(t.contains("&"), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(t)

    return bind(col(text), decoded)


def strip_html(html: ColumnLike) -> Column:
    """Visible text: comments, scripts and styles dropped, each tag becomes a space."""
    html = col(html)
    text = F.when(html.contains("<"), F.regexp_replace(html, _MARKUP, " ")).otherwise(html)
    return decode_entities(text)


def remove_boilerplate(text: ColumnLike) -> Column:
    """Boilerplate sentences replaced by a space, pattern by pattern.

    A plain word search decides first whether a pattern can match at all: removing text never
    makes such a word appear.
    """
    def step(pattern: str, words: tuple[str, ...]):
        def run(x: Column) -> Column:
            possible = reduce(or_, [x["lower"].contains(w) for w in words])
            replaced = F.regexp_replace(x["text"], "(?isU)" + pattern, " ")
            return F.struct(F.when(possible, replaced).otherwise(x["text"]).alias("text"), x["lower"].alias("lower"))

        return run

    text = col(text)
    out = F.struct(text.alias("text"), F.lower(text).alias("lower"))
    for pattern, words in zip(BOILERPLATE_PATTERNS, _BOILERPLATE_WORDS):
        out = bind(out, step(pattern, words))
    return out["text"]


def normalise_ws(text: ColumnLike) -> Column:
    """Runs of blanks to one space, at most one empty line in a row, ends stripped."""
    # Single plain spaces, the bulk of all blanks, are left alone.
    out = F.regexp_replace(col(text), rf"(?! ){_BLANK}{_BLANK}*+| {_BLANK}++", " ")
    return strip(
        bind(out, lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t))
    )


def middle_truncate(text: ColumnLike, max_chars: int) -> Column:
    """Keep the first 60 % and the last 40 % of the allowed characters."""
    head = int(max_chars * 0.60)
    tail = max_chars - head

    def cut(t: Column) -> Column:
        ends = F.concat(F.substring(t, 1, head), F.lit(TRUNCATION_MARK), F.substring(t, -tail, tail))
        return F.when(F.length(t) > max_chars, ends).otherwise(t)

    return bind(col(text), cut)


def clean_text(raw: ColumnLike, max_tokens: int = DEFAULT_MAX_TOKENS) -> Column:
    text = normalise_ws(remove_boilerplate(strip_html(F.coalesce(col(raw), F.lit("")))))
    return middle_truncate(text, max_tokens * CHARS_PER_TOKEN)


def jd_hash(text: ColumnLike) -> Column:
    """Change-detection hash of a cleaned text, ignoring case and outer whitespace."""
    return F.sha1(F.lower(strip(text)))


def make_job_id(company: ColumnLike, title: ColumnLike, url: ColumnLike) -> Column:
    """Identity of a posting; ``url`` must already be canonical."""
    return F.sha1(F.concat(F.lower(col(company)), F.lower(col(title)), col(url)))


def truncate_payload(text: ColumnLike, chars: int = PAYLOAD_CHARS) -> Column:
    return F.substring(F.coalesce(col(text), F.lit("")), 1, chars)


def strip_fences(text: ColumnLike) -> Column:
    """Content of a leading Markdown code fence, or the text itself when there is none."""
    text = strip(text)
    inner = strip(F.element_at(F.split(text, "```"), 2))
    inner = strip(F.regexp_replace(inner, r"^json", ""))
    return F.when(text.startswith("```"), inner).otherwise(text)


def normalise_heading(text: ColumnLike) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", " "))


def split_list(text: ColumnLike) -> Column:
    """Items separated by newline, comma or semicolon, with bullets and blanks trimmed."""
    items = F.transform(F.split(col(text), r"[\n,;]+"), lambda x: F.btrim(x, F.lit(" -*\t\r")))
    return F.filter(items, lambda x: x != "")


def parse_bool(text: ColumnLike, default: ColumnLike) -> Column:
    word = F.lower(strip(text))
    return (
        F.when(word.isin("yes", "true", "y", "1"), F.lit(True))
        .when(word.isin("no", "false", "n", "0"), F.lit(False))
        .otherwise(col(default))
    )


def parse_int(text: ColumnLike) -> Column:
    """The first run of digits, or NULL."""
    return F.nullif(F.regexp_extract(col(text), r"([0-9]+)", 1), F.lit("")).try_cast("bigint")


def no_response_null(text: ColumnLike) -> Column:
    """NULL for an empty answer or a form's "no response" filler."""
    text = strip(text)
    return F.when(~text.isin("", "_No response_", "No response"), text)


def keywords_to_json(words: ColumnLike) -> Column:
    return F.to_json(F.coalesce(col(words), F.array().cast("array<string>")))


def format_keywords(text: ColumnLike) -> Column:
    """JSON array text to ``a, b``; anything else passes through; NULL becomes empty."""
    text = F.coalesce(col(text), F.lit(""))
    parsed = F.from_json(text, "array<string>")
    is_array = text.rlike(r"^\s*\[") & parsed.isNotNull()
    return F.when(is_array, F.array_join(parsed, ", ")).otherwise(text)
