"""Column functions: the pinned cases and the corner cases of every parser."""

from __future__ import annotations

import datetime as dt
import hashlib
import html
import math
import re
import urllib.parse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postings_engine.functions import classify as C
from postings_engine.functions import dates as D
from postings_engine.functions import geo as G
from postings_engine.functions import money as M
from postings_engine.functions import text as X
from postings_engine.functions.urls import KEPT_PARAMS, canonical_url
from postings_engine.operators.filters import f_title_exclude
from postings_engine.operators.stemmer import porter_stem

DAY = dt.date(2025, 6, 15)


def column(spark, values, expression):
    """``expression`` over a column ``x`` of texts, in the given order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, x string").select("i", expression.alias("v"))
    return [r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])]


SALARIES = {
    "£35k": (35000, 35000),
    "£35,000 - £40,000": (35000, 40000),
    "Competitive": (None, None),
    "DOE": (None, None),
    "£18/hr": (33840, 33840),
    "£18 per hour": (33840, 33840),
    "Band 5": (29970, 36483),
    "band 6": (37338, 44962),
    "Band 8c": (74290, 85601),
    "Band 9": (62215, 72293),
    "Band 6 (£35,392 - £42,618)": (35392, 42618),
    "£35-40k": (65800, 65800),
    "£, please": (None, None),
    "30000 - 40000": (30000, 40000), "30000\n- 40000": (30000, 40000),
    "30k to 40k": (30000, 40000),
    "£450 per day": (103500, 103500),
    "£80 per session": (32000, 32000),
    "£600 hourly": (600, 600),
    "£35.5k": (35500, 35500),
    "  £20 000": (37600, 37600),
    "": (None, None),
    None: (None, None),
}


def test_parse_salary(spark):
    got = column(spark, list(SALARIES), M.parse_salary("x"))
    assert {k: (g["min"], g["max"]) for k, g in zip(SALARIES, got)} == SALARIES


def test_salary_uses_pack_rules(spark):
    got = column(spark, ["£15", "£20000", "Band 5"], M.parse_salary("x", F.lit("hourly_gbp"), 1820, 230, F.lit(False)))
    assert [(g["min"], g["max"]) for g in got] == [(27300, 27300), (20000, 20000), (None, None)]


DATES = {
    "31 December 2025": dt.date(2025, 12, 31),
    "31 Dec 2025.": dt.date(2025, 12, 31),
    "1st  MAY 2024": dt.date(2024, 5, 1),
    "31/12/2025": dt.date(2025, 12, 31),
    "3-1-2026": dt.date(2026, 1, 3),
    "2025-12-31": dt.date(2025, 12, 31),
    "14 June": dt.date(2026, 6, 14),
    "15 Jun": dt.date(2025, 6, 15),
    "31/12/25": dt.date(2025, 12, 31),
    "31/12/75": dt.date(1975, 12, 31),
    "29 February": None,
    "29 February 2024": dt.date(2024, 2, 29),
    "30 February 2024": None,
    "4 Sept 2025": None,
    "32/01/2025": None,
    "May 2025": None,
    "31 December 2025 at noon": None,
    "01/02/1900": dt.date(2026, 2, 1),
}


def test_try_parse_date(spark):
    got = column(spark, list(DATES), D.try_parse_date("x", F.lit(DAY)))
    assert dict(zip(DATES, got)) == DATES


def test_closing_date_pattern_order(spark):
    texts = {
        "Apply by 1 May 2026\nClosing date: 2 May 2026": dt.date(2026, 5, 2),
        "Closing date: soon. Closing date: 3 May 2026": None,
        "Closing date: soon\nclosing date - 4 May 2026\nDEADLINE:\n\n 5 May 2026.": dt.date(2026, 5, 5),
        "applications close 6th May 2026\r\nthanks": dt.date(2026, 5, 6),
        "application closes: 7/5/2026": dt.date(2026, 5, 7),
        "no date here": None,
        "": None,
    }
    got = column(spark, list(texts), D.extract_closing_date("x", F.lit(DAY)))
    assert dict(zip(texts, got)) == texts


def test_closing_date_extra_patterns(spark):
    extra = [r"Interviews to be held", r"shortlisting date[:\s]+([^\n]+)"]
    assert D.usable_patterns(extra) == extra[1:]
    expression = D.extract_closing_date("x", F.lit(DAY), extra)
    assert column(spark, ["Shortlisting date: 8 May 2026"], expression) == [dt.date(2026, 5, 8)]
    packs = D.extract_closing_date_with_packs("x", F.lit(DAY), F.array(*[F.lit(p) for p in extra]))
    assert column(spark, ["Shortlisting date: 8 May 2026", "expires 9 May 2026\nShortlisting date: 8 May 2026"], packs) == [
        dt.date(2026, 5, 8), dt.date(2026, 5, 9)]


def test_posted_date(spark):
    texts = ["2025-01-02T03:04:05Z", "02/01/2025", "1735689600000", "", "2025-13-01", None]
    assert column(spark, texts, D.parse_posted_date("x")) == [dt.date(2025, 1, 2), None, None, None, None, None]
    assert column(spark, texts, D.parse_posted_date("x", extended=True))[:3] == [
        dt.date(2025, 1, 2), dt.date(2025, 1, 2), dt.date(2025, 1, 1)]


def test_stale_counts_fractional_days(spark):
    expression = D.is_stale(F.col("x").cast("date"), F.lit("2025-06-15 06:00:00").cast("timestamp"), 14)
    assert column(spark, ["2025-06-01", "2025-06-02"], expression) == [True, False]


def python_canonical(url: str) -> str:
    parsed = urllib.parse.urlparse(url)
    kept = {k: v for k, v in urllib.parse.parse_qs(parsed.query).items() if k in KEPT_PARAMS}
    return urllib.parse.urlunparse(parsed._replace(query=urllib.parse.urlencode(kept, doseq=True), fragment=""))


URLS = [
    "https://a.example/x?utm=1&jobId=3&id=7#top", "HTTPS://A.example/X", "https://a.example/x?id=1&jobId=2&id=3",
    "https://a.example/x?id=a%20b+c&ref=1", "https://a.example/x?id=&jobId=0", "https://a.example/x?job%49d=5&id=%2A~*",
    "https://a.example/x?reference=a=b", "a.example/x?id=1", "https://a.example/x?", "https://a.example/é?vacancyId=é",
    "https://a.example/x&id=2?ref=a&xid=4&id=4", "https://a.example/x?id", "https://a.example/?q=?&id=1",
]


def test_canonical_url_agrees_with_the_standard_library(spark):
    assert column(spark, URLS, canonical_url("x")) == [python_canonical(u) for u in URLS]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(
    st.sampled_from([*KEPT_PARAMS, "utm", "xid"]), st.text("ab1 +%&=~*é", max_size=4)), max_size=5), min_size=20, max_size=30))
def test_canonical_url_properties(spark, queries):
    urls = ["https://a.example/p?" + urllib.parse.urlencode(q) + "#f" for q in queries]
    once = column(spark, urls, canonical_url("x"))
    assert once == [python_canonical(u) for u in urls]
    assert column(spark, once, canonical_url("x")) == once


def test_strip_html(spark):
    pages = {
        "<p>a<b>c</b></p>": "a c",
        "x<script>if (a<b) '</p>'</script>y": "x y",
        "<style>p{}</style><!-- <p> -->z<br/>w": "z w",
        '<a title="a > b">t</a>': "t",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "&amp;lt; &lt; &#163;5 &#x20AC;6 &mdash; &nope; &#38;gt;": "&lt; < £5 €6 — &nope; &gt;",
        "<!DOCTYPE html><html>h</html>": "h",
    }
    got = column(spark, list(pages), X.normalise_ws(X.strip_html("x")))
    assert dict(zip(pages, got)) == pages


def test_entities_agree_with_the_standard_library(spark):
    texts = ["&eacute;&Eacute;&pound;&nbsp;&quot;&apos;", "&#8364;&#x1F600;", "a &amp; b &amp;amp; c", "&amp", "&#0;"]
    got = column(spark, texts, X.decode_entities("x"))
    assert got[:3] == [html.unescape(t) for t in texts[:3]]
    assert got[3:] == texts[3:]


def python_clean(text: str) -> str:
    for pattern in X.BOILERPLATE_PATTERNS:
        text = re.sub(pattern, " ", text, flags=re.I | re.S)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[^\S\n]+", " ", text)).strip()
    return text if len(text) <= 60 else text[:36] + X.TRUNCATION_MARK + text[-24:]


def test_cleaning_agrees_with_plain_python(spark):
    texts = [
        "  We  are an equal opportunity employer. Keep this.\t\n\n\n\nEnd  ",
        "WE CELEBRATE DIVERSITY in all ways. Next. Reasonable adjustments made. x",
        "What we offer: cake. Our benefits include tea. Founded in 1999 by us. Established in 20 a.",
        "How to apply: write. Please send it. Include your cover letter. Attach CV. Please do. " + "word " * 30,
        "none", "", "a \n b", "disability" + "x" * 250 + ".", "To apply" + "\n" * 5 + "now.",
    ]
    expression = X.middle_truncate(X.normalise_ws(X.remove_boilerplate("x")), 60)
    assert column(spark, texts, expression) == [python_clean(t) for t in texts]


def test_hash_and_key(spark):
    assert column(spark, ["  Ab\n"], X.jd_hash("x")) == [hashlib.sha1(b"ab").hexdigest()]
    key = X.make_job_id(F.lit("ACME"), F.upper("x"), F.lit("u"))
    assert column(spark, ["clerk"], key) == [hashlib.sha1(b"acmeclerku").hexdigest()]
    other = column(spark, ["clerk"], X.make_job_id(F.lit("acme"), F.lit("Clerk"), F.lit("U")))
    assert other != [hashlib.sha1(b"acmeclerku").hexdigest()]


def test_small_parsers(spark):
    assert column(spark, ["- a\n* b,, c ;\t"], X.split_list("x")) == [["a", "b", "c"]]
    assert column(spark, [" Yes", "N", "", "maybe"], X.parse_bool("x", F.lit(True))) == [True, False, True, True]
    assert column(spark, ["£30,000 now", "none"], X.parse_int("x")) == [30, None]
    assert column(spark, [" _No response_ ", "x"], X.no_response_null("x")) == [None, "x"]
    assert column(spark, ["```json\n[1]\n```", "``` [2] ```", "[3]"], X.strip_fences("x")) == ["[1]", "[2]", "[3]"]
    assert column(spark, ['["a", "b"]', "plain", None], X.format_keywords("x")) == ["a, b", "plain", ""]


def test_haversine(spark):
    def python_miles(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 3958.8 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    points = [(51.5, -0.1, 53.5, -2.2), (0.0, 0.0, 0.0, 0.0), (50.0, 5.0, -50.0, -175.0)]
    df = spark.createDataFrame(points, "a double, b double, c double, d double")
    for row in df.select("*", G.haversine_miles("a", "b", "c", "d").alias("m")).collect():
        assert row["m"] == pytest.approx(python_miles(row["a"], row["b"], row["c"], row["d"]), abs=1e-6)


def test_places(spark):
    assert column(spark, ["Fully Remote", "WFH", "Leeds", None], G.is_remote("x")) == [True, True, False, False]
    assert column(spark, ["UK-wide", "Leeds", ""], G.non_geocodable("x")) == [None, "Leeds", None]
    assert column(spark, [" St. John's, York "], G.location_key("x")) == ["St_ John_s_ York"]


TITLES_KEPT = ["Leading Engineer", "Electrical Engineer", "Misleading", "Staffing Clerk", "Principality Guide"]
TITLES_DROPPED = ["Lead Engineer", "Team LEAD", "Head of Ops", "Senior/Lead", "(lead) clerk", "C++ wizard"]


def test_title_exclude_matches_whole_words(spark):
    rule = f_title_exclude(["lead", " head of ", "staff", "principal", "C++ wizard", ""], "x")
    assert column(spark, TITLES_KEPT + TITLES_DROPPED, rule) == [True] * len(TITLES_KEPT) + [False] * len(TITLES_DROPPED)


def test_experience_level(spark):
    cases = {
        "Project Manager|": "Manager/Owner", "Software Engineer|3+ years": "Mid-level", "Senior Manager|": "Senior/Lead",
        "Entry-level clerk|": "Graduate/Entry", "Clerk|an experienced person": "Mid-level", "Clerk|12 yrs": "Senior/Lead",
        "Clerk|123 years": "Unspecified", "Clerk|0 years": "Graduate/Entry", "Clerk|1 year": "Junior", "Clerk|": "Unspecified",
        "Clerk|new associate wanted, 9 years": "Junior", "Clerk|leader": "Unspecified",
    }
    parts = F.split("x", r"\|")
    got = column(spark, list(cases), C.experience_level(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    assert dict(zip(cases, got)) == cases


def test_priority(spark):
    rows = [("new", 8.5, "2025-06-20"), ("new", 8.5, "2025-12-20"), ("new", 8.5, None), (None, 5.0, None), ("", 2.0, None),
            ("new", None, None), ("OFFER", 1.0, None), ("odd", 7.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, f double, c string")
    label = C.priority_label("s", "f", F.col("c").cast("date"), F.lit(DAY))
    got = [r["v"] for r in df.select("i", label.alias("v")).orderBy("i").collect()]
    assert got == ["P1 Apply", "P2 Strong", "P1 Apply", "P3 Maybe", "P4 Low", "Unscored", "Offer", "P2 Strong"]


# Published examples of the stemming algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit",
    "operator": "oper", "hopefulness": "hope", "triplicate": "triplic", "formative": "form", "electriciti": "electr",
    "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate",
    "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "nurses": "nurs", "nursing": "nurs",
}


def test_porter_stem():
    assert {w: porter_stem(w) for w in STEMS} == STEMS
