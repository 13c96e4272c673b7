"""Column functions against the values that plain Python gives."""

import datetime as dt
import hashlib
import html.entities
import random
import re

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text as X

REF = dt.date(2026, 8, 19)


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_py_round_is_exact(spark, d):
    rng = random.Random(d)
    values = [k / 40 for k in range(4000)] + [rng.uniform(-100, 100) for _ in range(2000)] + [46.15, 55.85, 0.0, 2.675, -0.5, -2.5]
    assert column(spark, values, lambda c: X.py_round(c, d), "double") == [round(v, d) for v in values]


def test_normalize_key(spark):
    cases = {"C++": "c-plus-plus", "C#": "c-sharp", ".NET": "dot-net", "C": "c", "CI/CD": "ci-cd", "B2B  outreach": "b2b-outreach", "  Node.js ": "node-js", "": ""}
    assert column(spark, list(cases), X.normalize_key) == list(cases.values())


def test_strip_html(spark):
    cases = {"<b>a</b>&nbsp; <br/>b\t\tc": "a b c", "x &lt;y&gt; &amp;amp;": "x <y> &amp;", " x ": "x", "a\nb": "a\nb"}
    got = column(spark, list(cases), X.strip_html)
    assert got[2:] == ["x", "a\nb"] and got[1] == "x <y> &amp;"
    assert column(spark, ["&frac12; &hearts;"], X.strip_html) == ["½ ♥"]


def test_strip_html_decodes_every_entity(spark):
    cases = [f"a &{name} b" for name in html.entities.html5] + [f"<i>x</i>&#{n};y&#x{n:x};" for n in (0, 9, 13, 38, 60, 128, 150, 160, 169, 183, 8364, 0xD800, 0x1F600, 0x110000)]
    cases += ["&copy; 2024 &middot; A&B &notit; &amp;copy; &copy &#169 &unknown; &", None]

    def plain(t):
        return t and re.sub("[ \t]+", " ", html.unescape(re.sub("<[^>]+>", " ", t))).strip()

    assert column(spark, cases, X.strip_html) == [plain(t) for t in cases]


def test_strip_html_query_on_pages(spark):
    from matchloom.plans import registry

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    want = {i: hashlib.md5(re.sub("[ \t]+", " ", html.unescape(re.sub("<[^>]+>", " ", t))).strip().encode()).hexdigest() for i, t in pages.items()}
    assert {r["page_id"]: r["text_md5"] for r in registry.queries()["ingest_strip_html"](spark, sf).collect()} == want


def test_past_roles_with_entities(spark):
    raw = "<p>Caf&eacute;&nbsp;Chef,&nbsp;A&ccedil;a&iacute; &hearts;&nbsp;(K&ouml;ln)&nbsp;&#8212;&nbsp;2022&ndash;Present:&nbsp;cooks</p>"
    (a,) = column(spark, [raw], lambda c: X.past_roles(c, F.lit(REF)))[0]
    assert (a["title"], a["company"], a["city"], a["start_year"]) == ("Café\xa0Chef", "Açaí ♥", "Köln", 2022)


def test_notice_days(spark):
    cases = {"2 weeks notice": 14, "1 month": 30, "2 months": 60, "Negotiable": 0, "": None, "starts in 2027": 135, "45 days": 45, "90 days notice": 90, "Immediate": 0, "Available immediately": 0}
    assert column(spark, list(cases), lambda c: X.notice_days(c, F.lit(REF))) == list(cases.values())
    with pytest.raises(Exception, match="not understood"):
        column(spark, ["whenever"], lambda c: X.notice_days(c, F.lit(REF)))
    assert column(spark, ["whenever"], lambda c: X.notice_days(c, F.lit(REF), strict=False)) == [None]


def test_stated_years(spark):
    assert column(spark, ["7", "-2", "five years", "", " 3.5 ", "5d", "1e1"], X.stated_years) == [7.0, -2.0, None, None, 3.5, None, 10.0]


def test_parse_location(spark):
    got = column(spark, ["Cairo, Egypt", "Riyadh,Saudi Arabia", "", "Doha", "A, B, C", None], X.parse_location)
    assert [tuple(r) for r in got] == [("Cairo", "Egypt"), ("Riyadh", "Saudi Arabia"), ("", ""), ("Doha", ""), ("A", "B, C"), ("", "")]


def test_past_roles(spark):
    raw = "Data Analyst, Acme (Cairo) — 2022–Present: built things. | Clerk, Old Co (Giza) — earlier tenure, 2+ years."
    html = "<b>Dev, X (Doha)</b> <br/>2019-Present: &nbsp;ships"
    got = column(spark, [raw, "", html], lambda c: X.past_roles(c, F.lit(REF)))
    a, b = got[0]
    assert (a["title"], a["company"], a["city"], a["is_current"], a["start_year"]) == ("Data Analyst", "Acme", "Cairo", True, 2022)
    assert a["duration_years"] == round((REF - dt.date(2022, 1, 1)).days / 365.25, 2)
    assert (b["title"], b["is_current"], b["start_year"], b["duration_years"]) == ("Clerk", False, None, 2.0)
    assert got[1] == [] and got[2][0]["start_year"] == 2019
    with pytest.raises(Exception, match="not understood"):
        column(spark, ["-"], lambda c: X.past_roles(c, F.lit(REF)))


def test_lists_and_blanks(spark):
    assert column(spark, ["a, b,,c ", "-", "", None], X.split_list) == [["a", "b", "c"], [], [], []]
    assert column(spark, ["-", " ", None, "x"], X.blank) == [True, True, True, False]


def test_bands(spark):
    assert column(spark, [None, 0, 30, 45, 60, 90], X.availability, "int") == [0.0, 1.0, 0.75, 0.5, 0.25, 0.0]
    assert column(spark, [0.0, 2.0, 4.0, 7.0, 9.0], lambda c: X.band_fit(c, F.lit(4), F.lit(7)), "double") == [0.0, 0.5, 1.0, 1.0, 0.85]
    assert column(spark, [5.84, 5.0, 87.5, 0.25, 100.0], X.short_number, "double") == ["5.84", "5", "87.5", "0.25", "100"]
    rng = random.Random(8)
    every = [0.0, -2.5, 123.45678, 1234567.0, 1e6, 999999.5, 0.0001, 0.00001234, 1e-5, 1200000.0] + [round(rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 9), 9) for _ in range(300)]
    assert column(spark, every, X.short_number, "double") == [f"{x:g}" for x in every]


def test_location_fit(spark):
    df = spark.createDataFrame([("Riyadh", "Saudi Arabia"), ("Jeddah", "Saudi Arabia"), ("Cairo", "Egypt"), ("", "Saudi Arabia"), (None, None)], "city string, country string")
    got = [r[0] for r in df.select(X.location_fit(F.lit("riyadh"), F.lit("saudi-arabia"), F.col("city"), F.col("country"))).collect()]
    assert got == [1.0, 0.5, 0.0, 0.0, 0.0]
