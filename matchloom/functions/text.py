"""Column functions for cleaning profile and requirement text. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import unescape

# Symbols that would vanish in a key, in the order in which they are replaced.
SPELLED = (("c++", "c-plus-plus"), ("c#", "c-sharp"), (".net", "dot-net"))

def py_round(x: Column, d: int) -> Column:
    """x to d decimals, half to even on the exact binary value: a two-product tells on which side of a tie x lies."""
    m = F.lit(float(10**d))
    a = F.abs(x)
    t = a * F.lit(134217729.0)
    hi = t - (t - a)
    p = a * m
    err = (hi * m - p) + (a - hi) * m
    b = F.floor(p).cast("double")
    fr = p - b
    up = (fr > 0.5) | ((fr == 0.5) & ((err > 0) | ((err == 0) & (b % 2 != 0))))
    return F.signum(x) * (b + F.when(up, 1.0).otherwise(0.0)) / m


def strip(c: Column) -> Column:
    """White space at both ends, Unicode's included, taken off."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")).isin("", "-")


def strip_html(c: Column) -> Column:
    """Tags become blanks, entities are decoded, blanks run together, white space at both ends goes."""
    return strip(F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]+>", " ")), "[ \t]+", " "))


def normalize_key(c: Column) -> Column:
    """Lower case, known symbols spelled out, every other separator one hyphen."""
    s = F.lower(strip(c))
    s = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(f" {e[1]} ")), SPELLED, s)
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def parse_location(c: Column) -> Column:
    """struct(city, country), split at the first comma."""
    part = F.split(F.coalesce(c, F.lit("")), ",", 2)
    return F.struct(strip(part[0]).alias("city"), F.coalesce(strip(F.get(part, 1)), F.lit("")).alias("country"))


def stated_years(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def notice_days(c: Column, ref: Column, strict: bool = True) -> Column:
    """Days until someone can start. Blank: null. Other text fails, or with strict=False is null."""
    s = F.lower(strip(c))

    def number(word):
        return F.regexp_extract(s, rf"(\d+)\s*{word}", 1)

    year = F.regexp_extract(s, r"starts in (\d{4})", 1)
    out = F.when(F.coalesce(s, F.lit("")) == "", F.lit(None).cast("int")).when(s.isin("immediate", "available immediately", "negotiable"), 0)
    out = out.when(year != "", F.datediff(F.make_date(year.try_cast("int"), F.lit(1), F.lit(1)), ref))
    for word, days in (("week", 7), ("month", 30), ("day", 1)):
        out = out.when(number(word) != "", number(word).try_cast("int") * days)
    return out.otherwise(F.raise_error(F.concat(F.lit("notice period not understood: "), c)).cast("int") if strict else F.lit(None).cast("int"))


def years_between(year: Column, ref: Column) -> Column:
    days = F.greatest(F.datediff(ref, F.make_date(year, F.lit(1), F.lit(1))), F.lit(0))
    return py_round(days / F.lit(365.25), 2)


def split_list(c: Column) -> Column:
    """Comma list to array, trimmed, empties dropped; blank or "-" is empty."""
    parts = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.when(blank(c), F.array().cast("array<string>")).otherwise(parts)


# The formats of a past role, in two patterns. White space is Unicode's here: a decoded &nbsp; may stand between the parts.
_DATED = r"^([^,]+),(?U:\s*)(.+?)(?U:\s*)\(([^)]+)\)(?U:\s*)[—-]?(?U:\s*)(\d{4})[–-]Present:?(?U:\s*)(.*)$"
_EARLIER = r"^([^,]+),(?U:\s*)(.+?)(?U:\s*)\(([^)]+)\)(?U:\s*)—(?U:\s*)earlier tenure,(?U:\s*)(\d+)\+?(?U:\s*)years?\.?$"


def past_roles(c: Column, ref: Column, strict: bool = True) -> Column:
    """array<struct(title, company, city, is_current, start_year, duration_years, raw)> of pipe-separated segments."""
    text = F.when(c.contains("<"), strip_html(c)).otherwise(c)
    segments = F.filter(F.transform(F.split(text, r"\|"), strip), lambda s: s != "")

    def one(s):
        dated, earlier = s.rlike(_DATED), s.rlike(_EARLIER)

        def group(i):
            return strip(F.when(dated, F.regexp_extract(s, _DATED, i)).otherwise(F.regexp_extract(s, _EARLIER, i)))

        year = F.when(dated, F.regexp_extract(s, _DATED, 4).try_cast("int"))
        years = F.when(dated, years_between(year, ref)).otherwise(F.regexp_extract(s, _EARLIER, 4).try_cast("double"))
        row = F.struct(group(1).alias("title"), group(2).alias("company"), group(3).alias("city"), dated.alias("is_current"), year.alias("start_year"), years.alias("duration_years"), s.alias("raw"))
        none = F.raise_error(F.concat(F.lit("past role not understood: "), s)) if strict else F.lit(None)
        return F.when(dated | earlier, row).otherwise(none)

    found = F.transform(segments, one)
    kind = "array<struct<title:string,company:string,city:string,is_current:boolean,start_year:int,duration_years:double,raw:string>>"
    return F.when(F.coalesce(strip(c), F.lit("")) == "", F.array().cast(kind)).otherwise(found if strict else F.filter(found, lambda x: x.isNotNull()))


def short_number(c: Column) -> Column:
    """A number with at most six significant digits and no trailing zeros."""
    digits = F.format_string("%.6g", c.cast("double"))
    return F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")


def band_fit(years: Column, lo: Column, hi: Column) -> Column:
    return F.when(years <= 0, 0.0).when((years >= lo) & (years <= hi), 1.0).when(years > hi, 0.85).otherwise(py_round(F.least(F.lit(1.0), F.try_divide(years, lo.cast("double"))), 3))


def availability(days: Column) -> Column:
    return F.when(days.isNull(), 0.0).when(days <= 0, 1.0).when(days <= 30, 0.75).when(days <= 45, 0.5).when(days <= 60, 0.25).otherwise(0.0)


def location_fit(want_key: Column, want_country: Column, city: Column, country: Column) -> Column:
    """1 in the same city, 0.5 in the same country, else 0; all compared by key."""
    return F.when(F.coalesce(city, F.lit("")) == "", 0.0).when(normalize_key(city) == want_key, 1.0).when((F.coalesce(country, F.lit("")) != "") & (normalize_key(country) == want_country), 0.5).otherwise(0.0)
