"""HTML entities decoded by built-in expressions: the same text as Python's html.unescape gives.

A text is cut at each ampersand. A part that begins with a name is looked up by its longest prefix that names an entity; the
table, from Python's standard library, is one literal of BUCKETS small maps by checksum, as a literal map is searched from
its start. A part that begins with a number is worked out.
"""

from __future__ import annotations

import json
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1024
#: What numbers of the C1 controls stand for: their characters in Windows-1252, or themselves.
_C1 = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)]


def _table() -> Column:
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, text in html5.items():
        buckets[zlib.crc32(name.encode()) % BUCKETS][name] = text
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")


def _number(n: Column) -> Column:
    """The character of a number as HTML has it; null: a number too large."""
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    control = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    wrong = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    c1 = F.get(F.array(*map(F.lit, _C1)), n - 0x80)
    return F.when(wrong, "�").when(n == 13, "\r").when(n.between(0x80, 0x9F), c1).when(control, "").otherwise(char)


def _part(part: Column, table: Column) -> Column:
    """What stands after an ampersand, decoded."""
    found = lambda name: F.try_element_at(F.get(table, (F.crc32(name.cast("binary")) % BUCKETS).cast("int")), name)
    name = F.regexp_extract(part, "^[^\t\n\f <&#;]{1,32};?", 0)
    prefixes = F.transform(F.sequence(F.length(name), F.lit(2), F.lit(-1)), lambda n: F.substring(name, F.lit(1), n))
    longest = F.when(F.length(name) >= 2, F.get(F.filter(prefixes, lambda p: found(p).isNotNull()), F.lit(0)))
    ref = F.regexp_extract(part, "^#([0-9]+|[xX][0-9a-fA-F]+);?", 0)
    decimal, hexa = (F.regexp_extract(part, p, 1) for p in ("^#0*([0-9]*)", "^#[xX]0*([0-9a-fA-F]*)"))
    n = F.when(ref.rlike("^#[xX]"), F.when(F.length(hexa) <= 6, F.conv(F.concat(F.lit("0"), hexa), 16, 10).cast("int"))).otherwise(F.when(F.length(decimal) <= 7, F.concat(F.lit("0"), decimal).cast("int")))
    after = lambda start: F.substring(part, F.length(start) + 1, F.length(part))
    return F.when(ref != "", F.concat(_number(n), after(ref))).when(longest.isNotNull(), F.concat(found(longest), after(longest))).otherwise(F.concat(F.lit("&"), part))


def unescape(c: Column) -> Column:
    """Named and numeric entities decoded; null stays null."""
    table, parts = _table(), F.split(c, "&", -1)
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: _part(p, table))
    return F.when(~c.contains("&"), c).otherwise(F.concat(parts[0], F.array_join(rest, "")))
