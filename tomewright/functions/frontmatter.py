"""Frontmatter, headings, dates and page estimates of Markdown texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

FENCE = "---"
#: Keys that become columns; the others are residual metadata.
KNOWN_KEYS = ("title", "author", "date", "created", "updated", "modified", "lang", "language")


def _parts(c: Column) -> Column:
    return F.split(c, FENCE, 3)


def _has_header(c: Column) -> Column:
    return c.startswith(FENCE) & (F.size(_parts(c)) >= 3)


def body(c: Column) -> Column:
    """What follows the first two fences, wherever they stand; the whole text where there are not two."""
    return F.when(_has_header(c), strip(F.get(_parts(c), F.lit(2)))).otherwise(c)


def header_entries(c: Column) -> Column:
    """(key, value) in order: lines with a colon, blank lines and comments left out, quotes stripped."""
    lines = F.split(F.when(_has_header(c), F.get(_parts(c), F.lit(1))).otherwise(F.lit("")), "\n")
    used = F.filter(lines, lambda x: (strip(x) != "") & ~strip(x).startswith("#") & F.contains(x, F.lit(":")))

    def entry(x: Column) -> Column:
        at = F.instr(x, ":")
        key = F.regexp_replace(F.lower(strip(F.substr(x, F.lit(1), at - 1))), " ", "_")
        value = F.regexp_replace(strip(F.substr(x, at + 1)), "^[\"']+|[\"']+$", "")
        return F.struct(key.alias("key"), value.alias("value"))

    return F.transform(used, entry)


def header_map(c: Column) -> Column:
    """Key to value, the last of a repeated key; independent of the session's policy for repeated keys."""
    entries = header_entries(c)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def value_of(m: Column, *keys: str) -> Column:
    """The first of the keys that has a value which is not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in keys])


def title(m: Column, text_body: Column) -> Column:
    return F.coalesce(value_of(m, "title"), F.nullif(strip(F.regexp_extract(text_body, r"(?md)^#\s+(.+)$", 1)), F.lit("")))


def residual(m: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*KNOWN_KEYS))


def iso_date(c: Column) -> Column:
    """ISO dates and times as timestamps, those without zone as UTC; anything else is null."""
    s = F.regexp_replace(strip(c), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(s))


def pdf_date(c: Column) -> Column:
    """D:YYYYMMDD[HHmmSS][zone]; the zone is read and left out of account. Else an ISO date."""
    s = strip(c)
    parts = F.regexp_extract(s, r"^D:(\d{8})", 1)
    clock = F.regexp_extract(s, r"^D:\d{8}(\d{6})", 1)
    made = F.try_to_timestamp(F.concat(parts, F.when(clock == "", F.lit("000000")).otherwise(clock)), F.lit("yyyyMMddHHmmss"))
    return F.when(s.startswith("D:"), made).otherwise(iso_date(s))


def page_number(offset: Column, per_page: int = 3000) -> Column:
    if per_page <= 0:
        return F.lit(None).cast("int")
    return F.greatest(F.lit(1), F.expr("1") + F.floor(offset / per_page).cast("int"))


_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)


def _headings(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("level", pa.int32()), ("title", pa.string())]))
    return pa.array([[{"pos": m.start(), "level": len(m.group(1)), "title": m.group(2).strip()} for m in _HEADING.finditer(t or "")] for t in texts.to_pylist()], kind)


def headings(c: Column) -> Column:
    """All headings with code-point offsets, which regular expressions of the JVM do not give."""
    return F.arrow_udf(_headings, "array<struct<pos:int,level:int,title:string>>")(c)


def section_at(found: Column, offset: Column) -> Column:
    """Title of the nearest heading at or before the offset, null if none."""
    before = F.filter(found, lambda h: h["pos"] <= offset)
    return F.when(F.size(before) > 0, F.element_at(before, -1)["title"])
