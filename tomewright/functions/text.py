"""Text normalisation and counts as column expressions, and the one step that needs Python (NFKC)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .slices import by_slices

#: Zero-width and formatting characters, and controls other than tab, line feed and return.
REMOVED = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{200b}-\x{200f}\x{feff}\x{ad}\x{2060}]"
CHARS_PER_TOKEN = 4.0


def strip(c: Column) -> Column:
    """Remove Unicode blanks at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def remove_controls(c: Column) -> Column:
    """Controls and zero-width characters vanish; words on their two sides join."""
    return F.regexp_replace(c, REMOVED, "")


def unify_line_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def collapse_blanks(c: Column) -> Column:
    """One space per run of blanks within a line, stripped lines, at most one empty line in a row, stripped text."""
    lines = F.transform(F.split(c, "\n"), lambda x: strip(F.regexp_replace(x, r"(?U)[^\S\n]+", " ")))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


_nfkc = by_slices(lambda texts: [None if t is None else unicodedata.normalize("NFKC", t) for t in texts], pa.string())


def nfkc(c: Column) -> Column:
    """Compatibility composition; no built-in function has it."""
    return F.arrow_udf(_nfkc, "string")(c)


def clean(c: Column, unicode: bool = True) -> Column:
    """Line ends, compatibility characters, controls, blanks, in this order."""
    c = unify_line_ends(c)
    return collapse_blanks(remove_controls(nfkc(c) if unicode else c))


def count_words(c: Column) -> Column:
    s = strip(c)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, r"(?U)\s+")))


def count_characters(c: Column) -> Column:
    return F.length(c)


def count_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded half to even, one at least; none in the empty text."""
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(F.length(c) / F.lit(CHARS_PER_TOKEN)).cast("int")))


def decode_bytes(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def query_tokens(c: Column, max_length: int | None = None) -> Column:
    """Lower-cased letters-and-digits tokens of a query, cut to a length where one is given."""
    return F.regexp_extract_all(F.lower(c if max_length is None else F.substring(c, 1, max_length)), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def normalise_query(c: Column, max_length: int = 1000) -> Column:
    return F.lower(strip(F.regexp_replace(F.substring(c, 1, max_length), r"(?U)\s+", " ")))


def query_preview(c: Column) -> Column:
    """A query as messages show it: its first hundred characters, and dots where there are more."""
    return shorten(c, 100, 100)


def shorten(c: Column, limit: int, head: int) -> Column:
    """Texts over the limit become their head and three dots."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, head), F.lit("..."))).otherwise(c)
