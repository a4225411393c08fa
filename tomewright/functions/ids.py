"""Checksums and name-based identifiers from built-in hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the DNS name space of RFC 4122.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def uuid5(name: Column, space: str = DNS) -> Column:
    """Version 5 UUID of a name: the leading half of a SHA-1 with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("long") % 4 + 8))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def chunk_id(document_id: Column, index: Column, text: Column) -> Column:
    return uuid5(F.concat_ws(":", F.coalesce(document_id.cast("string"), F.lit("no-document")), index.cast("string"), sha256_hex(text)))
