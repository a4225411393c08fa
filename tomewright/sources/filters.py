"""Which paths of a corpus count: hidden files, extensions, exclude and include patterns, as column expressions."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SourceConfig:
    source_path_or_uri: str
    batch_size: int = 100
    ignore_hidden: bool = True
    allowed_extensions: tuple[str, ...] | None = None
    exclude_patterns: tuple[str, ...] = field(default=())
    include_patterns: tuple[str, ...] = field(default=())


def validate(config: SourceConfig) -> bool:
    if not config.source_path_or_uri.strip():
        raise ValueError("INVALID_SOURCE: the path or address is blank")
    if config.batch_size <= 0:
        raise ValueError("INVALID_SOURCE: batch_size must be positive")
    return True


def glob_regex(pattern: str) -> str:
    """The shell pattern as a regular expression for a whole string; a star also crosses slashes."""
    return fnmatch.translate(pattern).replace("\\z", "\\Z").replace("(?s:", "(?s)(?:").removesuffix("\\Z") + "$"


def matches_any(path: Column, name: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        regex = "^" + glob_regex(p)
        out = out | path.rlike(regex) | name.rlike(regex)
    return out


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(name: Column) -> Column:
    """The last dot and what follows it, empty for none, and for a leading or a final dot."""
    return F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1)


def hidden(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.exists(parts, lambda p: p.startswith(".") & ~p.isin(".", ".."))


def accepted(path: Column, config: SourceConfig) -> Column:
    """Hidden parts, then extensions, then excludes, then includes; an empty include list takes all."""
    name = file_name(path)
    out = F.lit(True)
    if config.ignore_hidden:
        out = out & ~hidden(path)
    if config.allowed_extensions is not None:
        allowed = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in config.allowed_extensions]
        out = out & (F.lower(suffix(name)).isin(*allowed) if allowed else F.lit(False))
    if config.exclude_patterns:
        out = out & ~matches_any(path, name, config.exclude_patterns)
    if config.include_patterns:
        out = out & matches_any(path, name, config.include_patterns)
    return out
