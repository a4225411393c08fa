"""Parsers by file name or MIME type, tried in order; each turns (content binary) into a parsed-document struct."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter, text
from ..functions.slices import by_slices
from .filters import file_name, suffix


@dataclass(frozen=True)
class Parser:
    name: str
    extensions: frozenset[str]
    mime_types: frozenset[str]
    extract: Callable[[Column], Column] | None


class _Text(HTMLParser):
    """Visible text with a line per block element."""

    BLOCKS = frozenset("p div br li ul ol table tr h1 h2 h3 h4 h5 h6 section article header footer blockquote pre title".split())
    SILENT = frozenset(("script", "style", "noscript", "template"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.muted = 0

    def handle_starttag(self, tag, attrs):
        self.muted += tag in self.SILENT
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.muted = max(0, self.muted - (tag in self.SILENT))
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.muted:
            self.out.append(data)


def html_to_text(value: str | None) -> str | None:
    if value is None:
        return None
    parser = _Text()
    parser.feed(value)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


_html_text = by_slices(lambda values: [html_to_text(v) for v in values], pa.string())


def html_text(c: Column) -> Column:
    return F.arrow_udf(_html_text, "string")(c)


def _docx_texts(contents: list[bytes | None]) -> list[str | None]:
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(content: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))

    return [read(c) for c in contents]


_docx_text = by_slices(_docx_texts, pa.string())


def docx_text(c: Column) -> Column:
    """Paragraphs of a word-processing package; null where it is damaged."""
    return F.arrow_udf(_docx_text, "string")(c)


#: What each kind of parser takes.
PARSERS: list[Parser] = [
    Parser("pdf", frozenset({".pdf"}), frozenset({"application/pdf"}), None),
    Parser("docx", frozenset({".docx"}), frozenset({"application/vnd.openxmlformats-officedocument.wordprocessingml.document"}), docx_text),
    Parser("markdown", frozenset({".md", ".markdown", ".mdown", ".mkd"}), frozenset({"text/markdown", "text/x-markdown"}), lambda c: frontmatter.body(text.decode_bytes(c))),
    Parser("html", frozenset({".html", ".htm", ".xhtml"}), frozenset({"text/html", "application/xhtml+xml"}), lambda c: html_text(text.decode_bytes(c))),
    Parser("code", frozenset({".py", ".js", ".ts", ".tsx", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".sh", ".sql", ".dockerfile"}), frozenset({"text/x-python", "application/javascript"}), text.decode_bytes),
    Parser(
        "text",
        frozenset({".txt", ".text", ".log", ".csv", ".json", ".yaml", ".yml", ".xml", ".ini", ".conf", ".env"}),
        frozenset({"text/plain", "text/csv", "text/tab-separated-values", "application/json", "application/x-yaml", "text/yaml", "text/x-yaml", "application/xml", "text/xml"}),
        text.decode_bytes,
    ),
]


def register_parser(parser: Parser, prepend: bool = False) -> None:
    PARSERS.insert(0, parser) if prepend else PARSERS.append(parser)


def shadowed() -> dict[str, list[str]]:
    """Extensions and MIME types that several parsers take, each with the parsers in order: the first one gets them."""
    takers: dict[str, list[str]] = {}
    for p in PARSERS:
        for what in sorted(p.extensions | p.mime_types):
            takers.setdefault(what, []).append(p.name)
    return {what: names for what, names in takers.items() if len(names) > 1}


def extension_of(name: Column) -> Column:
    """Of a path, a name or a bare extension; Dockerfiles have one of their own."""
    last = file_name(name)
    own = suffix(last)
    return F.lower(
        F.when((F.lower(last) == "dockerfile") | F.lower(last).startswith("dockerfile."), F.lit(".dockerfile"))
        .when(own != "", own)
        .when(name.startswith("."), name)
        .otherwise(F.concat(F.lit("."), name))
    )


def parser_for(name: Column, mime_type: Column | None = None) -> Column:
    """Name of the first parser that takes the extension or the MIME type, null for none."""
    extension = extension_of(name)
    out = None
    for p in PARSERS:
        takes = extension.isin(*p.extensions)
        if mime_type is not None:
            takes = takes | F.coalesce(F.lower(mime_type).isin(*p.mime_types), F.lit(False))
        out = F.when(takes, F.lit(p.name)) if out is None else out.when(takes, F.lit(p.name))
    return out


_METADATA = "title string, author string, creation_date timestamp, modification_date timestamp, page_count int, language string, extra_metadata map<string,string>"
_METADATA_TYPE = f"struct<{','.join(':'.join(f.split()) for f in _METADATA.split(', '))}>"


def _metadata(kind: Column, whole: Column, m: Column, markdown_body: Column) -> Column:
    """What a document says of itself: header entries of Markdown, the title of HTML; one page, and nothing else, of the others."""

    def struct(title: Column, author: Column, made: Column, changed: Column, language: Column, extra: Column) -> Column:
        columns = (title, author, made, changed, F.lit(1), language, extra)
        return F.struct(*[c.alias(f.split()[0]) for c, f in zip(columns, _METADATA.split(", "), strict=True)]).cast(_METADATA_TYPE)

    none = F.lit(None).cast("string")
    no_time = F.lit(None).cast("timestamp")
    empty = F.create_map().cast("map<string,string>")
    markdown = struct(
        frontmatter.title(m, markdown_body), frontmatter.value_of(m, "author"), frontmatter.iso_date(frontmatter.value_of(m, "date", "created")),
        frontmatter.iso_date(frontmatter.value_of(m, "updated", "modified")), frontmatter.value_of(m, "lang", "language"), frontmatter.residual(m),
    )
    head = F.nullif(text.strip(F.regexp_replace(F.regexp_extract(whole, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), F.lit(""))
    author = F.nullif(F.regexp_extract(whole, r"(?is)<meta\s+name=[\"']author[\"']\s+content=[\"']([^\"']*)", 1), F.lit(""))
    language = F.nullif(F.regexp_extract(whole, r"(?is)<html[^>]*\slang=[\"']([^\"']*)", 1), F.lit(""))
    html = struct(head, author, no_time, no_time, language, empty)
    return F.when(kind == "markdown", markdown).when(kind == "html", html).otherwise(struct(none, none, no_time, no_time, none, empty))


def parse(files: DataFrame, mime_type: str | None = None) -> DataFrame:
    """(path, parser, raw_text, metadata, error_code) from (path, content): one branch per parser, rejects with a code and no metadata."""
    kind = files.withColumn("parser", parser_for(F.col("path"), F.col(mime_type) if mime_type else None))
    raw = None
    for p in PARSERS:
        if p.extract is not None:
            # A Python function is run on all rows, wherever it stands, so each parser is given its own files only.
            mine = F.col("parser") == p.name
            made = p.extract(F.when(mine, F.col("content")))
            raw = F.when(mine, made) if raw is None else raw.when(mine, made)
    with_text = kind.withColumn("raw_text", raw)
    unread = [p.name for p in PARSERS if p.extract is None]
    code = (
        F.when(F.col("parser").isNull() | F.col("parser").isin(*unread), F.lit("UNSUPPORTED_DOCUMENT_FORMAT"))
        .when(F.col("raw_text").isNull(), F.lit("CORRUPTED_DOCUMENT"))
        .when(text.strip(F.col("raw_text")) == "", F.lit("EMPTY_DOCUMENT"))
    )
    coded = with_text.withColumn("error_code", code)
    whole = F.when(F.col("parser").isin("markdown", "html"), text.decode_bytes(F.col("content"))).otherwise(F.lit(""))
    # Header and body are columns of their own, so that each is evaluated once.
    marked = F.when(F.col("parser") == "markdown", F.col("whole")).otherwise(F.lit(""))
    coded = coded.withColumn("whole", whole).withColumn("header", frontmatter.header_map(marked)).withColumn("body", frontmatter.body(marked))
    metadata = F.when(F.col("error_code").isNull(), _metadata(F.col("parser"), F.col("whole"), F.col("header"), F.col("body")))
    return coded.select("path", "parser", "raw_text", metadata.alias("metadata"), "error_code")


def processed(parsed: DataFrame) -> DataFrame:
    """Raw and clean text with counts and metadata, of the rows without an error."""
    good = parsed.where("error_code IS NULL").withColumn("clean_text", text.clean(F.col("raw_text")))
    return good.select(
        "path", "parser", "raw_text", "clean_text", "metadata", F.col("metadata.page_count").alias("page_count"), text.count_words(F.col("clean_text")).alias("word_count"), F.length("clean_text").alias("character_count")
    )
