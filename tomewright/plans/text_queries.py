"""Cleaning, counting, frontmatter, chunking and parsing over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter, ids, labels, text
from ..operators import chunking, embedding
from ..sources import filters, parsers
from .registry import query, table

#: A messy text made of a clean one, for operators that clean texts pass untouched.
DIRTY = "concat('  ', source, chr(13), chr(10), chr(9), lang, chr(11), 'x   y', chr(10), chr(10), chr(10), chr(10), text, '  ')"
#: Markdown with a header around a text.
MARKED = "concat('---\\nTitle: \"', source, '\"\\nlang: ', lang, '\\n# note\\nmy key: a: b\\nlang: ', upper(lang), '\\n---\\n# ', source, '\\n', text, '\\n## Part two\\n', source)"
MARKED_SQL = "concat('---', chr(10), 'Title: \"', source, '\"', chr(10), 'lang: ', lang, chr(10), '# note', chr(10), 'my key: a: b', chr(10), 'lang: ', upper(lang), chr(10), '---', chr(10), '# ', source, chr(10), text, chr(10), '## Part two', chr(10), source)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_CLEAN_SQL = r"""
  SELECT doc_id, lang, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(r, chr(10)),
           lambda x: regexp_replace(regexp_replace(x, '[ \t\r\x0b\x0c]+', ' ', 'g'), '^ +| +$', '', 'g')), chr(10)),
         '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS clean
  FROM (SELECT doc_id, lang, regexp_replace(regexp_replace(""" + DIRTY + r""", '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS r FROM documents)
"""  # fmt: skip


@query(f"SELECT doc_id, sha256(clean) AS clean_sha, length(clean) AS n_characters, CASE WHEN clean = '' THEN 0 ELSE len(regexp_split_to_array(clean, '\\s+')) END AS n_words FROM ({_CLEAN_SQL})")
def clean_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends, controls, blanks, counts over texts that were made messy."""
    clean = text.clean(F.expr(DIRTY), unicode=False)
    return docs(spark, sf_dir).select("doc_id", clean.alias("clean")).select(
        "doc_id", ids.sha256_hex(F.col("clean")).alias("clean_sha"), text.count_characters(F.col("clean")).cast("long").alias("n_characters"), text.count_words(F.col("clean")).cast("long").alias("n_words")
    )


@query()
def nfkc_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain with compatibility composition, which SQL lacks."""
    return docs(spark, sf_dir).select("doc_id", text.clean(F.concat(F.lit("ﬁ① "), F.expr(DIRTY))).alias("clean"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(round_even(length(text) / 4.0, 0) AS INTEGER)) END AS token_count FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", text.count_tokens(F.col("text")).alias("token_count"))


@query("SELECT sha256(text) AS checksum, min(doc_id) AS first_doc_id, count(*) AS copies FROM documents GROUP BY 1")
def checksum_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct text."""
    return docs(spark, sf_dir).groupBy(ids.sha256_hex(F.col("text")).alias("checksum")).agg(F.min("doc_id").alias("first_doc_id"), F.count(F.lit(1)).alias("copies"))


_FIXED_SQL = """SELECT doc_id AS document_id, CAST(s // 150 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start_offset, CAST(least(s + 200, length(text)) AS INTEGER) AS end_offset, substr(text, s + 1, 200) AS text
  FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 1 - 50), 150)) AS s FROM documents WHERE length(text) > 0)"""


@query(f"SELECT document_id, chunk_index, start_offset, end_offset, sha256(text) AS checksum FROM ({_FIXED_SQL})")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK01, WIN02, WIN06, X18: windows of 200 characters, 50 of them shared."""
    made = chunking.chunks(docs(spark, sf_dir), chunking.fixed(F.col("text"), 200, 50), "doc_id")
    return made.select("document_id", "chunk_index", "start_offset", "end_offset", ids.sha256_hex(F.col("text")).alias("checksum"))


@query(f"SELECT d.lang, count(*) AS n_chunks, CAST(sum(greatest(1, CAST(round_even(length(c.text) / 4.0, 0) AS INTEGER))) AS BIGINT) AS n_tokens FROM ({_FIXED_SQL}) c JOIN documents d ON d.doc_id = c.document_id GROUP BY 1")
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG08 over CHK01 by language: the chunks are never joined back, the language rides along."""
    spans = docs(spark, sf_dir).select("lang", F.explode(chunking.fixed(F.col("text"), 200, 50)).alias("span"))
    return spans.groupBy("lang").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(text.count_tokens(F.col("span.text"))).alias("n_tokens"))


_UUID_SQL = """SELECT document_id, chunk_index, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) %% 4, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS chunk_id
  FROM (SELECT document_id, chunk_index, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(concat(document_id, ':', chunk_index, ':', sha256(text)))) AS h FROM (%s))""" % _FIXED_SQL


@query(_UUID_SQL)
def chunk_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based identifiers of chunks."""
    made = chunking.chunks(docs(spark, sf_dir), chunking.fixed(F.col("text"), 200, 50), "doc_id")
    return made.select("document_id", "chunk_index", ids.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("text")).alias("chunk_id"))


@query(f"SELECT document_id, start_offset, CAST(greatest(1, start_offset // 3000 + 1) AS INTEGER) AS page_number FROM ({_FIXED_SQL})")
def page_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.chunks(docs(spark, sf_dir), chunking.fixed(F.col("text"), 200, 50), "doc_id")
    return made.select("document_id", "start_offset", frontmatter.page_number(F.col("start_offset")).alias("page_number"))


@query("""SELECT doc_id, key, value FROM (
  SELECT doc_id, 'title' AS key, source AS value FROM documents UNION ALL SELECT doc_id, 'lang', upper(lang) FROM documents UNION ALL SELECT doc_id, 'my_key', 'a: b' FROM documents)""")
def frontmatter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header entries; comments go, of repeated keys the last counts, values keep later colons."""
    marked = docs(spark, sf_dir).select("doc_id", F.expr(MARKED).alias("marked"))
    return marked.select("doc_id", F.explode(frontmatter.header_map(F.col("marked"))))


@query(f"SELECT doc_id, source AS title, upper(lang) AS language, sha256(regexp_replace(split_part({MARKED_SQL}, '---', 3) || coalesce('---' || nullif(array_to_string(list_slice(string_split({MARKED_SQL}, '---'), 4, 1000000), '---'), ''), ''), '^\\s+|\\s+$', '', 'g')) AS body_sha FROM documents")
def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, language and body of Markdown with a header."""
    marked = docs(spark, sf_dir).select("doc_id", F.expr(MARKED).alias("marked"))
    split = marked.select("doc_id", frontmatter.header_map(F.col("marked")).alias("m"), frontmatter.body(F.col("marked")).alias("body"))
    return split.select("doc_id", frontmatter.title(F.col("m"), F.col("body")).alias("title"), frontmatter.value_of(F.col("m"), "lang", "language").alias("language"), ids.sha256_hex(F.col("body")).alias("body_sha"))


_HEADS_SQL = "SELECT doc_id AS document_id, 0 AS pos, source AS title FROM documents UNION ALL SELECT doc_id, 500, lang FROM documents UNION ALL SELECT doc_id, 1000, concat(source, lang) FROM documents"


@query(f"""SELECT c.document_id, c.start_offset, h.title AS section_title FROM ({_FIXED_SQL}) c ASOF LEFT JOIN ({_HEADS_SQL}) h ON c.document_id = h.document_id AND c.start_offset >= h.pos""")
def heading_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN06, WIN03: the last heading at or before each chunk, by one window over both sides."""
    d = docs(spark, sf_dir)
    made = chunking.chunks(d, chunking.fixed(F.col("text"), 200, 50), "doc_id")
    heads = d.select(F.col("doc_id").alias("document_id"), F.inline(F.array(*[F.struct(F.lit(at).alias("pos"), title.alias("title")) for at, title in ((0, F.col("source")), (500, F.col("lang")), (1000, F.concat("source", "lang")))])))
    return chunking.sections_as_of(made, heads)


@query(rf"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(length(regexp_extract(line, '^(#{{1,6}})', 1)) AS INTEGER) AS level, trim(regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1)) AS title FROM (
  SELECT doc_id, l[i] AS line, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) AS pos FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split({MARKED_SQL}, chr(10)) AS l FROM documents)) WHERE l[i] LIKE '#%') WHERE regexp_matches(line, '^#{{1,6}}\s+.+$')""")
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with code-point offsets."""
    marked = docs(spark, sf_dir).select("doc_id", frontmatter.headings(F.expr(MARKED)).alias("h"))
    return marked.select("doc_id", F.inline("h"))


def _chunker(name: str, size: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = chunking.chunks(docs(spark, sf_dir).select("doc_id", F.expr(MARKED).alias("marked")), chunking.greedy(name, size)(F.col("marked")), "doc_id")
        return made.select("document_id", "chunk_index", "start_offset", "end_offset", ids.sha256_hex(F.col("text")).alias("checksum"))

    run.__name__ = f"{name}_chunks"
    return run


#: Windows of 512 characters, each ended by its last line feed, else its last space; blank ends are cut off afterwards.
_TOKENS_SQL = f"""WITH RECURSIVE m AS (SELECT doc_id, {MARKED_SQL} AS t FROM documents),
  c(doc_id, t, a, b) AS (SELECT doc_id, t, 0, 0 FROM m WHERE length(t) > 0 UNION ALL
    SELECT doc_id, t, b, CASE WHEN b + 512 >= length(t) OR round_even(length(t) / 4.0, 0) <= 128 THEN length(t) WHEN n > 1 THEN b + n WHEN s > 1 THEN b + s ELSE b + 512 END
    FROM (SELECT *, CASE WHEN contains(w, chr(10)) THEN length(w) - strpos(reverse(w), chr(10)) + 1 ELSE 0 END AS n, CASE WHEN contains(w, ' ') THEN length(w) - strpos(reverse(w), ' ') + 1 ELSE 0 END AS s
          FROM (SELECT *, substr(t, b + 1, 512) AS w FROM c WHERE b < length(t)))),
  p AS (SELECT doc_id, a, substr(t, a + 1, b - a) AS x FROM c WHERE b > a),
  q AS (SELECT doc_id, a + length(x) - length(regexp_replace(x, '^\\s+', '')) AS a, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM p)
  SELECT doc_id AS document_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS start_offset, CAST(a + length(x) AS INTEGER) AS end_offset, sha256(x) AS checksum FROM q WHERE x <> ''"""

for _name, _size in (("recursive", 800), ("paragraph", 800), ("sentence", 400), ("markdown", 1000), ("adaptive", 800), ("tokens", 128)):
    query(_TOKENS_SQL if _name == "tokens" else None)(_chunker(_name, _size))


@query()
def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN07, CHK07: paragraphs that also hold up to 20 tokens of the text before them."""
    made = chunking.chunks(docs(spark, sf_dir), chunking.greedy("paragraph", 800, 20)(F.col("text")), "doc_id")
    return made.select("document_id", "chunk_index", "start_offset", "end_offset", ids.sha256_hex(F.col("text")).alias("checksum"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN concat('T', source) END AS title, CASE WHEN doc_id % 3 = 0 THEN upper(lang) WHEN doc_id % 3 = 1 THEN lang END AS language, 1 AS page_count,
  CASE WHEN doc_id % 3 = 0 THEN 'a: b' END AS my_key, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-03-05 00:00:00' END AS creation_date FROM documents""")
def parsed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17, SRC18, SRC24: text and metadata in one pass over Markdown, HTML and plain files made of the documents."""
    kind = F.col("doc_id") % 3
    content = (
        F.when(kind == 0, F.regexp_replace(F.expr(MARKED), "# note", "date: 20240305"))
        .when(kind == 1, F.concat(F.lit("<html lang='"), F.col("lang"), F.lit("'><head><title> T"), F.col("source"), F.lit("\n</title></head><body>x</body></html>")))
        .otherwise(F.concat(F.lit("x"), F.col("text")))
    )
    path = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".md"), F.lit(".html"), F.lit(".txt")), (kind + 1).cast("int")))
    parsed = parsers.parse(docs(spark, sf_dir).select(path.alias("path"), content.cast("binary").alias("content")))
    m = F.col("metadata")
    return parsed.select(
        F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), m["title"].alias("title"), m["language"].alias("language"), m["page_count"].alias("page_count"),
        F.try_element_at(m["extra_metadata"], F.lit("my_key")).alias("my_key"), m["creation_date"].alias("creation_date"),
    )


@query()
def chunking_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK07, X15: adaptive chunks with identifiers, sections, pages and totals."""
    marked = docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.expr(MARKED).alias("marked"))
    made = chunking.chunks(marked, chunking.greedy("adaptive", 800)(F.col("marked")))
    return chunking.enrich(made, marked.select("document_id", frontmatter.headings(F.col("marked")).alias("headings")), "adaptive").drop("text")


_PATHS = "concat(CASE page_id % 5 WHEN 0 THEN '.git/' WHEN 1 THEN 'node_modules/a/' WHEN 2 THEN 'docs/.x/' ELSE 'docs/' END, 'p', page_id, CASE page_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' ELSE '' END)"


@query(f"""SELECT page_id, path FROM (SELECT page_id, {_PATHS} AS path FROM pages)
  WHERE NOT regexp_matches(path, '(^|/)\\.[^/]') AND regexp_matches(lower(path), '\\.(md|txt)$') AND NOT regexp_matches(path, '^node_modules/.*$') AND (regexp_matches(path, '^docs/.*$') OR regexp_matches(path, 'p1[^/]*$'))""")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT01-FLT04: hidden parts, extensions, excludes and includes."""
    config = filters.SourceConfig("x", allowed_extensions=("md", ".TXT"), exclude_patterns=("node_modules/*",), include_patterns=("docs/*", "p1*"))
    paths = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATHS).alias("path"))
    return paths.where(filters.accepted(F.col("path"), config))


_NAMES = "CASE page_id % 9 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN 'dockerfile.dev' WHEN 2 THEN '.pdf' WHEN 3 THEN 'pdf' WHEN 4 THEN 'a/b.tar.gz' WHEN 5 THEN 'README' WHEN 6 THEN 'x.MD' WHEN 7 THEN 'x.html' ELSE 'x.yaml' END"


@query(f"""SELECT page_id, CASE page_id % 9 WHEN 0 THEN '.dockerfile' WHEN 1 THEN '.dockerfile' WHEN 2 THEN '.pdf' WHEN 3 THEN '.pdf' WHEN 4 THEN '.gz' WHEN 5 THEN '.readme' WHEN 6 THEN '.md' WHEN 7 THEN '.html' ELSE '.yaml' END AS extension,
  CASE page_id % 9 WHEN 0 THEN 'code' WHEN 1 THEN 'code' WHEN 2 THEN 'pdf' WHEN 3 THEN 'pdf' WHEN 6 THEN 'markdown' WHEN 7 THEN 'html' WHEN 8 THEN 'text' END AS parser FROM pages""")
def parser_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15, SRC23: extension rules and the first parser that takes it."""
    names = table(spark, sf_dir, "pages").select("page_id", F.expr(_NAMES).alias("name"))
    return names.select("page_id", parsers.extension_of(F.col("name")).alias("extension"), parsers.parser_for(F.col("name")).alias("parser"))


@query()
def html_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC03, SRC21: visible text of raw pages through the parse step, rejects with their code."""
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return parsers.parse(files)


@query("SELECT lang, CAST(greatest(1, least(256, floor(32768 / greatest(1.0, avg(length(text)) / 4.0)))) AS INTEGER) AS batch_size FROM documents GROUP BY 1")
def adaptive_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG07 per language."""
    mean = F.greatest(F.lit(1.0), F.avg(F.length("text")) / 4.0)
    return docs(spark, sf_dir).groupBy("lang").agg(F.greatest(F.lit(1), F.least(F.lit(256), F.floor(32768 / mean))).cast("int").alias("batch_size"))


@query("SELECT doc_id, source, CAST((rn - 1) // 32 AS INTEGER) AS batch_number, CAST((rn - 1) % 32 AS INTEGER) AS batch_index FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)")
def numbered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN04: batches of 32 within each source."""
    return embedding.with_batches(docs(spark, sf_dir).select("doc_id", "source"), "doc_id", "source", 32)


@query(r"""SELECT doc_id, CASE WHEN b < 1024 THEN printf('%d B', CAST(b AS BIGINT)) WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0, 1)) ELSE printf('%.1f MB', round(b / 1048576.0, 1)) END AS size_label,
  concat(regexp_replace(printf('%.1f', round(CASE WHEN b < 1024 THEN b WHEN b < 1048576 THEN b / 1024.0 ELSE b / 1048576.0 END, 1)), '\.0$', ''), CASE WHEN b < 1024 THEN ' B' WHEN b < 1048576 THEN ' KB' ELSE ' MB' END) AS short_label,
  CASE WHEN s < 1 THEN printf('%.0fms', s * 1000) WHEN s < 60 THEN printf('%.2fs', s) WHEN s < 3600 THEN printf('%dm %.1fs', CAST(floor(s / 60) AS INTEGER), s - 60 * floor(s / 60)) ELSE printf('%dh %dm', CAST(floor(s / 3600) AS INTEGER), CAST(floor((s - 3600 * floor(s / 3600)) / 60) AS INTEGER)) END AS duration_label,
  concat(substr(h, 1, 8), '...', substr(h, 59, 6)) AS hash_label
  FROM (SELECT doc_id, CAST(n_chars * 64 + 7 AS DOUBLE) AS b, CAST(n_chars AS DOUBLE) AS s, sha256(text) AS h FROM documents) t""")
def format_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, durations, hashes as people read them."""
    base = docs(spark, sf_dir).select("doc_id", (F.col("n_chars") * 64 + 7).cast("double").alias("b"), F.col("n_chars").cast("double").alias("s"), ids.sha256_hex(F.col("text")).alias("h"))
    return base.select("doc_id", labels.size_label(F.col("b")).alias("size_label"), labels.size_label_short(F.col("b")).alias("short_label"), labels.duration_label(F.col("s")).alias("duration_label"), labels.hash_label(F.col("h")).alias("hash_label"))
