"""Column functions against hand-written rows."""

import datetime as dt
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from tomewright.functions import frontmatter, ids, labels, text, vectors


@pytest.fixture
def value(spark):
    def of(column, **inputs):
        df = spark.range(1)
        for k, (v, kind) in inputs.items():
            df = df.withColumn(k, F.lit(v).cast(kind))
        return df.select(column.alias("out")).first()["out"]

    return of


def s(v):
    return (v, "string")


def test_controls_vanish_and_words_join(value):
    assert value(text.remove_controls(F.col("x")), x=s("a\x0bb​c\x85d\te")) == "abcd\te"


def test_blanks_collapse(value):
    assert value(text.collapse_blanks(F.col("x")), x=s("  a \t b c \n\n  \n\n d　e  \n")) == "a b c\n\nd e"


def test_clean_order(value):
    assert value(text.clean(F.col("x")), x=s("ﬁ\r\nx\r")) == "fi\nx"


@pytest.mark.parametrize("t, n", [("", 0), ("  ", 0), ("a  b\nc", 3)])
def test_word_count(value, t, n):
    assert value(text.count_words(F.col("x")), x=s(t)) == n


@pytest.mark.parametrize("n, want", [(0, 0), (1, 1), (2, 1), (6, 2), (10, 2), (14, 4)])
def test_token_count_rounds_half_to_even(value, n, want):
    assert value(text.count_tokens(F.col("x")), x=s("x" * n)) == want


@pytest.mark.parametrize("raw, want", [(b"\xc3\xa9", "é"), (b"\xe9", "é"), (b"\xef\xbb\xbfa", "﻿a")])
def test_decoding(spark, raw, want):
    assert spark.createDataFrame([(bytearray(raw),)], "c binary").select(text.decode_bytes(F.col("c"))).first()[0] == want


HEADER = "---\nTitle: 'A: b'\n# c\nweight: 10\n\ncard:\n  weight: 20\n- x\n---\nbody"


def test_frontmatter(value):
    assert value(frontmatter.header_map(F.col("x")), x=s(HEADER)) == {"title": "A: b", "weight": "20", "card": ""}
    assert value(frontmatter.body(F.col("x")), x=s(HEADER)) == "body"


def test_frontmatter_fences_are_not_anchored(value):
    assert value(frontmatter.header_map(F.col("x")), x=s("---\ntitle: a---b\n---\nbody")) == {"title": "a"}
    assert value(frontmatter.body(F.col("x")), x=s("---\ntitle: a---b\n---\nbody")) == "b\n---\nbody"


@pytest.mark.parametrize("t", ["--- only", "no header"])
def test_no_frontmatter(value, t):
    assert value(frontmatter.header_map(F.col("x")), x=s(t)) == {} and value(frontmatter.body(F.col("x")), x=s(t)) == t


@pytest.mark.parametrize("t, want", [("2026-08-05T15:30:00Z", dt.datetime(2026, 8, 5, 15, 30)), ("2026-08-05", dt.datetime(2026, 8, 5)), ("20260805", dt.datetime(2026, 8, 5)), ("nope", None)])
def test_iso_dates(value, t, want):
    got = value(F.date_format(frontmatter.iso_date(F.col("x")), "yyyy-MM-dd HH:mm"), x=s(t))
    assert got == (want and want.strftime("%Y-%m-%d %H:%M"))


def test_pdf_date_ignores_its_zone(value):
    assert value(F.date_format(frontmatter.pdf_date(F.col("x")), "yyyy-MM-dd HH:mm"), x=s("D:20260805153000+02'00'")) == "2026-08-05 15:30"


@pytest.mark.parametrize("off, per, want", [(0, 3000, 1), (2999, 3000, 1), (3000, 3000, 2), (5, 0, None)])
def test_pages(value, off, per, want):
    assert value(frontmatter.page_number(F.col("x"), per), x=(off, "int")) == want


def test_headings_count_code_points(value):
    found = value(frontmatter.headings(F.col("x")), x=s("😀\n# A b\ntext\n###  C\n"))
    assert [(h.pos, h.level, h.title) for h in found] == [(2, 1, "A b"), (13, 3, "C")]


def test_section_at(spark):
    df = spark.createDataFrame([(o, [(0, 1, "A"), (10, 1, "B")]) for o in (0, 9, 10, 99)] + [(5, [])], "o int, h array<struct<pos:int,level:int,title:string>>")
    assert [r[0] for r in df.select(frontmatter.section_at(F.col("h"), F.col("o"))).collect()] == ["A", "A", "B", "B", None]


@pytest.mark.parametrize("doc, want", [(None, "f8c5c191-68a3-5570-982b-02506bb7a915"), ("abc", "7d8f341e-8dc9-5bdb-ab5d-b389fa520f4c")])
def test_chunk_ids(value, doc, want):
    assert value(ids.chunk_id(F.col("d"), F.lit(0), F.lit("hi")), d=s(doc)) == want
    assert want == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{doc or 'no-document'}:0:{hashlib.sha256(b'hi').hexdigest()}"))


@pytest.mark.parametrize("v, want", [([3.0, 4.0], [0.6, 0.8]), ([0.0, 0.0], [0.0, 0.0])])
def test_normalise(spark, v, want):
    assert spark.createDataFrame([(v,)], "v array<float>").select(vectors.normalise(F.col("v"))).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("x, want", [(1.0, 1.0), (1.01, 0.4975), (-3.0, 0.1)])
def test_confidence_jumps_above_one(value, x, want):
    assert value(labels.confidence(F.col("x")), x=(x, "double")) == want


@pytest.mark.parametrize("n, want", [(0.25, "250ms"), (59.999, "60.00s"), (61.25, "1m 1.3s"), (3725.0, "1h 2m"), (-1.0, "0.00s")])
def test_durations(value, n, want):
    assert value(labels.duration_label(F.col("x")), x=(n, "double")) == want


@pytest.mark.parametrize("n, want", [(0, "0 B"), (1024, "1 KB"), (1048576, "1 MB"), (5242880, "5 MB"), (1536, "1.5 KB")])
def test_short_sizes(value, n, want):
    assert value(labels.size_label_short(F.col("x")), x=(n, "bigint")) == want


@pytest.mark.parametrize("n, want", [(None, "N/A"), (0.4, "< 1 ms"), (14.234, "14.2 ms")])
def test_latency(value, n, want):
    assert value(labels.latency_label(F.col("x")), x=(n, "double")) == want


@pytest.mark.parametrize("h, want", [("e3b0c442" + "0" * 50 + "52b855", "e3b0c442...52b855"), ("e3b0c442", "e3b0c442")])
def test_hash_label(value, h, want):
    assert value(labels.hash_label(F.col("x")), x=s(h)) == want


@pytest.mark.parametrize("t, want", [("INCIDENT_POSTMORTEM", "INCIDENT_REPORT"), ("API_DOCUMENTATION", "MANUAL"), ("zzz", "OTHER"), ("POLICY", "POLICY")])
def test_categories(value, t, want):
    assert value(labels.category(F.col("x")), x=s(t)) == want


@pytest.mark.parametrize("t, want", [("RUNBOOK", "Runbook"), ("READY", "Ready"), ("EMBEDDED", "Indexed"), ("healthy", "Operational")])
def test_states(value, t, want):
    assert value(labels.state_label(F.col("x")), x=s(t)) == want


@pytest.mark.parametrize("f, hours", [("hourly", 1), ("daily", 24), ("weekly", 168), ("manual", None), ("custom", None)])
def test_next_run(value, f, hours):
    got = value(F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp"), labels.next_run(F.col("x"), F.lit("2024-01-01").cast("timestamp"))), x=s(f))
    assert got == hours


def test_names_and_urls(value):
    assert value(labels.snake_case(F.col("x")), x=s("KnowledgeChunk")) == "knowledge_chunk"
    assert value(labels.url_host(F.col("x")), x=s("postgresql://u:p@db.host:5432/x")) == "db.host"
    assert value(labels.url_port(F.col("x")), x=s("postgresql://u:p@db.host:5432/x")) == 5432


def test_labels_of_scores_and_times(spark):
    from tomewright.functions import labels as lb

    row = spark.createDataFrame([(12.34, 1234.5, 0.4567, None, "2024-03-05 10:00:00")], "a double, b double, c double, d double, t string").select(
        lb.milliseconds_label(F.col("a")).alias("a"), lb.milliseconds_label(F.col("b")).alias("b"), lb.milliseconds_label(F.col("d")).alias("d"), lb.score_label(F.col("c")).alias("c"), lb.score_label(F.col("d")).alias("e"),
        lb.date_label(F.col("t").cast("timestamp")).alias("t"), lb.relative_label(F.col("t").cast("timestamp"), F.lit("2024-03-05 12:30:00").cast("timestamp")).alias("u"),
        lb.relative_label(F.lit(None).cast("timestamp"), F.col("t").cast("timestamp")).alias("v"), lb.joined_tags(F.array(F.lit("x"), F.lit("y"))).alias("w"), lb.split_tags(F.lit("x,y")).alias("x"), lb.split_tags(F.lit(None).cast("string")).alias("y"),
    ).first()
    assert row[:7] == ("12.3ms", "1.23s", "N/A", "0.4567", "N/A", "Mar 5, 2024", "2 hours ago")
    assert row[7:] == ("—", "x,y", ["x", "y"], [])


def test_python_holds_few_texts_at_once(monkeypatch):
    import pyarrow as pa

    from tomewright.functions import slices

    texts = ["a" * (k % 50) for k in range(2000)] + [None, "", "b" * 5000, None]
    monkeypatch.setattr(slices, "BYTES", 1000)
    seen = []

    def work(some):
        seen.append((len(some), sum(len(t or "") for t in some)))
        return [None if t is None else t.upper() for t in some]

    run = slices.by_slices(work, pa.string())
    assert run(pa.array(texts)).to_pylist() == [None if t is None else t.upper() for t in texts]
    assert all(n <= slices.ROWS and (size <= 1000 or n == 1) for n, size in seen) and len(seen) > 40
    assert run(pa.array(texts).slice(1990, 14)).to_pylist() == [None if t is None else t.upper() for t in texts[1990:]]
    assert run(pa.array([], pa.string())).to_pylist() == []


def test_chunks_are_made_of_few_texts_at_once(spark, monkeypatch):
    import pyarrow as pa

    from tomewright.functions import slices
    from tomewright.operators import chunking

    texts = pa.array([None, "", *[f"text {k} " * 40 for k in range(300)]])
    made = []
    array = pa.array
    run = chunking.greedy("tokens", 8).func
    monkeypatch.setattr(pa, "array", lambda values, *more: made.append(len(values)) or array(values, *more))
    assert len(run(texts)) == 302 and max(made) <= slices.ROWS


def test_parsers_are_given_their_own_files_only(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tomewright.sources import parsers

    def strict(contents: pa.Array) -> pa.Array:
        assert b"other" not in contents.to_pylist()
        return pa.array(["own" if c is not None else None for c in contents.to_pylist()], pa.string())

    monkeypatch.setattr(parsers, "PARSERS", [parsers.Parser("strict", frozenset({".strict"}), frozenset(), lambda c: F.arrow_udf(strict, "string")(c)), *parsers.PARSERS])
    files = spark.createDataFrame([("a.strict", bytearray(b"x")), ("b.txt", bytearray(b"other"))], "path string, content binary")
    assert {r.path: r.raw_text for r in parsers.parse(files).collect()} == {"a.strict": "own", "b.txt": "other"}
