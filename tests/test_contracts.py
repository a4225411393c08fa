"""Error codes, real tokens, providers and variants of asking, roles, reading over JDBC."""

import asyncio
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.functions import errors, text, tokens
from tomewright.operators import catalog, chunking, embedding, jobs, numbering, rag, resumable, retrieval
from tomewright.sources import connectors, corpus, filters, parsers, sinks
from tomewright.sources.versioned import Store

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def test_codes_are_a_table(spark):
    rows = {r.code: (r.family, r.status) for r in errors.codes(spark).collect()}
    assert len(rows) == len(errors.STATUS) == sum(len(c) for c in errors.CODES.values())
    assert rows["RETRIEVAL_TIMEOUT"] == ("retrieval", 504) and errors.family_of("INVALID_FILE") == "storage"
    shown = spark.createDataFrame([("PERMISSION_DENIED",), ("unheard of",), (None,)], "c string").select(errors.status_of(F.col("c")).alias("s")).collect()
    assert [r.s for r in shown] == [403, 500, 500]
    with pytest.raises(KeyError):
        errors.EngineError("NO_SUCH_CODE", "x")
    with pytest.raises(KeyError):
        errors.failed("NO_SUCH_CODE", "x")
    e = errors.EngineError("RESOURCE_NOT_FOUND", "x", id=3)
    assert e.status == 404 and e.details == {"id": 3} and errors.code_in(f"wrapped: {e} and VALIDATION_ERROR") == "RESOURCE_NOT_FOUND" and errors.code_in("none") == "INTERNAL_SERVER_ERROR"


def test_codes_are_raised_by_columns_and_calls(spark):
    with pytest.raises(Exception, match="RATE_LIMIT_EXCEEDED"):
        spark.range(1).select(F.when(F.col("id") == 0, errors.failed("RATE_LIMIT_EXCEEDED", "slow down")).alias("x")).collect()
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "x" * 1001)], "query_id long, text string")

    def code(f):
        with pytest.raises(errors.EngineError) as e:
            f()
        return e.value.code

    sparse = retrieval.Options(dense_weight=0.0, sparse_weight=1.0)
    broken = lambda *_: 1 / 0
    assert code(lambda: retrieval.search(docs, asked, retrieval.Options(fusion="none"))) == "FUSION_STRATEGY_NOT_FOUND"
    assert code(lambda: retrieval.strategy_of("none")) == "STRATEGY_NOT_FOUND"
    assert code(lambda: retrieval.search(docs, asked, retrieval.Options(dense_weight=0.0, sparse_weight=0.0))) == "VALIDATION_ERROR"
    assert code(lambda: retrieval.search(docs, asked, sparse, strategies={"sparse": broken})) == "SPARSE_RETRIEVAL_ERROR"
    assert code(lambda: retrieval.search(docs, asked, strategies={"dense": broken})) == "DENSE_RETRIEVAL_ERROR"
    retrieval.FUSIONS["broken"] = broken
    try:
        ok = lambda d, q, o, w=None: retrieval.ranked(retrieval.bm25(d, q, o), "x")
        assert code(lambda: retrieval.search(docs, asked, retrieval.Options(fusion="broken"), strategies={"dense": ok, "sparse": ok})) == "FUSION_ERROR"
    finally:
        del retrieval.FUSIONS["broken"]
    good, bad = retrieval.checked_queries(asked)
    assert [r.query_id for r in good.collect()] == [1]
    assert sorted((r.query_id, r.error_code, len(r.preview or "")) for r in bad.collect()) == [(2, "INVALID_SEARCH_QUERY", 1), (3, "INVALID_SEARCH_QUERY", 0), (4, "INVALID_SEARCH_QUERY", 103)]
    assert code(lambda: rag.provider_of("none")) == "RESOURCE_NOT_FOUND" and code(lambda: rag.ask_variant("none", asked, asked)) == "STRATEGY_NOT_FOUND"
    provider = embedding.hashing_provider(8)
    assert code(lambda: embedding.encode_one(provider, " ")) == "EMPTY_EMBEDDING_INPUT"
    assert code(lambda: embedding.encode_one(lambda t: np.zeros((2, 8)), "a")) == "EMBEDDING_INFERENCE_FAILED"


def test_codes_of_sources_chunks_and_jobs(spark, tmp_path):
    with pytest.raises(ValueError, match="UNSUPPORTED_SOURCE"):
        corpus.source("none")
    with pytest.raises(ValueError):
        filters.validate(filters.SourceConfig(""))
    with pytest.raises(Exception, match="ETL_VALIDATION_ERROR"):
        spark.dataSource.register(corpus.FolderSource)
        q = spark.readStream.format("corpus").load(str(tmp_path)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    with pytest.raises(resumable.JobError, match="ETL_VALIDATION_ERROR"):
        resumable.Job(Store(spark, str(tmp_path / "s")), "j", [])
    with pytest.raises(Exception, match="EMBEDDING_DIMENSION_MISMATCH"):
        spark.range(1).select(embedding.require_dimension(F.array(F.lit(1.0).cast("float")), 2)).collect()
    with pytest.raises(ValueError):
        chunking.greedy("sentence", 0)
    files = spark.createDataFrame([("a.exe", b"x", "x"), ("b.txt", b"", "text/plain"), ("c.txt", b"12345", "text/plain")], "filename string, content binary, mime_type string")
    assert {c for r in sinks.stored_files(files, max_bytes=4).collect() for c in r.error_codes} == {"UNSUPPORTED_FILE_TYPE", "INVALID_FILE", "FILE_TOO_LARGE"}
    late = jobs.run_all(spark, {f"p{i}": lambda: time.sleep(2) for i in range(3)}, 0.5)
    assert all(o.error_code == "RETRIEVAL_TIMEOUT" for o in late.values()) and parsers.PARSERS


def test_limits_run_from_a_common_start(spark):
    began = time.monotonic()
    out = jobs.run_all(spark, {f"p{i}": lambda: time.sleep(4) for i in range(4)}, 0.6)
    assert time.monotonic() - began < 2.4 and {o.error_code for o in out.values()} == {"RETRIEVAL_TIMEOUT"}


@pytest.mark.skipif(not os.path.isfile(VOCABULARY), reason="no vocabulary")
def test_tokens_are_counted_and_overlap_by_the_vocabulary(spark):
    texts = ["", None, "One two three, four five. Größe und Maß — naïve 🙂🙂 日本語 text " * 20, "a", "🙂" * 30, "word " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    plain = tokens.tokenizer(VOCABULARY)
    want = [None if t is None else len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [r.n for r in df.select("id", tokens.count_tokens(F.col("t"), VOCABULARY).alias("n")).orderBy("id").collect()] == want
    estimated = [r.n for r in df.select("id", tokens.count_tokens(F.col("t"), "/no/such/file").alias("n")).orderBy("id").collect()]
    assert estimated == [r.n for r in df.select("id", text.count_tokens(F.col("t")).alias("n")).orderBy("id").collect()]
    assert tokens.backend(VOCABULARY) == "bpe" and tokens.backend(None) == "estimate"
    made = df.select("id", F.explode(tokens.windows(VOCABULARY, 16, 5)(F.col("t"))).alias("w")).select("id", "w.*").orderBy("id", "start").collect()
    for i, t in enumerate(texts):
        own = [r for r in made if r.id == i]
        if not t:
            assert not own
            continue
        offsets = plain.encode(t, add_special_tokens=False).offsets
        assert own[0].start == 0 and own[-1].end == len(t) and all(r.text == t[r.start : r.end] and r.tokens <= 16 for r in own)
        for a, b in zip(own, own[1:], strict=False):
            shared = [o for o in offsets if b.start <= o[0] < a.end]
            # Characters of several tokens are not cut, which may add to an overlap or take from it.
            assert a.start < b.start <= a.end and (len(shared) == 5 or any(x[0] < y[1] for x, y in zip(offsets[1:], offsets, strict=False)))
    for bad in ((VOCABULARY, 0, 0), (VOCABULARY, 4, 4), ("/no/such/file", 4, 0)):
        with pytest.raises(ValueError, match="INVALID_CHUNK_CONFIG"):
            tokens.windows(*bad)


def test_one_text_is_embedded_as_in_a_column(spark):
    provider = embedding.hashing_provider(16)
    texts = ["one two two", "three"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    column = [r.v for r in df.select(embedding.encode(provider)(F.col("text")).alias("v")).collect()]
    assert [embedding.encode_one(provider, t) for t in texts] == column

    async def both():
        return await asyncio.gather(embedding.encode_one_async(provider, texts[0]), embedding.encode_batch_async(df, provider))

    one, table = asyncio.run(both())
    assert one == column[0] and table.column("vector").to_pylist() == column


def test_providers_and_variants(spark):
    rag.register_provider(" Broken ", lambda q, c: F.raise_error(F.lit("down")))
    try:
        assert rag.health(spark) == {"extractive": True, "broken": False} and rag.provider_of("BROKEN")
    finally:
        del rag.PROVIDERS["broken"]
    questions = spark.createDataFrame([(1, "where is the red fox")], "query_id long, text string")
    hits = spark.createDataFrame([(1, k, "filler text" if k != 25 else "the red fox is where the hill is") for k in range(1, 41)], "query_id long, rank int, text string")
    found = {v: rag.ask_variant(v, questions, hits).first() for v in rag.VARIANTS}
    assert "red fox is" in found["investigation"].answer and "red fox is" not in found["ask"].answer
    assert rag.ask_investigation(questions, hits).first().answer == found["investigation"].answer
    assert rag.ask_executive_summary(questions, hits).first().prompt[0].content.startswith(rag.STRATEGIES["executive"])


def test_roles_and_previews(spark):
    users = spark.createDataFrame([(1, False, ["a"], ["p"]), (2, True, [], []), (3, None, None, None), (4, False, ["A"], ["P"])], "id int, is_superuser boolean, role_names array<string>, permission_codes array<string>")
    got = users.select("id", catalog.has_role("a").alias("r"), catalog.may("p").alias("m")).orderBy("id").collect()
    assert [(r.r, r.m) for r in got] == [(True, True), (True, True), (False, False), (False, False)]
    shown = spark.createDataFrame([("x" * 100,), ("y" * 101,), (None,)], "t string").select(text.query_preview(F.col("t")).alias("p")).collect()
    assert [r.p for r in shown] == ["x" * 100, "y" * 100 + "...", None]


def test_table_over_jdbc(spark, tmp_path):
    """The database that comes with the engine stands for any other."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(1, 101).select(F.col("id").alias("K"), (F.col("id") * 2).alias("V")).write.format("jdbc").options(url=url, dbtable="T", driver=driver).save()
    rows = connectors.read_table(spark, url, "T", partition_column="K", bounds=(1, 101), partitions=4, driver=driver)
    assert rows.rdd.getNumPartitions() == 4 and rows.where("V > 150").count() == 25 and rows.agg(F.sum("V")).first()[0] == 10100
    assert "PushedFilters: [*IsNotNull(V), *GreaterThan(V,150)]" in rows.where("V > 150")._jdf.queryExecution().toString()


def test_numbers_within_groups_of_any_size(spark):
    rows = [(i, None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 7}", (i * 7919) % 1009) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, g string, k long")
    got = {r.id: r.n for r in numbering.numbered(df, ["g"], ["k", "id"], "n").collect()}
    by: dict = {}
    for i, g, k in rows:
        by.setdefault(g, []).append((k, i))
    assert got == {i: n for own in by.values() for n, (_, i) in enumerate(sorted(own))}
    assert numbering.numbered(df.where("id < 0"), ["g"], ["k"]).collect() == []


def test_shadowed_kinds_and_stopping_streams(spark, tmp_path):
    assert parsers.shadowed() == {}
    parsers.register_parser(parsers.Parser("notes", frozenset({".txt", ".note"}), frozenset({"text/plain"}), text.decode_bytes), prepend=True)
    try:
        assert parsers.shadowed() == {".txt": ["notes", "text"], "text/plain": ["notes", "text"]}
    finally:
        parsers.PARSERS.pop(0)
    query = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path)).start()
    assert query.isActive and jobs.stop(query) in (True, False) and not query.isActive
