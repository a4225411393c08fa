"""Versioned tables, stored indexes, streams of files, keyed state, resumable jobs, interval joins, sketches, table functions, payloads."""

import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.functions import payloads
from tomewright.operators import chunking, intervals, metric_index, resumable, retrieval, search_index, sketches, table_functions
from tomewright.sources import corpus, filters
from tomewright.sources.versioned import Conflict, Store, bucket_of
from tomewright.streaming import lifecycle


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files_of(store):
    """Data files with their times."""
    root = store.path.removeprefix("file:")
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(f"{root}/data") for n in names if n.endswith(".parquet")}


def test_unit_changes_all_tables_or_none(spark, store):
    a, b = spark.range(5), spark.range(10, 12)
    with store.begin() as unit:
        unit.append("a", a)
        unit.append("b", b)
    held = store.read("a"), store.read("b")
    with pytest.raises(RuntimeError, match="between"), store.begin() as unit:
        unit.append("a", spark.range(100, 101))
        raise RuntimeError("between two writes")
    assert store.version() == 1 and store.read("a").count() == 5 and store.read("b").count() == 2
    before = files_of(store)
    with store.begin() as unit:
        unit.replace("a", spark.range(1))
        unit.append("b", spark.range(3))
        assert unit.read("a").count() == 1 and store.read("a").count() == 5
    assert (store.read("a").count(), store.read("b").count()) == (1, 5)
    # A reader that began with the old version goes on with it, in both tables.
    assert (held[0].count(), held[1].count()) == (5, 2) and (store.read("a", version=1).count(), store.read("b", version=1).count()) == (5, 2)
    assert before.items() <= files_of(store).items()


def test_unit_conflicts_and_follows(spark, store):
    with store.begin() as unit:
        unit.append("a", spark.range(1))
        unit.append("b", spark.range(1))
    first, second, third = store.begin(), store.begin(), store.begin()
    first.append("a", spark.range(2))
    first.commit()
    second.append("b", spark.range(2))
    assert second.commit() == 3
    third.read("a")
    third.append("b", spark.range(2))
    with pytest.raises(Conflict, match="CONFLICT"):
        third.commit()
    assert store.version() == 3 and store.read("a").count() == 3 and store.read("b").count() == 3


def test_version_number_is_given_once(spark, store):
    """Two writers that reach for one number: one gets it, the other goes on to the next."""
    with store.begin() as unit:
        unit.append("a", spark.range(1))
    racing = store.begin()
    racing.append("b", spark.range(1))
    assert not racing._publish(1, {"version": 1, "tables": {}})
    assert racing.commit() == 2 and store.tables() == ["a", "b"]


def test_patch_touches_its_buckets_only(spark, store):
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("flag"), (F.col("id") * 2).alias("v"))
    with store.begin() as unit:
        unit.append("t", rows, ["k"], 16)
    before = files_of(store)
    keys = [3, 77, 10_000]
    with store.begin() as unit:
        unit.patch("t", spark.createDataFrame([(k, "new") for k in keys], "k long, flag string"), ["flag"])
    want = {(k, "new" if k in keys else "old", 2 * k) for k in range(200)}
    assert {tuple(r) for r in store.read("t").collect()} == want
    touched = {r.b for r in spark.createDataFrame([(3,), (77,)], "k long").select(bucket_of(["k"], 16).alias("b")).collect()}
    named = [p["bucket"] for p in store.manifest()["tables"]["t"]["parts"]]
    new = [f for f in files_of(store) if f not in before]
    assert len(named) == len(set(named)) and {int(f.split("_bucket_=")[1].split("/")[0]) for f in new} == touched
    assert before.items() <= files_of(store).items()
    with store.begin() as unit:
        unit.upsert("t", spark.createDataFrame([(3, "up", 1), (3, "up", 1), (500, "in", 2)], "k long, flag string, v long"))
        assert unit.delete("t", spark.createDataFrame([(0,), (1,), (9999,)], "k long")) == 2
    got = {r.k: r.flag for r in store.read("t").collect()}
    assert got[3] == "up" and got[500] == "in" and 0 not in got and len(got) == 199 and store.read("t").count() == 199
    assert store.vacuum(keep=1) > 0 and store.read("t").count() == 199


def corpus_rows(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    return [(i, None if i % 97 == 5 else " ".join(rng.choices(words, weights, k=rng.choice([0, 2, 10, 60, 300])))) for i in range(n)]


def scanned(spark, docs, queries, k):
    found = retrieval.ranked(retrieval.bm25(spark.createDataFrame(docs, "id long, text string"), queries, top=k), "sparse", k)
    return rows_of(found.select("query_id", "id", "score"))


def test_search_index_equals_a_scan_through_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 16)
    monkeypatch.setattr(search_index, "FEW_BLOCKS", 8)
    docs = dict(corpus_rows(500))
    queries = spark.createDataFrame([(1, "w1 w5 w150"), (2, "W0 w0 w3"), (3, "unknown"), (4, None), (5, "w199"), (6, " ".join(f"w{i}" for i in range(40)))], "query_id long, text string")
    index = search_index.opened(spark, spark.createDataFrame(list(docs.items()), "id long, text string"), str(tmp_path / "index"))
    assert rows_of(index.search(queries, 7)) == scanned(spark, list(docs.items()), queries, 7)
    gone = [i for i in docs if i % 3 == 0]
    index.delete(spark.createDataFrame([(i,) for i in [*gone, 10**6]], "id long"))
    for i in gone:
        del docs[i]
    changed = {i: f"w150 w199 new{i} " + "w5 " * (i % 7) for i in list(docs)[:40]} | {1000: "w1 w5 w150", 1001: ""}
    index.add(spark.createDataFrame(list(changed.items()), "id long, text string"))
    docs |= changed
    want = scanned(spark, list(docs.items()), queries, 7)
    assert rows_of(index.search(queries, 7)) == want
    index.compact()
    assert rows_of(index.search(queries, 7)) == want and "gone" not in index.store.tables()


def test_blocks_stay_whole_where_a_join_turns_to_a_broadcast(spark):
    """A join by shuffles in the plan that becomes a broadcast when sizes are known, as in searches of large indexes."""
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    before = {k: spark.conf.get(k, None) for k in settings}

    def runs(batches):
        for table in search_index._runs(batches):
            yield table.select(["block"]).slice(0, 1).to_batches()[0]

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 400_000, 1, 8).select((F.col("id") % 40).alias("block"), "id")
        blocks = spark.range(0, 40, 2).select(F.col("id").alias("block")).where("block < 35")
        found = search_index._by_block(rows.join(blocks, "block", "left_semi")).mapInArrow(runs, "block long").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(r.block for r in found) == list(range(0, 35, 2))


def test_search_index_reads_the_buckets_of_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "PER_BUCKET", 20)
    docs = spark.createDataFrame(corpus_rows(300), "id long, text string")
    index = search_index.opened(spark, docs, str(tmp_path / "index"))
    rows = index.of_terms("postings", ["w7", "w8"])
    want = {r.b for r in spark.createDataFrame([("w7",), ("w8",)], "term string").select(bucket_of(["term"], 15).alias("b")).collect()}
    assert {int(f.split("_bucket_=")[1].split("/")[0]) for f in rows.inputFiles()} == want
    plan = rows._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan
    assert "ReadSchema: struct<term:string,block:bigint,max_tf:int,min_length:int>" in rows.select("block", "term", "max_tf", "min_length")._jdf.queryExecution().toString()


def test_search_index_leaves_blocks_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 8)
    monkeypatch.setattr(search_index, "FEW_BLOCKS", 0)
    docs = [(i, "common " * (1 + i % 3) + ("rare rare rare" if i in (5, 6, 7) else "other words here")) for i in range(400)]
    queries = spark.createDataFrame([(1, "rare common"), (2, "rare")], "query_id long, text string")
    index = search_index.opened(spark, spark.createDataFrame(docs, "id long, text string"), str(tmp_path / "index"))
    work = index.work(queries, 3)
    assert work["scored"] < 0.2 * work["pairs"]
    assert rows_of(index.search(queries, 3)) == scanned(spark, docs, queries, 3)
    with pytest.raises(ValueError, match="INVALID_FILTER"):
        index.strategy()(None, queries, retrieval.Options(), retrieval.vectorstore.Filter().equals("a", 1))


def vectors_of(n, dimension=8, centres=12, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dimension)) * 5
    return [(i, (middle[i % centres] * (1 + i % 3) + rng.normal(size=dimension) * 0.2).astype(np.float32).tolist(), i % 4) for i in range(n)]


def nearest(rows, asked, k, distance):
    out = []
    for q, v in asked:
        v = np.array(v, np.float64)
        scored = []
        for i, u, _ in rows:
            u = np.array(u, np.float64)
            s = float(v @ u) if distance != "euclid" else -float(np.sqrt(((u - v) ** 2).sum()))
            if distance == "cosine":
                if not np.linalg.norm(v) or not np.linalg.norm(u):
                    continue
                s /= np.linalg.norm(v) * np.linalg.norm(u)
            scored.append((-round(s, 6), i))
        out += [(q, i, -s if distance != "euclid" else s, rank) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return out


SHAPE = "id long, vector array<float>, label int"


@pytest.mark.parametrize("distance", metric_index.DISTANCES)
def test_metric_index_is_exact_and_prunes(spark, tmp_path, distance):
    rows = vectors_of(900) + [(900, [0.0] * 8, 1), (901, [0.0] * 8, 1)]
    asked = [(q, rows[q][1]) for q in (0, 1, 17, 333)] + [(99, [0.5] * 8)]
    store = metric_index.VectorStore(spark, str(tmp_path / "v"))
    store.create("c", 8, distance, "label int", n_cells=12)
    queries = spark.createDataFrame(asked, "query_id long, vector array<float>")
    assert store.search("c", queries).collect() == []
    assert store.upsert("c", spark.createDataFrame(rows, SHAPE)) == 902

    def check():
        got = sorted(tuple(r) for r in store.search("c", queries, 5).select("query_id", "id", "score", "rank").collect())
        want = sorted((q, i, s, k) for q, i, s, k in nearest(rows, asked, 5, distance))
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)

    check()
    work = store.work("c", queries.where("query_id < 99"), 5)
    assert work["multiplied"] < 0.4 * work["pairs"]
    # A changed row leaves its cell for another; files of other cells stay as they are.
    before = files_of(store.store)
    rows[3] = (3, [9.0] * 8, 0)
    rows.append((2000, [0.4] * 8, 2))
    store.upsert("c", spark.createDataFrame([rows[3], rows[-1]], SHAPE))
    assert before.items() <= files_of(store.store).items()
    assert store.delete("c", spark.createDataFrame([(17,), (18,), (77_777,)], "id long")) == 2
    rows = [r for r in rows if r[0] not in (17, 18)]
    check()
    store.recell("c")
    check()
    assert store.describe("c") == {"dimension": 8, "distance": distance, "n_cells": 12, "points": len(rows)}
    few = store.search("c", queries, 3, retrieval.vectorstore.Filter().equals("label", 2)).select("query_id", "id").collect()
    want = nearest([r for r in rows if r[2] == 2], asked, 3, distance)
    assert sorted(map(tuple, few)) == sorted((q, i) for q, i, _, _ in want)


def test_metric_index_rejects_with_codes(spark, tmp_path):
    store = metric_index.VectorStore(spark, str(tmp_path / "v"))

    def code(f, *args):
        with pytest.raises(metric_index.VectorError) as e:
            f(*args)
        return e.value.code

    assert code(store.create, "c", 3, "manhattan") == "INVALID_DISTANCE"
    assert code(store.create, "c", 0) == "VECTOR_DIMENSION_MISMATCH"
    assert code(store.describe, "c") == "COLLECTION_NOT_FOUND"
    store.create("c", 3)
    assert code(store.create, "c", 3) == "COLLECTION_EXISTS"
    for bad in ([1.0, 2.0], None, [1.0, None, 2.0], [1.0, float("nan"), 2.0]):
        assert code(store.upsert, "c", spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, bad)], "id long, vector array<float>")) == "VECTOR_DIMENSION_MISMATCH"
    assert code(store.upsert, "c", spark.createDataFrame([(1, [1.0, 2.0, 3.0])] * 2, "id long, vector array<float>")) == "REPEATED_ID"
    assert store.describe("c")["points"] == 0
    store.upsert("c", spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, vector array<float>"))
    assert code(store.search, "c", spark.createDataFrame([(1, [1.0])], "query_id long, vector array<float>")) == "VECTOR_DIMENSION_MISMATCH"
    store.recreate("c", 2, "dot")
    assert store.describe("c")["dimension"] == 2 and store.drop("c") and not store.drop("c")


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_stream_of_files_gives_each_file_once(spark, tmp_path):
    folder, log, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "checkpoint")
    for i in range(5):
        put(folder, f"a/{i}.md", f"text {i}")
    put(folder, "skip.exe", "x")
    seen, sizes = [], []

    def sink(batch, _):
        own = [(r.path, bytes(r.content).decode()) for r in batch.select("path", "content").collect()]
        seen.extend(own)
        sizes.append(len(own))

    config = filters.SourceConfig(str(folder))
    kept = lambda: corpus.load(spark, config).select("path", "content")
    corpus.drain(corpus.stream(spark, config, log, max_files=2), sink, checkpoint)
    assert sorted(seen) == sorted((r.path, bytes(r.content).decode()) for r in kept().collect()) and max(sizes) <= 2
    # New files, one with an old time, one written anew.
    old = put(folder, "b/old.md", "old")
    os.utime(old, (1, 1))
    put(folder, "b/_new.md", "new")
    put(folder, "a/1.md", "text 1 again")
    before = len(seen)
    corpus.drain(corpus.stream(spark, config, log, max_files=2), sink, checkpoint)
    assert sorted(seen[before:]) == [("a/1.md", "text 1 again"), ("b/_new.md", "new"), ("b/old.md", "old")]
    before = len(seen)
    assert corpus.drain(corpus.stream(spark, config, log, max_files=2), sink, checkpoint) == 0 and len(seen) == before


def test_shared_stream_agrees_with_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    for i in range(4):
        put(folder, f"{i % 2}/{i}.txt", f"text {i}")
    config = filters.SourceConfig(str(folder))
    seen = []
    corpus.drain(corpus.shared_stream(spark, config, 3), lambda batch, _: seen.extend(r.path for r in batch.collect()), str(tmp_path / "c"))
    assert sorted(seen) == sorted(r.path for r in corpus.shared(spark, config).collect()) and len(seen) == 4


def events_of(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((f"e{i:05d}", rng.choice("abcde"), 1_700_000_000 + rng.randrange(0, 200_000), rng.choice(["DocumentUploaded", "DocumentParsed", "DocumentChunked", "IngestionCompleted", "IngestionFailed"] + ["EmbeddingsGenerated"] * 3)))
    return rows


def test_stream_of_runs_equals_the_windows(spark, tmp_path):
    """Events out of order within the watermark's delay, ties of time, timeouts between and within batches."""
    rows = sorted(events_of(300, 8), key=lambda r: (r[2] + random.Random(r[0]).randrange(3000), r[0]))
    rows += [("x1", "a", rows[0][2], "DocumentParsed"), ("zz", "last", 1_701_000_000, "DocumentUploaded")]
    rows.insert(5, rows.pop(-2))
    machine = lifecycle.Machine(timeout_seconds=5000)
    shape = "event_id string, document_id string, s long, event_type string"
    made = lambda part: spark.createDataFrame(part, shape).withColumn("occurred_at", F.timestamp_seconds("s")).drop("s")
    source, out = str(tmp_path / "events"), []
    for begin in range(0, len(rows), 60):
        made(rows[begin : begin + 60]).coalesce(1).write.mode("append").parquet(source)
    for k, v in lifecycle.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        # One file a batch, in the order written: each is older than the next.
        names = sorted((f for f in os.listdir(source) if f.endswith(".parquet")), key=lambda f: os.stat(f"{source}/{f}").st_mtime_ns)
        for i, f in enumerate(names):
            os.utime(f"{source}/{f}", (1_000_000 + i, 1_000_000 + i))
        stream = spark.readStream.schema(made(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = lifecycle.stream_runs(stream, machine, "document_id", "occurred_at", "event_id", "event_type", "2 hours")
        query = found.writeStream.foreachBatch(lambda batch, _: out.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k in lifecycle.STATE_STORE:
            spark.conf.unset(k)
    want = [tuple(r) for r in lifecycle.runs(made(rows).where("document_id <> 'last'"), machine, "document_id", "occurred_at", "event_id", "event_type").collect()]
    assert sorted(out, key=str) == sorted(want, key=str)
    assert {r[-1] for r in out} == {"completed", "failed", "timed out"} and len(query.recentProgress) > 3


def test_job_goes_on_where_it_stopped(spark, tmp_path, store):
    source = str(tmp_path / "source")
    spark.range(10).write.parquet(source)
    ran, broken = [], [True]

    def first(df):
        ran.append("first")
        return df.withColumn("v", F.col("id") * 2)

    def second(df):
        ran.append("second")
        return df.withColumn("w", F.assert_true(F.col("id") < 5, "killed in the middle").cast("string") if broken[0] else F.lit("w"))

    def third(df):
        ran.append("third")
        return df.where("v > 4")

    def job(settings=None):
        return resumable.Job(store, "j", [resumable.Stage("first", first), resumable.Stage("second", second, settings or {}), resumable.Stage("third", third)])

    with pytest.raises(resumable.JobError) as e:
        job().run(spark.read.parquet(source))
    assert e.value.code == "ETL_JOB_EXECUTION_ERROR" and ran == ["first", "second"]
    assert [(r.stage, r.status) for r in job().states().collect()] == [("first", "done"), ("second", "failed")]
    assert "j__second" not in store.tables() and resumable.output(spark, store, "j", "first").count() == 10
    broken[0] = False
    again = job()
    assert again.run(spark.read.parquet(source)).count() == 7 and again.ran == ["second", "third"] and ran.count("first") == 1
    # Nothing has changed: nothing runs. Other settings: from that stage on. Other input: all.
    assert again.run(spark.read.parquet(source)).count() == 7 and again.ran == []
    other = job({"n": 2})
    other.run(spark.read.parquet(source))
    assert other.ran == ["second", "third"]
    spark.range(100, 103).write.mode("append").parquet(source)
    assert other.run(spark.read.parquet(source)).count() == 10 and other.ran == ["first", "second", "third"]
    assert [r.rows for r in other.states().collect()] == [13, 13, 10]
    with pytest.raises(resumable.JobError, match="ETL_JOB_NOT_FOUND"):
        resumable.output(spark, store, "j", "fourth")


def test_job_is_cancelled(spark, tmp_path, store):
    source = str(tmp_path / "source")
    spark.range(4).write.parquet(source)
    begun = threading.Event()

    def slow(df):
        begun.set()
        return df.mapInPandas(_sleeping, "id long")

    job = resumable.Job(store, "slow", [resumable.Stage("one", slow)])
    stopper = threading.Thread(target=lambda: (begun.wait(20), threading.Event().wait(3), job.cancel()))
    stopper.start()
    with pytest.raises(resumable.JobError) as e:
        job.run(spark.read.parquet(source))
    stopper.join()
    assert e.value.code == "ETL_JOB_CANCELLED" and [r.status for r in job.states().collect()] == ["cancelled"]


def _sleeping(parts):
    import time

    time.sleep(30)
    yield from parts


@pytest.mark.parametrize("heavy", [3, 100_000])
def test_interval_join_equals_brute_force(spark, heavy):
    rng = random.Random(6)
    points = [(i, rng.choice([rng.uniform(-50, 150), 7.0, 8.25])) for i in range(300)] + [(1000, None)]
    bounds = [(j, low := rng.uniform(-60, 140), low + rng.choice([0, 0.01, 0.5, 3, 40, 500])) for j in range(120)] + [(500, 7.0, 8.25), (501, None, 3.0), (502, 5.0, 1.0), (503, -1e9, 1e9)]
    p, i = spark.createDataFrame(points, "id long, x double"), spark.createDataFrame(bounds, "id long, low double, high double")
    found = intervals.interval_join(p, i.withColumnRenamed("id", "iv"), "x", "low", "high", heavy=heavy)
    want = sorted((a, b) for a, x in points for b, low, high in bounds if x is not None and low is not None and low <= x < high)
    assert sorted((r.id, r.iv) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.interval_join(p, i.where("id < 0").withColumnRenamed("id", "iv"), "x", "low", "high").collect() == []


@pytest.mark.parametrize("heavy", [1_000_000, 20])
@pytest.mark.parametrize("kind", ["long", "double", "timestamp"])
def test_interval_totals_equal_brute_force(spark, kind, heavy):
    """Many ranges, intervals over several of them, places that repeat, nulls, keys that repeat, whole numbers and times to the digit."""
    rng = random.Random(5)
    points = [(i, rng.choice([None, rng.randint(0, 300)]) if i % 9 == 0 else rng.randint(0, 300), None if i % 7 == 0 else i % 13 - 6.5) for i in range(500)]
    spans = [(k % 150, a, a + rng.choice([0, 1, 5, 60, 400])) for k in range(200) for a in [rng.randint(-50, 320)]] + [(151, None, 3), (152, 400, 500)]
    change = {"timestamp": lambda c: F.timestamp_micros(c + (1 << 50))}.get(kind, lambda c: c.cast(kind))
    p = spark.createDataFrame(points, "id long, at long, v double").withColumn("at", change(F.col("at")))
    s = spark.createDataFrame(spans, "k long, low long, high long").withColumns({c: change(F.col(c)) for c in ("low", "high")})
    want = []
    for k in range(153):
        own = [(i, v) for key, a, b in spans if key == k and a is not None for i, at, v in points if at is not None and a <= at < b]
        if own:
            values = [v for _, v in own if v is not None]
            want.append((k, len(own), sum(values) if values else None, min(i for i, _ in own)))
    found = intervals.interval_totals(p, s, "k", "at", "low", "high", "v", "id", size=10, heavy=heavy)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert intervals.interval_totals(p.limit(0), s, "k", "at", "low", "high", "v", "id").count() == 0
    assert intervals.interval_totals(p, s.limit(0), "k", "at", "low", "high", "v", "id").count() == 0


def test_sketches_merge_within_their_errors(spark):
    rng = random.Random(2)
    rows = [(f"2024-01-{1 + i % 20:02d}", "ab"[i % 2], rng.randrange(5000), rng.gauss(0, 1)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "day string, kind string, user long, value double").withColumn("at", F.col("day").cast("timestamp"))
    days = sketches.daily(df, "at", ["kind"], "user", "value")
    whole = sketches.estimates(sketches.merged(days, "kind"), 0.1, 0.5, 0.9)
    for r in whole.collect():
        own = [x for x in rows if x[1] == r.kind]
        users, values = len({x[2] for x in own}), np.sort([x[3] for x in own])
        assert r.n == len(own) and abs(r.distinct_estimate / users - 1) < 4 * sketches.distinct_error()
        for q, at in ((0.1, r.q10), (0.5, r.q50), (0.9, r.q90)):
            assert abs(np.searchsorted(values, at) / len(values) - q) < sketches.rank_error() + 0.001
    plan = whole._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "distinct " not in plan.replace("distinct_", "")


def test_chunks_as_a_table_function(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1, "abcdefghij" * 30), (2, ""), (3, None), (4, "One. Two!\n\nThree four.")], "id long, t string").createOrReplaceTempView("texts_of_chunk")
    got = rows_of(spark.sql("SELECT id, c.* FROM texts_of_chunk, LATERAL chunk(t, 'fixed', 100, 20) c"))
    want = rows_of(chunking.chunks(spark.table("texts_of_chunk"), chunking.fixed(F.col("t"), 100, 20), "id"))
    assert got == want and len(got) > 4
    named = rows_of(spark.sql("SELECT id, c.* FROM texts_of_chunk, LATERAL chunk(t, 'sentence', 8) c"))
    assert named == rows_of(chunking.chunks(spark.table("texts_of_chunk"), chunking.greedy("sentence", 8)(F.col("t")), "id"))
    for bad in ("t, 'none', 10", "t, 'fixed', 0", "t, 'fixed', 5, 5", "id, 'fixed', 5", "t, t, 5", "t, 'sentence', 5, 1"):
        with pytest.raises(Exception, match="INVALID_CHUNK_CONFIG"):
            spark.sql(f"SELECT c.* FROM texts_of_chunk, LATERAL chunk({bad}) c").collect()


def test_payloads_as_variant(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": [1, 2]}, "n": 5}'), (2, '{"n": "x"}'), (3, "{"), (4, None), (5, "[1]"), (6, '"t"')], "id long, raw string")
    good, bad = payloads.parsed(rows, "raw")
    assert [(r.id, r.error_code) for r in bad.collect()] == [(3, "MALFORMED_PAYLOAD")]
    read = good.select("id", payloads.value("payload", "$.a.b[1]", "int", -1).alias("b"), payloads.value("payload", "$.n", "int").alias("n"), payloads.kind_of("payload").alias("kind")).orderBy("id").collect()
    assert [(r.id, r.b, r.n) for r in read] == [(1, 2, 5), (2, -1, None), (4, -1, None), (5, -1, None), (6, -1, None)]
    shape = payloads.schema(good.where("id IN (1, 2)")).first()
    assert shape.n_payloads == 2 and "a: OBJECT<b: ARRAY<BIGINT>>" in shape.shape and "n: VARIANT" in shape.shape
