"""Lists, totals and lookups of a knowledge base, and relational operations that plans are made of, over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import catalog, chunking, embedding
from ..sources import connectors
from ..streaming import events as ev
from .registry import query, table


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lower("c_name"), F.lit("@x.org")).alias("email"), F.col("c_name").alias("full_name"), F.col("c_name").alias("name"), (F.col("c_custkey") % 3 != 0).alias("is_active"),
        F.lit(True).alias("is_verified"), (F.col("c_custkey") % 50 == 0).alias("is_superuser"), (F.col("c_custkey") % 7 == 0).alias("is_deleted"), F.sha2("c_name", 256).alias("hashed_password"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("last_login_at"),
    )


@query("SELECT c_custkey AS id, concat(lower(c_name), '@x.org') AS email, c_name AS full_name, c_custkey % 50 = 0 AS is_superuser FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 <> 0")
def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT18, PRJ04: users who may log in, as others see them."""
    return catalog.shown(_users(spark, sf_dir).where(catalog.is_active_user())).select("id", "email", "full_name", "is_superuser")


@query("""SELECT 'living' AS list, count(*) AS n FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'all inactive', count(*) FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'named', count(*) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AND contains(lower(c_name), '#00000001')""")
def toggled_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10: filters that are only planned where they are set."""
    users = _users(spark, sf_dir)
    lists = {"living": catalog.toggled(users), "all inactive": catalog.toggled(users, include_deleted=True, is_active=False), "named": catalog.toggled(users, is_active=True, query=" #00000001", columns=("name", "email"))}
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("list"), "n") for name, rows in lists.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3') AND contains(lower(substr(text, 1, 40)), 'th')")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT14: category, statuses and a text in the title."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.col("source").alias("status"), F.substring("text", 1, 40).alias("title"))
    return catalog.document_list(rows, "en", ("src1", "src2", "src3"), " Th ").select("doc_id")


@query("SELECT concat(lower(r_name), ':', lower(n_name)) AS code FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' ORDER BY code")
def permissions_by_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT08, SRT03: the codes of one resource in order; a nation stands for an action, its region for the resource."""
    pairs = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = pairs.select(F.lower("r_name").alias("resource"), F.concat(F.lower("r_name"), F.lit(":"), F.lower("n_name")).alias("code"))
    return catalog.permissions_of(rows, " Asia ").select("code")


_CHUNKS = "(SELECT doc_id AS document_id, CAST(s // 150 AS INTEGER) AS chunk_index, substr(text, s + 1, 200) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, length(text) - 1 - 50), 150)) AS s FROM documents WHERE length(text) > 0))"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(table(spark, sf_dir, "documents"), chunking.fixed(F.col("text"), 200, 50), "doc_id")


@query(f"SELECT chunk_index, sha256(text) AS checksum FROM {_CHUNKS} WHERE document_id = 7 ORDER BY chunk_index")
def chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC26: the chunks of one document in order."""
    return catalog.chunks_of(_chunks(spark, sf_dir), 7).select("chunk_index", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))


@query(f"SELECT c.document_id, c.chunk_index, d.source, d.lang FROM {_CHUNKS} c LEFT JOIN documents d ON d.doc_id = c.document_id AND d.doc_id % 2 = 0")
def chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN03: chunks with their document; every second document is gone here."""
    parents = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").withColumnRenamed("doc_id", "document_id")
    return catalog.with_document(_chunks(spark, sf_dir), parents, "source", "lang").select("document_id", "chunk_index", "source", "lang")


@query(f"SELECT lang, count(*) AS n_chunks FROM {_CHUNKS} c JOIN documents d ON d.doc_id = c.document_id GROUP BY 1")
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG01, AGG08: chunks per document by the library's own totals, then per language."""
    made = _chunks(spark, sf_dir).withColumn("token_count", F.lit(1))
    return chunking.document_totals(made).join(table(spark, sf_dir, "documents"), F.col("document_id") == F.col("doc_id")).groupBy("lang").agg(F.sum("total_chunks").alias("n_chunks"))


@query("SELECT CAST(greatest(1, least(256, floor(32768 / greatest(1.0, avg(length(text)) / 4.0)))) AS INTEGER) AS batch_size FROM documents")
def batch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG07 by the library's own rule."""
    return embedding.batch_size_for(table(spark, sf_dir, "documents").select(F.length("text").alias("n")), "n")


@query("SELECT CAST(count(*) * 32 AS BIGINT) AS total_texts, CAST(sum(32 - doc_id % 3) AS BIGINT) AS successful_embeddings, round(CAST(sum(n_chars) AS DOUBLE), 3) AS latency_ms, round(count(*) * 32 * 1000 / CAST(sum(n_chars) AS DOUBLE), 6) AS throughput_texts_per_sec FROM documents")
def embedding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG09: a document stands for a batch of 32 texts."""
    batches = table(spark, sf_dir, "documents").select(F.lit(32).alias("texts"), (32 - F.col("doc_id") % 3).alias("embedded"), F.col("n_chars").cast("double").alias("latency_ms"))
    found = catalog.embedding_totals(batches)
    return found.select("total_texts", "successful_embeddings", F.round("latency_ms", 3).alias("latency_ms"), F.round("throughput_texts_per_sec", 6).alias("throughput_texts_per_sec"))


@query("""SELECT count(*) AS documents, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, CAST(sum(o_custkey) AS BIGINT) AS total_chunks, round(sum(o_totalprice), 1) AS parsing_duration_ms,
  round(6 * sum(o_totalprice), 1) AS total_duration_ms FROM orders""")
def ingestion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11: an order stands for a report."""
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("RUNNING")
    reports = table(spark, sf_dir, "orders").select(status.alias("status"), *[F.col("o_custkey").alias(c) for c in ("total_chunks", "total_vectors_stored", "token_count")], *[F.col("o_totalprice").alias(f"{s}_duration_ms") for s in catalog.STAGES])
    found = catalog.ingestion_totals(reports)
    return found.select("documents", "completed", "failed", "total_chunks", F.round("parsing_duration_ms", 1).alias("parsing_duration_ms"), F.round("total_duration_ms", 1).alias("total_duration_ms"))


@query("SELECT (SELECT count(*) FROM nation) AS permissions_count, (SELECT count(*) FROM region) AS roles_count")
def seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12."""
    return catalog.seed_counts(permissions=table(spark, sf_dir, "nation"), roles=table(spark, sf_dir, "region"))


@query("SELECT o_orderkey, concat(o_orderpriority, ',', o_orderstatus) AS tags, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS n_tags FROM orders")
def tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as a text and back."""
    joined = labels.joined_tags(F.array("o_orderpriority", "o_orderstatus"))
    back = labels.split_tags(F.when(F.col("o_orderkey") % 2 == 0, joined).otherwise(F.lit("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", joined.alias("tags"), F.size(back).alias("n_tags"))


@query("""SELECT event_id, CASE k WHEN 0 THEN 'QUOTA' WHEN 1 THEN 'API_ERROR' WHEN 2 THEN 'TIMEOUT' WHEN 3 THEN 'NETWORK_ERROR' WHEN 4 THEN 'HTTP_503' WHEN 5 THEN 'CLIENT_ERROR' ELSE 'UNKNOWN_ERROR' END AS code,
  CASE k WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 408 WHEN 4 THEN 503 ELSE 0 END AS status FROM (SELECT event_id, event_id % 7 AS k FROM events)""")
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a failure is called."""
    k = F.col("event_id") % 7
    kind = labels.error_kind(
        F.when(k == 0, 429).when(k == 1, 500).when(k == 4, 503), F.when(k == 0, "QUOTA").when(k == 1, ""), F.when(k == 2, "ECONNABORTED"), k <= 4, k <= 5
    )
    return table(spark, sf_dir, "events").select("event_id", kind.alias("e")).select("event_id", "e.*")


@query("""SELECT CAST(item_id AS VARCHAR) AS question_id, sha256(text) AS question, coalesce(n, 0) AS n_relevant FROM benchmark LEFT JOIN (SELECT doc_id % 40 AS q, count(*) AS n FROM labels WHERE quality = 1 GROUP BY 1) ON q = item_id""")
def evaluation_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC30: items built of questions and relevant pairs."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.sha2(F.col("text").cast("binary"), 256).alias("question"), F.lit(None).cast("string").alias("expected_answer"), F.lit(None).cast("array<string>").alias("tags"))
    relevant = table(spark, sf_dir, "labels").where("quality = 1").select((F.col("doc_id") % 40).cast("string").alias("question_id"), F.col("doc_id").alias("id"))
    return connectors.build_dataset(questions, relevant).select("question_id", "question", F.size("relevant_ids").cast("long").alias("n_relevant"))


@query("SELECT p_partkey, b.band FROM part JOIN (VALUES ('small', 900.0, 1200.0), ('middle', 1200.0, 1600.0), ('large', 1500.0, 1e9)) b(band, low, high) ON p_retailprice >= b.low AND p_retailprice < b.high")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: three rows of bounds go to every task of the scan."""
    bands = spark.createDataFrame([("small", 900.0, 1200.0), ("middle", 1200.0, 1600.0), ("large", 1500.0, 1e9)], "band string, low double, high double")
    p = F.col("p_retailprice")
    return table(spark, sf_dir, "part").join(F.broadcast(bands), (p >= F.col("low")) & (p < F.col("high"))).select("p_partkey", "band")


_SUMS = "count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY"


def _sums(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.grouping_id().alias("level"))


@query(f"SELECT o_orderstatus, o_orderpriority, {_SUMS} CUBE (o_orderstatus, o_orderpriority)")
def orders_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority"))


@query(f"SELECT o_orderstatus, o_orderpriority, {_SUMS} ROLLUP (o_orderstatus, o_orderpriority)")
def orders_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority"))


@query(f"SELECT o_orderstatus, o_orderpriority, {_SUMS} GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def orders_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [F.col("o_orderstatus"), F.col("o_orderpriority")]
    return _sums(table(spark, sf_dir, "orders").groupingSets([[both[0]], [both[1]]], *both))


@query("SELECT DISTINCT o_custkey AS custkey, 'both' AS kind FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT DISTINCT o_custkey, 'only F' FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def customers_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersect and except."""
    orders = table(spark, sf_dir, "orders")
    f, o = (orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("custkey")) for s in ("F", "O"))
    return f.intersect(o).withColumn("kind", F.lit("both")).unionByName(f.subtract(o).withColumn("kind", F.lit("only F")))


@query("SELECT event_id, event_type AS kind, event_type AS kind_again, round(value, 2) AS amount FROM events")
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON scalars: a payload written and read by path and by schema."""
    payload = F.to_json(F.struct(F.struct(F.col("event_type").alias("kind")).alias("e"), F.round("value", 2).alias("amount")))
    rows = table(spark, sf_dir, "events").select("event_id", payload.alias("p"))
    read = F.from_json("p", "e struct<kind:string>, amount double")
    return rows.select("event_id", F.get_json_object("p", "$.e.kind").alias("kind"), read["e"]["kind"].alias("kind_again"), read["amount"].alias("amount"))


@query("SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
def above_brand_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated scalar subquery, which becomes one aggregate and a join."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part_of_subquery")
    return spark.sql("SELECT p_partkey, p_retailprice FROM part_of_subquery p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part_of_subquery q WHERE q.p_brand = p.p_brand)")


@query("SELECT w AS window_start, count(*) AS n_events FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours, one every hour; the same function runs on a stream."""
    return ev.sliding(table(spark, sf_dir, "events"))
