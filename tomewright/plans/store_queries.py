"""Queries over stored structures: search index, metric index, versioned tables; interval joins, sketches, table functions, payloads, runs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payloads, text
from ..operators import catalog, embedding, evaluation, intervals, metric_index, retrieval, search_index, sketches, table_functions
from ..sources.versioned import Store, fingerprint, shared_folder
from ..streaming import lifecycle
from . import retrieval_queries
from .registry import query, table
from .text_queries import _FIXED_SQL


#: Changes with the form of what is stored, so that older stores are not opened.
FORMAT = "2"


def _folder(spark: SparkSession, kind: str, *sources: DataFrame) -> str:
    """Where what is made of some tables is stored; other files have another folder."""
    name = hashlib.sha256("\n".join([FORMAT, *[fingerprint(s) for s in sources]]).encode()).hexdigest()[:32]
    return f"{shared_folder(spark)}/stores/{kind}-{name}"


def search_store(spark: SparkSession, sf_dir: str) -> search_index.SearchIndex:
    """The index of all documents, made once per state of the table."""
    docs = retrieval_queries.corpus(spark, sf_dir).select("id", "text")
    return search_index.opened(spark, docs, _folder(spark, "search", docs))


@query(retrieval_queries._BM25 + "SELECT query_id, id, score FROM sparse WHERE rank <= 10")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET02, AGG15: benchmark passages as queries against the stored index of all documents."""
    return search_store(spark, sf_dir).search(retrieval_queries.questions(spark, sf_dir), 10)


@query(retrieval_queries._BM25 + retrieval_queries._HYBRID.replace("QUALIFY rank <= 20", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(0.5 / (60 + rank)), 8) DESC, id) <= 20"))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET01-RET07, EMB01: hashed embeddings and BM25, fused by rank, through the facade over the stored index."""
    encode = embedding.encode(embedding.hashing_provider())
    d = retrieval_queries.corpus(spark, sf_dir).withColumn("vector", encode(F.col("text")))
    q = retrieval_queries.questions(spark, sf_dir).withColumn("vector", encode(F.col("text")))
    return retrieval.search(d, q, strategies={"sparse": search_store(spark, sf_dir).strategy()}).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query(retrieval_queries._BM25 + """, rel AS (SELECT item_id AS query_id, d.doc_id AS id FROM benchmark JOIN labels d ON d.doc_id % 40 = item_id % 40 AND d.quality = 1),
  n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
  hits AS (SELECT s.query_id, s.rank, CASE WHEN r.id IS NULL THEN 0 ELSE 1 END AS rel FROM (SELECT * FROM sparse WHERE rank <= 10) s LEFT JOIN rel r ON r.query_id = s.query_id AND r.id = s.id),
  per AS (SELECT query_id, sum(rel) AS found, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1)) AS dcg FROM hits GROUP BY 1)
  SELECT n.query_id, round(coalesce(found, 0) / 10, 6) AS precision, round(coalesce(found, 0) / n.n, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr,
    round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n.n) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, CASE WHEN coalesce(found, 0) > 0 THEN 1 ELSE 0 END AS hit
  FROM n LEFT JOIN per USING (query_id)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16 over BM25 results with labelled documents as relevant ones."""
    found = retrieval.ranked(search_store(spark, sf_dir).search(retrieval_queries.questions(spark, sf_dir), 10), "sparse", 10)
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("slot"))
    rel = retrieval_queries.questions(spark, sf_dir).select("query_id", (F.col("query_id") % 40).alias("slot")).join(good, "slot").select("query_id", "id")
    return evaluation.retrieval_metrics(found, rel, 10)


@query(retrieval_queries._BM25.replace("FROM documents", "FROM kept").replace("WITH toks", "WITH kept AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN concat(text, ' ', source, ' added words') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0), toks") + "SELECT query_id, id, score FROM sparse WHERE rank <= 5")
def bm25_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after every seventh document has been deleted and every eleventh one updated, statistics included."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    index = search_index.SearchIndex(spark, _folder(spark, "changed", docs))
    steps = [lambda: index.add(docs.select("id", "text")), lambda: index.delete(docs.where("id % 7 = 0").select("id")), lambda: index.add(docs.where("id % 11 = 0 AND id % 7 <> 0").select("id", F.concat("text", F.lit(" "), "source", F.lit(" added words")).alias("text")))]
    # Each step is one version, so what a stopped run has done is not done again.
    for step in steps[index.store.version() :]:
        step()
    return index.search(retrieval_queries.questions(spark, sf_dir), 5)


_ROWS = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_DISTANCE_SQL = {
    "cosine": "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x))))",
    "dot": "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))",
    "euclid": "sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))))",
}


def _nearest(distance: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("float")).alias("vector"), "label")
        store = metric_index.VectorStore(spark, _folder(spark, f"vectors-{distance}", rows))
        if not store.exists("rows"):
            store.create("rows", rows.select(F.max(F.size("vector"))).first()[0] or 1, distance, "label int")
        if not store.describe("rows")["points"]:
            store.upsert("rows", rows)
        return store.search("rows", rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 10)

    run.__name__ = f"nearest_{distance}"
    run.__doc__ = f"SNK04, JN11: the ten nearest by {distance} from the cells of a metric index, exactly."
    order = "score ASC" if distance == "euclid" else "score DESC"
    query(f"SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_DISTANCE_SQL[distance]}, 6) AS score FROM {_ROWS} a, {_ROWS} b WHERE a.vec_id % 20 = 0)) WHERE rank <= 10")(run)


for _distance in metric_index.DISTANCES:
    _nearest(_distance)


@query("SELECT c_custkey AS custkey, CASE WHEN c_custkey % 9 = 0 THEN 'gold' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 9 = 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT -1 - c_custkey, 'new', 1.0 FROM customer WHERE c_custkey % 100 = 0")
def patch_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10, SNK13: flags of some rows patched and new rows seeded, in one unit over a table in buckets; unknown keys stay out of the patch."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    store = Store(spark, _folder(spark, "customers", customers))
    if store.version() < 1:
        with store.begin() as unit:
            unit.append("customers", customers, ["custkey"], 16)
    if store.version() < 2:
        marked = customers.where("custkey % 9 = 0")
        with store.begin() as unit:
            unit.patch("customers", marked.unionByName(marked.withColumn("custkey", F.col("custkey") + 1_000_000_000)).withColumns({"segment": F.lit("gold"), "balance": F.lit(0.0)}), ["segment", "balance"])
            unit.upsert("customers", customers.where("custkey % 100 = 0").select((-1 - F.col("custkey")).alias("custkey"), F.lit("new").alias("segment"), F.lit(1.0).alias("balance")))
    return store.read("customers", version=2)


@query("""SELECT o_orderkey AS orderkey, count(*) AS n_events, round(sum(value), 4) AS sum_value, min(event_id) AS first_event FROM
  (SELECT o_orderkey, TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey % 43200 AS INTEGER)) AS low, TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey % 43200 + CASE WHEN o_orderkey % 50 = 0 THEN 1440 ELSE o_custkey % 60 END AS INTEGER)) AS high FROM orders) o
  JOIN events e ON e.ts >= o.low AND e.ts < o.high GROUP BY 1""")
def events_within_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over intervals: events in a window per order, of none to sixty minutes or a day."""
    start = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("o_orderkey") % 43200 * 60_000_000)
    minutes = F.when(F.col("o_orderkey") % 50 == 0, F.lit(1440)).otherwise(F.col("o_custkey") % 60)
    windows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), start.alias("low"), F.timestamp_micros(F.unix_micros(start) + minutes * 60_000_000).alias("high"))
    found = intervals.interval_totals(table(spark, sf_dir, "events"), windows, "orderkey", "ts", "low", "high", "value", "event_id")
    return found.select("orderkey", F.col("n").alias("n_events"), F.round("total", 4).alias("sum_value"), F.col("first").alias("first_event"))


@query("SELECT event_type, date_trunc('week', ts)::DATE AS week, count(*) AS n, count(DISTINCT user_id) AS exact_users, true AS users_near, true AS median_near FROM events GROUP BY ALL")
def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per day merged to weeks: users within four standard errors of the exact count, the median within its error of rank."""
    events = table(spark, sf_dir, "events")
    weekly = sketches.estimates(sketches.merged(sketches.daily(events, "ts", ["event_type"], "user_id", "value"), "event_type", F.to_date(F.date_trunc("week", "day")).alias("week")), 0.5)
    week = F.to_date(F.date_trunc("week", "ts"))
    exact = events.groupBy("event_type", week.alias("week")).agg(F.count_distinct("user_id").alias("exact_users"))
    below = events.select("event_type", week.alias("week"), "value").join(weekly.select("event_type", "week", "q50"), ["event_type", "week"]).groupBy("event_type", "week").agg(F.avg((F.col("value") <= F.col("q50")).cast("double")).alias("rank"), F.avg((F.col("value") < F.col("q50")).cast("double")).alias("strict"))
    near = F.abs(F.col("distinct_estimate") - F.col("exact_users")) <= F.greatest(F.lit(1.0), 4 * sketches.distinct_error() * F.col("exact_users"))
    error = sketches.rank_error() + 1 / F.col("n")
    middle = (F.col("strict") <= 0.5 + error) & (F.col("rank") >= 0.5 - error)
    return weekly.join(exact, ["event_type", "week"]).join(below, ["event_type", "week"]).select("event_type", "week", "n", "exact_users", near.alias("users_near"), middle.alias("median_near"))


@query(f"SELECT document_id, chunk_index, start_offset, end_offset, sha256(text) AS checksum FROM ({_FIXED_SQL})")
def lateral_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension surface: chunks as a table function of SQL, in a lateral join."""
    table_functions.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents_of_chunks")
    return spark.sql("SELECT doc_id AS document_id, c.chunk_index, c.start_offset, c.end_offset, sha2(CAST(c.text AS BINARY), 256) AS checksum FROM documents_of_chunks, LATERAL chunk(text, 'fixed', 200, 50) c")


@query("""SELECT event_id, kind, k, CASE kind WHEN 2 THEN k + 1 WHEN 3 THEN NULL ELSE k END AS read, CASE WHEN kind = 2 THEN event_type ELSE 'none' END AS name, code FROM (
  SELECT event_id, event_type, CAST(event_id % 5 AS INTEGER) AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 5 = 4 THEN 'MALFORMED_PAYLOAD' END AS code FROM events) WHERE kind <> 4
  UNION ALL SELECT event_id, 4, CAST(json_extract(props, '$.k') AS INTEGER), NULL, NULL, 'MALFORMED_PAYLOAD' FROM events WHERE event_id % 5 = 4""")
def variant_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of five shapes as VARIANT, read by path and type with a default; malformed ones rejected with a code."""
    kind = (F.col("event_id") % 5).cast("int")
    k = F.get_json_object("props", "$.k").cast("int")
    nested = F.to_json(F.struct(F.struct(F.array(k, k + 1).alias("list"), F.col("event_type").alias("name")).alias("e")))
    raw = F.when(kind == 2, nested).when(kind == 3, F.lit('{"k": "not a number"}')).when(kind == 4, F.concat(F.lit("{"), "props")).when(kind == 1, F.concat(F.lit('{"k": "'), k.cast("string"), F.lit('"}'))).otherwise(F.col("props"))
    good, bad = payloads.parsed(table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), k.alias("k"), raw.alias("raw")), "raw")
    read = F.when(F.col("kind") == 2, payloads.value("payload", "$.e.list[1]", "int")).otherwise(payloads.value("payload", "$.k", "int"))
    shown = good.select("event_id", "kind", "k", read.alias("read"), payloads.value("payload", "$.e.name", "string", "none").alias("name"), F.lit(None).cast("string").alias("code"))
    return shown.unionByName(bad.select("event_id", "kind", "k", F.lit(None).cast("int").alias("read"), F.lit(None).cast("string").alias("name"), F.col("error_code").alias("code")))


#: Kinds of the events table as stages of a run.
MACHINE = lifecycle.Machine(("signup", "view", "click", "purchase"), ("purchase",), ("error",), 6 * 3600)


@query("""WITH e AS (SELECT *, lag(ts) OVER w AS before, lag(event_type) OVER w AS kind_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS place, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR OR kind_before IN ('purchase', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
  b AS (SELECT *, coalesce(lag(place) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) > place, false) AS back FROM n),
  r AS (SELECT user_id, run, min(ts) AS run_start, max(ts) AS last, count(*) AS n_events, max(place) AS reached, count(*) FILTER (back) AS n_back, arg_max(event_type, (ts, event_id)) AS kind FROM b GROUP BY ALL)
  SELECT user_id, run_start, CASE WHEN kind IN ('purchase', 'error') THEN last ELSE last + INTERVAL 6 HOUR END AS run_end, n_events, CAST(reached AS INTEGER) AS reached, n_back, CASE kind WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'timed out' END AS status FROM r""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful events: runs of each user through their stages; the stream with keyed state and timers gives the same rows."""
    return lifecycle.runs(table(spark, sf_dir, "events"), MACHINE, "user_id", "ts", "event_id", "event_type")



@query("SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '...') ELSE text END AS preview FROM conversations WHERE role = 'user'")
def query_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users asked, as messages show it."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.query_preview(F.col("text")).alias("preview"))


@query("SELECT c_custkey AS user_id, c_custkey % 50 = 0 OR n_name = 'JAPAN' AS in_japan, c_custkey % 50 = 0 OR r_name = 'ASIA' AS may_read FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def role_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT17: roles and permissions with the superusers' bypass; a nation stands for a role and its region for a permission."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    users = table(spark, sf_dir, "customer").join(places, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 50 == 0).alias("is_superuser"), F.array("n_name").alias("role_names"), F.array("r_name").alias("permission_codes"))
    return users.select("user_id", catalog.has_role("JAPAN").alias("in_japan"), catalog.may("ASIA").alias("may_read"))


@query("SELECT n_nationkey AS role_id, lower(n_name) AS name FROM nation WHERE n_regionkey <> 0 AND n_nationkey % 4 <> 0 ORDER BY name")
def system_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT02: roles of the system that are not deleted, by name."""
    roles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("role_id"), F.lower("n_name").alias("name"), (F.col("n_regionkey") != 0).alias("is_system"), (F.col("n_nationkey") % 4 == 0).alias("is_deleted"))
    return catalog.system_roles(roles).select("role_id", "name")
