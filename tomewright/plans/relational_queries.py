"""Relational bookkeeping and events over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import catalog
from ..streaming import events as ev
from ..streaming import schedule as sch
from .registry import query, table


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'PROCESSING' WHEN 'P' THEN 'UPLOADED' ELSE 'FAILED' END AS status, CASE WHEN o_orderstatus = 'F' THEN 'INCIDENT_REPORT' WHEN o_orderstatus = 'O' THEN 'RUNBOOK' ELSE 'OTHER' END AS category FROM orders")
def status_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ02, PRJ03: old values to new ones."""
    old = F.when(F.col("o_orderstatus") == "F", "INCIDENT_POSTMORTEM").when(F.col("o_orderstatus") == "O", "RUNBOOK").otherwise("unheard of")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "READY").when(F.col("o_orderstatus") == "O", "PROCESSING").when(F.col("o_orderstatus") == "P", "UPLOADED").otherwise("FAILED").alias("status"), labels.category(old).alias("category"))


_RBAC_SQL = """
  WITH ur AS (SELECT DISTINCT o_custkey AS user_id, l_suppkey % 12 AS role_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
  roles AS (SELECT i AS role_id, concat('role', i) AS name, i % 4 = 3 AS is_deleted FROM range(12) t(i)),
  rp AS (SELECT r.i AS role_id, p.i AS permission_id FROM range(12) r(i), range(20) p(i) WHERE (r.i * 7 + p.i * 3) % 5 = 0),
  perms AS (SELECT i AS permission_id, concat('res', i % 4, ':act', i) AS code FROM range(20) t(i))
"""


def _rbac(spark: SparkSession, sf_dir: str):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 12).alias("role_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    user_roles = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("user_id", "role_id").distinct()
    roles = spark.range(12).select(F.col("id").alias("role_id"), F.concat(F.lit("role"), F.col("id").cast("string")).alias("name"), (F.col("id") % 4 == 3).alias("is_deleted"))
    pairs = spark.range(12).select(F.col("id").alias("role_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("permission_id"))
    perms = spark.range(20).select(F.col("id").alias("permission_id"), F.concat(F.lit("res"), (F.col("id") % 4).cast("string"), F.lit(":act"), F.col("id").cast("string")).alias("code"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 50 == 0).alias("is_superuser"))
    return users, user_roles, roles, pairs.where("(role_id * 7 + permission_id * 3) % 5 = 0"), perms


@query(_RBAC_SQL + """, held AS (SELECT ur.user_id, r.name, p.code FROM ur JOIN roles r ON r.role_id = ur.role_id AND NOT r.is_deleted LEFT JOIN rp ON rp.role_id = r.role_id LEFT JOIN perms p ON p.permission_id = rp.permission_id)
  SELECT c_custkey AS user_id, coalesce(roles, '') AS roles, coalesce(codes, '') AS codes, (c_custkey % 50 = 0 OR coalesce(may, false)) AS may_read FROM customer LEFT JOIN (
    SELECT user_id, array_to_string(list_sort(list_distinct(list(name))), ',') AS roles, array_to_string(list_sort(list_distinct(list(code) FILTER (code IS NOT NULL))), ',') AS codes, coalesce(bool_or(code = 'res0:act4'), false) AS may FROM held GROUP BY 1) ON user_id = c_custkey""")
def rbac_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN01-JN04, AGG05, AGG06, SET01, FLT17: names and codes of a user's living roles."""
    found = catalog.user_permissions(*_rbac(spark, sf_dir))
    return found.select("user_id", F.array_join("role_names", ",").alias("roles"), F.array_join("permission_codes", ",").alias("codes"), catalog.may("res0:act4").alias("may_read"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG04, LIM01, LIM02, SRT06: a page in a chosen order with the grand total."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return catalog.page(rows, [catalog.sort_column("o_totalprice", True, ("o_totalprice", "o_orderkey")), F.col("o_orderkey")], 50, 25)


@query("SELECT n, skip, CAST(skip // 20 + 1 AS BIGINT) AS current_page, CAST(greatest(1, ceil(n / 20)) AS BIGINT) AS total_pages, CASE WHEN n = 0 THEN 0 ELSE skip + 1 END AS start_item, least(n, skip + 20) AS end_item FROM (SELECT count(*) AS n, CAST(c_nationkey AS BIGINT) AS skip FROM customer GROUP BY c_nationkey)")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIM06."""
    base = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("skip")).agg(F.count(F.lit(1)).alias("n"))
    return base.select("n", "skip", catalog.page_numbers(F.col("n"), F.col("skip"), F.lit(20)).alias("p")).select("n", "skip", "p.*")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def soft_delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT09, SNK11, JN07: living rows that have a match."""
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(False).alias("is_deleted"), F.lit(None).cast("timestamp").alias("deleted_at"))
    kept = catalog.alive(catalog.soft_delete(users, F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp")))
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.exists(kept, keys, "c_custkey").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 6 = 3")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN08, SNK10: rows whose key is not there yet."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return catalog.insert_if_absent(base.where("c_custkey % 2 = 0"), base.where("c_custkey % 3 = 0").withColumn("c_name", F.lit("new")), "c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK02, SNK12: children of parents that went."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return catalog.cascade(gone, table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT c_mktsegment, count(*) AS n_all, count(*) FILTER (c_acctbal >= 0) AS n_alive, bool_or(c_acctbal > 9000) AS any_rich FROM customer GROUP BY 1")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG01-AGG03."""
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("c_acctbal") >= 0).alias("n_alive"), F.bool_or(F.col("c_acctbal") > 9000).alias("any_rich"))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 5 OR p_size > 40 THEN 'p_size' END, CASE WHEN p_retailprice > 1500 THEN 'p_retailprice' END) AS errors FROM part WHERE p_size < 5 OR p_size > 40 OR p_retailprice > 1500")
def reject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT19-FLT21: rows that break rules, with the rules' names."""
    _, bad = catalog.split_rejects(table(spark, sf_dir, "part"), catalog.range_violations(p_size=(5, 40), p_retailprice=(None, 1500)))
    return bad.select("p_partkey", F.array_join("error_codes", ",").alias("errors"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building' AND c_name = trim(c_name)")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT05-FLT08."""
    return table(spark, sf_dir, "customer").where(catalog.same_name("c_mktsegment", "  Building ")).select("c_custkey")


_KIND = "CASE event_type WHEN 'signup' THEN 'hourly' WHEN 'purchase' THEN 'daily' WHEN 'view' THEN 'weekly' WHEN 'click' THEN 'manual' ELSE 'odd' END"


@query(f"SELECT event_id, CASE WHEN k = 'odd' THEN 'custom' ELSE k END AS frequency, CASE k WHEN 'hourly' THEN ts + INTERVAL 1 HOUR WHEN 'daily' THEN ts + INTERVAL 1 DAY WHEN 'weekly' THEN ts + INTERVAL 7 DAY END AS next_run_at FROM (SELECT *, {_KIND} AS k FROM events)")
def next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X39, X40, STM05."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.expr(_KIND).alias("k"))
    kind = labels.known_frequency(F.col("k"))
    return e.select("event_id", kind.alias("frequency"), labels.next_run(kind, F.col("ts")).alias("next_run_at"))


@query("""SELECT e.event_id, s.handler FROM events e JOIN (VALUES ('audit', 'any'), ('sales', 'purchase'), ('ux', 'interaction')) s(handler, t)
  ON s.t = 'any' OR s.t = e.event_type OR (s.t = 'interaction' AND e.event_type IN ('view', 'click'))""")
def event_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM03, STM04, JN10, SET04, SET05: each event to the handlers of its type and its ancestors."""
    kinds = ev.ancestors(spark, {"view": "interaction", "click": "interaction", "interaction": "any", "signup": "any", "purchase": "any", "error": "any"})
    subscriptions = spark.createDataFrame([("audit", "any"), ("sales", "purchase"), ("ux", "interaction"), ("ux", "interaction")], "handler string, subscribed_type string")
    return ev.fan_out(table(spark, sf_dir, "events"), subscriptions, kinds).select("event_id", "handler")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly windows; the same function runs on a stream."""
    return ev.tumbling(table(spark, sf_dir, "events"))


@query("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM (
  SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions by a gap of half an hour."""
    return ev.sessions(table(spark, sf_dir, "events"))


@query("""SELECT sha256(concat(job_id, ':', f)) AS schedule_id, job_id, f AS frequency, true AS is_active, CAST(NULL AS VARCHAR) AS cron_expression, TIMESTAMP '2024-01-01 00:00:00' AS created_at,
  CASE WHEN f IN ('hourly', 'daily') THEN TIMESTAMP '2024-01-02 12:00:00' END AS last_run_at, CASE f WHEN 'hourly' THEN TIMESTAMP '2024-01-02 13:00:00' WHEN 'daily' THEN TIMESTAMP '2024-01-03 12:00:00' WHEN 'weekly' THEN TIMESTAMP '2024-01-08 00:00:00' END AS next_run_at
  FROM (SELECT concat('job', s_suppkey) AS job_id, list_extract(['hourly', 'daily', 'weekly', 'manual', 'custom'], s_suppkey % 5 + 1) AS f FROM supplier)""")
def schedule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM05, FLT16: entries, those that are due, and their next run."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    jobs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("job"), F.col("s_suppkey").cast("string")).alias("job_id"), F.element_at(F.array(*[F.lit(x) for x in ("hourly", "daily", "weekly", "manual", "x")]), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("frequency"), F.lit(None).cast("string").alias("cron_expression"))
    return sch.ran(sch.active(sch.schedule(jobs, now)), F.lit("2024-01-02 12:00:00").cast("timestamp"))
