"""Vectors, BM25, fusion and hybrid search over embeddings, documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import evaluation, retrieval, vectorstore
from .registry import query, table


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every 20th vector."""
    return collection(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


_COS = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))) / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x))))"


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, len(embedding) AS dimension FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").cast("long").alias("dimension"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: 3.0 * x / (3.0 * n))), 4) AS sum_normalised FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings)")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X21 over vectors three times as long."""
    longer = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * 3).alias("v"))
    unit = longer.select("vec_id", vectors.normalise(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("sum_normalised"))


@query(f"SELECT b.vec_id AS id, round({_COS}, 6) AS score FROM (SELECT embedding FROM embeddings WHERE vec_id = 0) a, embeddings b ORDER BY score DESC, id LIMIT 10")
def knn_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11, LIM03: ten nearest of one vector."""
    c = collection(spark, sf_dir)
    one = c.where("id = 0").select(F.col("vector").alias("query_vector")).limit(1)
    return vectorstore.search_one(c.crossJoin(F.broadcast(one)), F.col("query_vector"), 10).select("id", "score")


@query(f"SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a, embeddings b)) WHERE rank <= 10")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11, WIN01: ten nearest of each query, exact."""
    return vectorstore.search(collection(spark, sf_dir), asked(spark, sf_dir), 10)


@query(f"SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a, embeddings b WHERE b.label BETWEEN 2 AND 5) WHERE score >= 0.05) WHERE rank <= 5")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT11-FLT13: filter before the search, threshold on the score."""
    return vectorstore.search(collection(spark, sf_dir), asked(spark, sf_dir), 5, vectorstore.Filter().between("label", 2, 5), 0.05)


@query("SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 99 ELSE label END AS label FROM embeddings UNION ALL SELECT -1 - vec_id, 99 FROM embeddings WHERE vec_id % 100 = 0")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK03: records replace and add, the last of repeated ids counts."""
    c = collection(spark, sf_dir)
    hit = c.where("id % 7 = 0")
    new = hit.withColumn("label", F.lit(98)).withColumn("at", F.lit(1)).unionByName(hit.withColumn("label", F.lit(99)).withColumn("at", F.lit(2)))
    added = c.where("id % 100 = 0").withColumn("id", -1 - F.col("id")).withColumn("label", F.lit(99)).withColumn("at", F.lit(1))
    return vectorstore.upsert(c, new.unionByName(added), "at").select("id", "label")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 3 <> 0 AND label <> 4")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK05, SNK06: by ids, then by filter."""
    c = collection(spark, sf_dir)
    return vectorstore.delete_where(vectorstore.delete(c, c.where("id % 3 = 0").select("id")), vectorstore.Filter().equals("label", 4)).select("id", "label")


@query("SELECT vec_id AS id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 20 OFFSET 5")
def vector_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC27: a page of a filtered collection."""
    return vectorstore.scroll(collection(spark, sf_dir), vectorstore.Filter().equals("label", 3), 20, 5).select("id", "label")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (1, 3, 5, 8)")
def vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC28, JN09."""
    ids = spark.createDataFrame([(1,), (3,), (5,), (8,), (8,), (-7,)], "id long")
    return vectorstore.by_ids(collection(spark, sf_dir), ids).select("id", "label")


@query("SELECT count(*) AS points, CAST(min(len(embedding)) AS INTEGER) AS min_dimension, CAST(max(len(embedding)) AS INTEGER) AS max_dimension FROM embeddings")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorstore.statistics(collection(spark, sf_dir))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
_BM25 = rf"""
  WITH toks AS MATERIALIZED (SELECT id, len(l) AS length, unnest(l) AS term FROM (SELECT doc_id AS id, {_TOKENS} AS l FROM documents)),
  stats AS (SELECT count(*) AS n_docs, avg(len({_TOKENS})) AS avg_length FROM documents),
  q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')) AS term FROM benchmark),
  tf AS (SELECT id, length, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  bm AS (SELECT q.query_id, tf.id, round(sum(greatest(0, ln(1 + (n_docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) AS score
         FROM q JOIN tf USING (term) JOIN df USING (term), stats GROUP BY ALL),
  sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm)
"""
_VEC = f"""
  , knn AS (SELECT i.item_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id, embeddings b),
  dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM knn),
  lists AS (SELECT query_id, id, score, rank, 'dense' AS strategy FROM dense WHERE rank <= 100 UNION ALL SELECT query_id, id, score, rank, 'sparse' FROM sparse WHERE rank <= 100),
  normed AS (SELECT query_id, id, strategy, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM lists WINDOW w AS (PARTITION BY query_id, strategy))
"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with the vector of their number, and questions with theirs."""
    c = collection(spark, sf_dir).select("id", "vector")
    q = questions(spark, sf_dir).join(c.withColumnRenamed("id", "query_id"), "query_id")
    return c, q


def both_lists(spark: SparkSession, sf_dir: str, options: retrieval.Options) -> DataFrame:
    c, q = _lists(spark, sf_dir)
    return retrieval.dense(c, q, options).unionByName(retrieval.sparse(corpus(spark, sf_dir), questions(spark, sf_dir), options))


def _fused(name: str, sql: str, digits: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        options = retrieval.Options(fusion=name)
        fused = retrieval.FUSIONS[name](both_lists(spark, sf_dir, options), options)
        return retrieval.ranked(fused, "hybrid", 20).select("query_id", "id", F.round("score", digits).alias("score"))

    run.__name__ = {"rrf": "rrf_fusion", "weighted": "weighted_fusion", "combsum": "combsum_fusion"}[name]
    query(_BM25 + _VEC + f"SELECT query_id, id, round(score, {digits}) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({sql})) WHERE rank <= 20")(run)


_fused("rrf", "SELECT query_id, id, round(sum(0.5 / (60 + rank)), 8) AS score FROM lists GROUP BY ALL", 8)
_fused("weighted", "SELECT query_id, id, round(sum(0.5 * score), 6) AS score FROM normed GROUP BY ALL", 6)
_fused("combsum", "SELECT query_id, id, round(sum(score), 6) AS score FROM normed GROUP BY ALL", 6)


@query(_BM25 + "SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 20")
def sparse_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RET05: the facade with the dense branch not planned."""
    return retrieval.sparse_only(corpus(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "id", "rank")


def _hashed(table: str, key: str) -> str:
    """Hashed and normalised embeddings of the texts of a table, as (id, v)."""
    return f"""SELECT id, list_transform(v, lambda x: CAST(x / greatest(1e-300, sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS FLOAT)) AS v FROM (
      SELECT id, list(coalesce(n, 0) ORDER BY bucket) AS v FROM (SELECT {key} AS id, unnest(range(64)) AS bucket FROM {table}) LEFT JOIN (
        SELECT id, h % 64 AS bucket, sum(CASE WHEN h >= 2147483648 THEN 1.0 ELSE -1.0 END)::DOUBLE AS n FROM (
          SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT {key} AS id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM {table}) WHERE w <> '') GROUP BY ALL) USING (id, bucket) GROUP BY id)"""


_HYBRID = f"""
  , ed AS MATERIALIZED ({_hashed("documents", "doc_id")}), eq AS MATERIALIZED ({_hashed("benchmark", "item_id")}),
  knn AS (SELECT a.id AS query_id, b.id AS id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.v[i] AS DOUBLE) * CAST(b.v[i] AS DOUBLE))) /
      (sqrt(list_sum(list_transform(a.v, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.v, lambda x: CAST(x AS DOUBLE) * x)))), 6) AS score FROM eq a, ed b),
  dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM knn WHERE NOT isnan(score)),
  lists AS (SELECT query_id, id, rank FROM dense WHERE rank <= 100 UNION ALL SELECT query_id, id, rank FROM sparse WHERE rank <= 100)
  SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sum(0.5 / (60 + rank)), 8) DESC, id) AS INTEGER) AS rank, round(round(sum(0.5 / (60 + rank)), 8), 6) AS score FROM lists GROUP BY query_id, id
  QUALIFY rank <= 20
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three models on questions, made of the documents."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 200).alias("question"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), "lang", (F.col("n_chars") % 100 / 100.0).alias("value"))


_RUNS = "(SELECT doc_id % 200 AS question, concat('m', doc_id % 3) AS model, lang, (n_chars % 100) / 100.0::DOUBLE AS value FROM documents)"


@query(f"SELECT model, round(avg(value), 6) AS mean_score, count(*) AS n_runs, CAST(dense_rank() OVER (ORDER BY round(avg(value), 6) DESC) AS INTEGER) AS place FROM {_RUNS} GROUP BY 1")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.leaderboard(runs(spark, sf_dir), "model", "value")


@query(f"SELECT lang, round(avg(value) FILTER (model = 'm0'), 6) AS m0, round(avg(value) FILTER (model = 'm1'), 6) AS m1, round(avg(value) FILTER (model = 'm2'), 6) AS m2 FROM {_RUNS} GROUP BY 1")
def provider_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.compare_providers(runs(spark, sf_dir), "lang", "model", "value", ["m0", "m1", "m2"])


@query(f"""WITH r AS (SELECT question, model, round(avg(value), 6) AS value FROM {_RUNS} GROUP BY ALL), a AS (SELECT question, value FROM r WHERE model = 'm0'), b AS (SELECT question, value FROM r WHERE model = 'm1' AND question % 5 <> 0)
  SELECT coalesce(a.question, b.question) AS question, a.value AS base_value, b.value AS new_value, round(b.value - a.value, 6) AS change,
    CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' WHEN round(b.value - a.value, 6) > 0 THEN 'better' WHEN round(b.value - a.value, 6) < 0 THEN 'worse' ELSE 'same' END AS verdict
  FROM a FULL JOIN b ON a.question = b.question""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = runs(spark, sf_dir).groupBy("question", "model").agg(F.round(F.avg("value"), 6).alias("value"))
    return evaluation.compare_runs(per.where("model = 'm0'"), per.where("model = 'm1' AND question % 5 <> 0"), "question", "value")


@query(f"SELECT lang, model, count(*) AS n_failures, round(avg(value), 6) AS mean_score FROM {_RUNS} WHERE value < 0.3 GROUP BY ALL")
def failure_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.failures(runs(spark, sf_dir), "value", 0.3, "lang", "model")


@query(f"SELECT model, 'value' AS metric, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS deviation, round(quantile_cont(value, 0.5), 6) AS median FROM {_RUNS} GROUP BY 1")
def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.overall(runs(spark, sf_dir), ["value"], "model")


@query("SELECT vec_id AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS place FROM embeddings")
def rank_within_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN01 without a search."""
    return collection(spark, sf_dir).select("id", F.row_number().over(Window.partitionBy("label").orderBy("id")).alias("place"))
