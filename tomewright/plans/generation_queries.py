"""Citations, context packing, prompts, guardrails and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, rag
from .registry import query, table

#: Assistant turns with markers; their contexts are the turns of the same conversation, numbered from one.
_ANSWERS = "concat(text, ' [', 1 + turn % 3, ', 2] [Source ', 1 + turn % 5, '] [x] [9]')"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per conversation: its last assistant turn."""
    last = turns(spark, sf_dir).where("role = 'assistant'").groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("x")).select("conv_id", "x.*")
    return last.select(F.col("conv_id").alias("answer_id"), F.expr(_ANSWERS).alias("text"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select(F.col("conv_id").alias("answer_id"), (F.col("turn") % 4 + 1).cast("int").alias("source_index"), F.col("turn").alias("position"), "role", F.col("text"), (F.col("turn") / 2.0).alias("score"))


_ANSWERS_SQL = f"SELECT conv_id AS answer_id, {_ANSWERS} AS text FROM (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1)"
_MARKS_SQL = rf"""SELECT DISTINCT answer_id, try_cast(trim(n) AS INTEGER) AS source_index FROM (SELECT answer_id, unnest(string_split(m, ',')) AS n FROM (SELECT answer_id, unnest(regexp_extract_all(text, '(?i)\[(?:Source\s*)?(\d+(?:\s*,\s*\d+)*)\]', 1)) AS m FROM ({_ANSWERS_SQL})))"""


@query(rf"""SELECT m.answer_id, m.source_index, concat('[', m.source_index, ']') AS citation_tag, c.role, c.score,
    round(greatest(0.1, least(1.0, CASE WHEN c.score <= 1 THEN c.score ELSE 1 / (1 + c.score) END)), 4) AS relevance_confidence,
    CASE WHEN length(c.t) > 250 THEN concat(substr(c.t, 1, 247), '...') ELSE c.t END AS snippet
  FROM ({_MARKS_SQL}) m JOIN (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM (SELECT conv_id AS answer_id, CAST(turn % 4 + 1 AS INTEGER) AS source_index, role, text, turn / 2.0::DOUBLE AS score, row_number() OVER (PARTITION BY conv_id, turn % 4 ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1) c
  ON c.answer_id = m.answer_id AND c.source_index = m.source_index""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAG03, X23-X25, JN05: markers resolved to contexts; unknown numbers drop, repeated ones take the last context."""
    return rag.citations(answers(spark, sf_dir), contexts(spark, sf_dir))


@query(r"""SELECT query_id, CAST(rank AS INTEGER) AS rank, tokens, CAST(running AS BIGINT) AS running_tokens FROM (SELECT query_id, rank, tokens, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS running FROM (
  SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, greatest(1, CAST(round_even(length(text) / 4.0, 0) AS INTEGER)) AS tokens FROM documents)) WHERE running <= 4000""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAG02: documents of a source in order, as many as fit 4000 tokens."""
    from pyspark.sql import Window

    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"), "text")
    return rag.pack_context(hits, 4000).select("query_id", "rank", "tokens", "running_tokens")


_SYSTEM = f"{rag.STRATEGIES['concise']} If the context does not hold the answer, say: none"


@query(f"""SELECT conv_id, n_messages, sha256(prompt) AS prompt_sha, greatest(1, CAST(round_even(length(prompt) / 4.0, 0) AS INTEGER)) AS prompt_tokens FROM (
  SELECT conv_id, CAST(2 + count(*) AS INTEGER) AS n_messages, concat('{_SYSTEM}', chr(10), string_agg(text, chr(10) ORDER BY turn), chr(10), 'Context:', chr(10), 'c', conv_id, chr(10), chr(10), 'Question: ', 'q', conv_id) AS prompt FROM conversations GROUP BY 1)""")
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAG01: system, history and user messages, and the tokens of all."""
    per = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    history = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    made = per.select("conv_id", rag.messages(F.concat(F.lit("q"), F.col("conv_id").cast("string")), F.concat(F.lit("c"), F.col("conv_id").cast("string")), "concise", "none", history).alias("m"))
    joined = F.array_join(F.transform("m", lambda x: x["content"]), "\n")
    return made.select("conv_id", F.size("m").alias("n_messages"), F.sha2(joined.cast("binary"), 256).alias("prompt_sha"), rag.prompt_tokens(F.col("m")).alias("prompt_tokens"))


@query(f"""SELECT a.answer_id, concat_ws(',', CASE WHEN n < 2 THEN 'INSUFFICIENT_CONTEXT' END, CASE WHEN k = 0 THEN 'NO_CITATION' END, CASE WHEN top > n OR low < 1 THEN 'UNKNOWN_CITATION' END) AS violations
  FROM (SELECT answer_id, count(*) AS k, max(source_index) AS top, min(source_index) AS low FROM ({_MARKS_SQL}) GROUP BY 1) a JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c ON c.conv_id = a.answer_id""")
def guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAG05: what is wrong with an answer, as a list of rules."""
    n = turns(spark, sf_dir).groupBy(F.col("conv_id").alias("answer_id")).agg(F.count(F.lit(1)).alias("n"))
    return answers(spark, sf_dir).join(n, "answer_id").select("answer_id", F.array_join(rag.answer_guard(F.col("text"), F.col("n"), 2), ",").alias("violations"))


@query()
def ask_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAG06, RAG07, AGG17: a deterministic answer per conversation from its turns, with its metrics."""
    t = turns(spark, sf_dir)
    q = t.where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("text"))
    packed = rag.pack_context(t.where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text"), 2000).select("query_id", "rank", "text")
    out = rag.ask(q, packed).join(q, "query_id")
    return out.select("query_id", "answer", "prompt_tokens", F.array_join("violations", ",").alias("violations"), evaluation.token_f1(F.col("answer"), F.col("text")).alias("relevance"))
