"""Prompt building, context packing, citations and guardrails over retrieved chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, text
from ..functions.errors import EngineError

#: Fixed values, which results depend on: the form of a citation. One bracket with one or more numbers, each bracket optionally headed by a word for source.
MARKER = r"(?i)\[(?:Source\s*)?(\d+(?:\s*,\s*\d+)*)\]"
#: Instructions per strategy, in our own words.
STRATEGIES = {
    "standard": "Answer the question from the context alone and cite sources as [n].",
    "investigative": "Work through the evidence in the context step by step, name causes and gaps, and cite sources as [n].",
    "executive": "Summarise for decision makers: findings, impact, next steps, with sources as [n].",
    "concise": "Answer in at most three sentences with sources as [n].",
    "extractive": "Answer with verbatim passages of the context only, each with its source as [n].",
}


def markers(c: Column) -> Column:
    """Distinct cited numbers in order; numbers too large for an integer are none."""
    found = F.regexp_extract_all(c, F.lit(MARKER), 1)
    numbers = F.flatten(F.transform(found, lambda x: F.transform(F.split(x, ","), lambda n: F.trim(n).try_cast("int"))))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))


def citations(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows of cited contexts. ``answers``: (answer_id, text); ``contexts``: (answer_id, source_index, position, ..., text, score).

    A marker without a context is dropped; of contexts with one number the last by position counts.
    """
    cited = answers.select("answer_id", F.explode(markers(F.col("text"))).alias("source_index"))
    last = F.row_number().over(Window.partitionBy("answer_id", "source_index").orderBy(F.desc("position")))
    chosen = contexts.withColumn("_last", last).where("_last = 1").drop("_last")
    return cited.join(chosen, ["answer_id", "source_index"]).select(
        "answer_id",
        "source_index",
        F.concat(F.lit("["), F.col("source_index").cast("string"), F.lit("]")).alias("citation_tag"),
        *[c for c in chosen.columns if c not in ("answer_id", "source_index", "position", "text", "score")],
        "score",
        labels.confidence(F.col("score")).alias("relevance_confidence"),
        text.shorten(text.strip(F.col("text")), 250, 247).alias("snippet"),
    )


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """The leading hits per query (query_id, rank, text) whose tokens together stay within the budget."""
    counted = hits.withColumn("tokens", text.count_tokens(F.col("text")))
    total = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("running_tokens", total).where(F.col("running_tokens") <= budget)


def messages(question: Column, context: Column, strategy: str = "standard", fallback: str = "I do not know.", history: Column | None = None) -> Column:
    """System, history and user messages in order."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    system = F.lit(f"{STRATEGIES[strategy]} If the context does not hold the answer, say: {fallback}")
    user = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)
    parts = [F.array(message("system", system))] + ([] if history is None else [F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>"))]) + [F.array(message("user", user))]
    return F.concat(*parts)


def prompt_tokens(m: Column) -> Column:
    return text.count_tokens(F.array_join(F.transform(m, lambda x: x["content"]), "\n"))


def violations(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold for a row: the shape of all row validation here."""
    return F.filter(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules]), lambda x: x.isNotNull())


def query_guard(c: Column, max_length: int = 1000) -> Column:
    return violations(
        ("EMPTY_QUERY", text.strip(c) == ""),
        ("QUERY_TOO_LONG", F.length(c) > max_length),
        ("PROMPT_INJECTION", F.lower(c).rlike(r"ignore (all |the )?(previous|above) (instructions|rules)|reveal (the |your )?system prompt")),
    )


def answer_guard(answer: Column, n_contexts: Column, least_contexts: int = 1) -> Column:
    found = markers(answer)
    return violations(
        ("INSUFFICIENT_CONTEXT", n_contexts < least_contexts),
        ("NO_CITATION", F.size(found) == 0),
        ("UNKNOWN_CITATION", F.exists(found, lambda n: (n < 1) | (n > n_contexts))),
    )


def extractive_answer(question: Column, contexts: Column) -> Column:
    """A deterministic stand-in for a model: the context that shares most words with the question, with its number."""
    words = F.array_distinct(text.query_tokens(question))
    scored = F.transform(contexts, lambda c, i: F.struct(F.size(F.array_intersect(words, F.array_distinct(text.query_tokens(c, 1 << 30)))).alias("n"), (-i).alias("at"), c.alias("text")))
    best = F.array_max(scored)
    return F.when(F.size(contexts) == 0, F.lit("I do not know.")).otherwise(F.concat(best["text"], F.lit(" ["), (1 - best["at"]).cast("string"), F.lit("]")))


PROVIDERS: dict[str, Callable[[Column, Column], Column]] = {"extractive": extractive_answer}


def register_provider(name: str, provider: Callable[[Column, Column], Column]) -> None:
    PROVIDERS[name.strip().lower()] = provider


def provider_of(name: str) -> Callable[[Column, Column], Column]:
    """A registered provider, whatever the case of its name."""
    found = PROVIDERS.get(name.strip().lower())
    if found is None:
        raise EngineError("RESOURCE_NOT_FOUND", f"no provider {name}")
    return found


def healthy(spark: SparkSession, name: str) -> bool:
    """Whether a provider answers a probe: a question and a context of one row."""
    try:
        probe = spark.range(1).select(provider_of(name)(F.lit("is it there"), F.array(F.lit("it is there"))).alias("answer")).first()
    except EngineError:
        raise
    except Exception:  # noqa: BLE001 - whatever a provider raises, it is not well
        return False
    return bool(probe.answer)


def health(spark: SparkSession) -> dict[str, bool]:
    return {name: healthy(spark, name) for name in PROVIDERS}


def ask(questions: DataFrame, packed: DataFrame, strategy: str = "standard", provider: str = "extractive") -> DataFrame:
    """(query_id, answer, prompt, tokens, violations) from questions (query_id, text) and packed contexts (query_id, rank, text)."""
    contexts = packed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    joined = questions.join(contexts, "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    numbered = F.array_join(F.transform("contexts", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n")
    out = joined.withColumn("prompt", messages(F.col("text"), numbered, strategy)).withColumn("answer", provider_of(provider)(F.col("text"), F.col("contexts")))
    return out.select("query_id", "answer", "prompt", prompt_tokens(F.col("prompt")).alias("prompt_tokens"), answer_guard(F.col("answer"), F.size("contexts")).alias("violations"))


#: Hits that a variant of asking packs at most, and its instructions.
VARIANTS = {"ask": ("standard", 20), "investigation": ("investigative", 30), "executive_summary": ("executive", 20)}


def ask_variant(variant: str, questions: DataFrame, hits: DataFrame, budget: int = 3000, provider: str = "extractive") -> DataFrame:
    """``ask`` over the leading hits (query_id, rank, text) of a variant, packed into the budget: ask, investigation or executive_summary."""
    if variant not in VARIANTS:
        raise EngineError("STRATEGY_NOT_FOUND", variant)
    strategy, top_k = VARIANTS[variant]
    packed = pack_context(hits.where(F.col("rank") <= top_k), budget).select("query_id", "rank", "text")
    return ask(questions, packed, strategy, provider)


def ask_investigation(questions: DataFrame, hits: DataFrame, **more) -> DataFrame:
    return ask_variant("investigation", questions, hits, **more)


def ask_executive_summary(questions: DataFrame, hits: DataFrame, **more) -> DataFrame:
    return ask_variant("executive_summary", questions, hits, **more)
