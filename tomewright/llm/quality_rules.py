"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes good, bad or abstains. Expectation-maximisation over the table of vote patterns estimates how
often each rule is right and how common good documents are; a document is kept by the posterior probability
that it is good, in place of a demand that it pass every rule. There are at most 3 ** rules patterns, so the
table that the driver sees is bounded by the rules and not by the documents.

Defined results: a null or blank text has no words, fails the base rules and is not kept; an empty table gives
an empty result; repeated rows each get their row; texts are read whole at any length; a posterior at the threshold is kept,
and texts of equal votes tie in it; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Frequent function words of the four languages of the corpus.
FUNCTION_WORDS = (
    "the of and to in is that it for on was as with be by this from are or an at not "
    "der die und das den von zu mit sich des auf ist ein eine dem nicht im "
    "le la de les et des en un une que est pour qui dans par sur au plus "
    "el los del las con una su para es al lo como se"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; a plain alias would be copied into every lambda by the optimizer."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def covered_words(windows: Column, width: int) -> Column:
    """Words inside the windows (an array of hashes, in order) whose hash occurs at least twice, each word once."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        both = F.arrays_zip(s.alias("a"), F.concat(F.array(F.lit(None)), F.slice(s, F.lit(1), n - 1)).alias("b"), F.concat(F.slice(s, F.lit(2), n - 1), F.array(F.lit(None))).alias("c"))
        twice = F.filter(both, lambda x: F.coalesce(x["a"]["h"] == x["b"]["h"], F.lit(False)) | F.coalesce(x["a"]["h"] == x["c"]["h"], F.lit(False)))
        return let(F.array_sort(F.transform(twice, lambda x: x["a"]["i"])), of_positions)

    def of_positions(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    return let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics that rules read, one row per row of ``docs``, no shuffle.

    Windows of five words are hashed from hashes of two and four, in steps that each read their input twice, so
    the optimizer keeps them apart; only texts in which some window repeats go on to find the words it covers.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blanks = " \t\n\x0b\x0c\r"
    trimmed = F.trim(text, F.lit(blanks))
    pair = lambda a, b: F.xxhash64(a, b)
    forms = sorted({f for w in FUNCTION_WORDS for f in (w, w.capitalize(), w.upper())})
    function_hashes = [r[0] for r in docs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in forms])).alias("w")).select(F.xxhash64("w")).collect()]

    def after(name: str, k: int) -> Column:
        return F.slice(F.col(name), F.lit(k), F.col("n"))

    def line_statistics(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(blanks))) > 0)
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    counted = docs.select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, SPACE + "+"), lambda w: F.xxhash64(w))).alias("h1"),
        let(lines, line_statistics).alias("l"),
        (F.length(text) - spaces - F.regexp_count(text, F.lit(r"[\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_shouts"),
    )
    kept = ["doc_id", "l", "word_chars", "n_symbols", "n_upper", "n_shouts"]
    one = counted.select(*kept, "h1", F.greatest(F.size("h1"), F.lit(1)).alias("n"), F.size("h1").cast("long").alias("n_words"))
    two = one.select(*kept, "h1", "n", "n_words", F.zip_with("h1", after("h1", 2), pair).alias("h2"), F.size(F.filter("h1", lambda h: h.isin(*function_hashes))).cast("long").alias("n_function"))
    kept += ["n_words", "n_function"]
    four = two.select(*kept, "h1", "n", F.zip_with("h2", after("h2", 3), pair).alias("h4"))
    five = four.select(*kept, F.slice(F.zip_with("h4", after("h1", 5), pair), F.lit(1), F.greatest(F.size("h4") - 4, F.lit(0))).alias("h5"))
    repeated = F.when(F.size("h5") > F.size(F.array_distinct("h5")), covered_words(F.col("h5"), 5)).otherwise(F.lit(0))
    return five.select(*kept, repeated.cast("long").alias("n_repeat_words")).select("doc_id", "n_words", "n_repeat_words", "n_function", "l.*", "word_chars", "n_symbols", "n_upper", "n_shouts")


def vote(bad: Column, good: Column | None = None) -> Column:
    """-1 where the rule speaks against a text, 1 where it speaks for it, else it abstains."""
    out = F.when(bad, F.lit(-1))
    return (out if good is None else out.when(good, F.lit(1))).otherwise(F.lit(0))


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


@dataclass(frozen=True)
class Rule:
    name: str
    vote: Callable[[], Column]


#: What a rule does not look at is no evidence for a text, so most rules only ever speak against one.
RULES = (
    Rule("length", lambda: vote(F.col("n_words") < 10, F.col("n_words").between(50, 100_000))),
    Rule("word_length", lambda: vote(~ratio("word_chars", "n_words").between(2, 14))),
    Rule("symbols", lambda: vote(ratio("n_symbols", "n_words") > 0.1)),
    Rule("duplicate_lines", lambda: vote(ratio("n_dup_lines", "n_lines") > 0.3)),
    Rule("repetition", lambda: vote(ratio("n_repeat_words", "n_words") > 0.2)),
    Rule("upper_case", lambda: vote(ratio("n_upper", "word_chars") > 0.4)),
    Rule("shouting", lambda: vote(ratio("n_shouts", "n_words") > 0.3)),
    Rule("function_words", lambda: vote((ratio("n_function", "n_words") < 0.01) & (F.col("n_words") >= 50), ratio("n_function", "n_words") > 0.1)),
)


@dataclass(frozen=True)
class LabelModel:
    """Prior of good, and for each rule the chances of votes -1, 0, 1 given a bad and a good document."""

    prior: float
    chances: tuple[tuple[dict[int, float], dict[int, float]], ...]

    def posterior(self, votes: tuple[int, ...]) -> float:
        logs = [math.log(1 - self.prior), math.log(self.prior)]
        for v, per_class in zip(votes, self.chances, strict=True):
            for y in (0, 1):
                logs[y] += math.log(per_class[y][v])
        return 1 / (1 + math.exp(max(-700.0, min(700.0, logs[0] - logs[1]))))


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], iterations: int = 50, smoothing: float = 1.0) -> LabelModel:
    """Expectation-maximisation over counted vote patterns.

    The start trusts votes against a text more than votes for it; each accuracy has a smoothing prior at which
    votes are better than chance. Both settle which of the two classes is the good one.
    """
    rules = len(patterns[0][0]) if patterns else len(RULES)
    belief = {p: 1 / (1 + math.exp(-(1.0 + p.count(1) - 3.0 * p.count(-1)))) for p, _ in patterns}
    model = None
    for _ in range(iterations):
        good = sum(belief[p] * n for p, n in patterns)
        total = sum(n for _, n in patterns)
        prior = min(0.99, max(0.01, (good + smoothing) / (total + 2 * smoothing)))
        chances = []
        for r in range(rules):
            sums = [{-1: smoothing, 0: smoothing, 1: smoothing / 4}, {-1: smoothing / 4, 0: smoothing, 1: smoothing}]
            for p, n in patterns:
                sums[1][p[r]] += belief[p] * n
                sums[0][p[r]] += (1 - belief[p]) * n
            chances.append(tuple({v: c / sum(s.values()) for v, c in s.items()} for s in sums))
        model = LabelModel(prior, tuple(chances))
        moved = 0.0
        for p, _ in patterns:
            now = model.posterior(p)
            moved, belief[p] = max(moved, abs(now - belief[p])), now
        if moved < 1e-6:
            break
    return model or LabelModel(0.5, tuple(({-1: 1 / 3, 0: 1 / 3, 1: 1 / 3},) * 2 for _ in range(rules)))


def judge_quality(docs: DataFrame, materialize: Callable[[DataFrame], DataFrame], threshold: float = 0.5) -> DataFrame:
    """Statistics, votes, posterior, base_failed and kept of every document."""
    names = [f"vote_{r.name}" for r in RULES]
    voted = materialize(statistics(docs).select("*", *[r.vote().cast("int").alias(n) for r, n in zip(RULES, names, strict=True)]))
    counted = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted((tuple(r[n] for n in names), r["n"]) for r in counted)
    model = fit_label_model(patterns)
    table = docs.sparkSession.createDataFrame([(*p, model.posterior(p)) for p, _ in patterns], ", ".join(f"{n} int" for n in names) + ", posterior double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.join(F.broadcast(table), names).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= threshold))
