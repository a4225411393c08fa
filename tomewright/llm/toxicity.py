"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding maps homoglyphs, foreign accents and digit substitutions to plain letters (i, l and 1 are one letter),
so disguised spellings meet their entry; letters of the corpus's own languages stay. Entries are words and word beginnings, learned with their log-odds
weights from labelled documents, over a fixed list of insults that holds where labels say nothing. Hits inside
exception phrases do not count. The score is logistic in the weight of the hits and in that weight per word.

Learning uses a sample of labelled rows bounded by ``sample_rows`` (chosen by a hash of the id); statistics of
nothing else are sampled. Defined results: null and blank texts have no hits and get the score of none; without
any labels the fixed list scores alone; of rows repeating a label's id the highest label counts; repeated
documents each get their row; an empty table gives an empty result; texts are read whole at any length, and weights count
by their length; texts that tie in score are all predicted alike; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, frame, materialize, slices
from .quality_rules import let

#: Look-alike letters of other scripts and the letters they stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "д": "d", "ь": "b", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ʏ": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ɴ": "n", "օ": "o", "ս": "u", "ո": "n", "ց": "g", "հ": "h", "ӧ": "o", "ł": "l",
}
#: Digits and signs that stand for letters.
SUBSTITUTIONS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i", "|": " "}
SIGNS = {"@": "a", "$": "s", "!": "i"}
#: Letters of the corpus's languages in their own right, which tell words apart and are not folded.
OWN_LETTERS = frozenset("àâäáçéèêëíîïñóôöúùûüÿßæœ")
#: Insults that count where the labels have not enough to say.
INSULTS = (
    "idiot idiots moron morons stupid pathetic loser losers worthless disgusting scum trash clown clowns imbecile dumbass retard bastard "
    "bitch asshole shit bullshit fuck fucking fucker cunt whore slut faggot scumbag jerk dumb vermin filth subhuman degenerate crap"
).split()
#: Harmless phrases that hold an entry.
EXCEPTIONS = (
    "clown fish", "clown anemonefish", "circus clown", "class clown", "rodeo clown", "pond scum", "soap scum", "trash can", "trash cans", "trash bin", "trash bag",
    "trash bags", "trash collection", "trash compactor", "trash folder", "sore loser", "stupid question", "dumb waiter", "dumb terminal", "jerk chicken", "jerk seasoning", "degenerate matter",
    "degenerate case", "degenerate gas",
)


def _table() -> dict[int, str]:
    import unicodedata

    out = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTIONS).items()}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if chr(c) in OWN_LETTERS:
            continue
        if "a" <= base <= "z":
            out.setdefault(c, SUBSTITUTIONS.get(base, base))
    for c in range(26):  # full-width letters
        out[0xFF41 + c] = SUBSTITUTIONS.get(chr(97 + c), chr(97 + c))
    for c in range(0x300, 0x370):  # combining marks
        out[c] = ""
    for c in (0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF, 0x2060):
        out[c] = ""
    return {k: v.replace("l", "i") for k, v in out.items()}


TABLE = _table()
_SIGN = re.compile(r"(?<=\w)[@$!](?=\w)")
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """Words in plain letters, one space around each."""
    low = (text or "").lower()
    if "@" in low or "$" in low or "!" in low:
        low = _SIGN.sub(lambda m: SIGNS[m.group()], low)
    return " " + " ".join(_WORDS.findall(low.translate(TABLE))) + " "


def word_count(folded: str) -> int:
    return 0 if folded.isspace() else folded.count(" ") - 1


@dataclass(frozen=True)
class ToxicityModel:
    """Entries are ' word ' or ' beginning'; ``coefficients``: constant, log weight, log weight per word."""

    entries: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]


_AUTOMATA: dict[int, tuple] = {}


def automaton(model: ToxicityModel):
    """Entries carry their weight, exceptions a zero; one build per worker and model."""
    import ahocorasick

    key = hash((tuple(sorted(model.entries.items())), model.exceptions))
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for phrase in model.exceptions:
            made.add_word(phrase, (len(phrase), 0.0))
        for entry, weight in model.entries.items():
            made.add_word(entry, (len(entry), weight))
        made.make_automaton()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def hits(folded: str, made) -> float:
    """Weight of the hits, one per word (the heaviest), those inside exception phrases left out."""
    found: dict[int, float] = {}
    spans: list[tuple[int, int]] = []
    for end, (n, weight) in made.iter(folded):
        if weight:
            at = end - n + 1
            if weight > found.get(at, 0.0):
                found[at] = weight
        else:
            spans.append((end - n + 1, end))
    if spans:
        found = {at: w for at, w in found.items() if not any(a <= at < b for a, b in spans)}
    return sum(found.values())


def features(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(1000.0 * weight / max(10, words))


def _score(model: ToxicityModel, weight: float, words: int) -> float:
    a, b = features(weight, words)
    c = model.coefficients
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * a + c[2] * b))))


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method over weighted rows, with a ridge on all but the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weights * p * (1 - p))[:, None]) + penalty, x.T @ (weights * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def copy_key() -> Column:
    """The least hash of four words in a row: near copies mostly share it, and would each lend weight to their rare words."""

    def pairs(a: Column, by: int) -> Column:
        return F.zip_with(a, F.slice(a, F.lit(by), F.greatest(F.size(a), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    words = F.transform(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"\s+"), lambda w: F.xxhash64(w))
    return let(let(words, lambda h: pairs(h, 2)), lambda p: F.array_min(F.slice(pairs(p, 3), F.lit(1), F.greatest(F.size(p) - 3, F.lit(1)))))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, min_documents: int = 4, min_share: float = 0.015) -> ToxicityModel:
    """Fit on the documents that ``labels`` (doc_id, toxic) names, at most about ``sample_rows`` of them.

    Each of n near copies counts as 1 / n of a document. An entry must be in ``min_documents`` toxic documents and in
    a ``min_share`` of them, so that no rare word of a few of them counts as an insult; the share also bounds how
    many entries there can be, by the words of a document and not by the corpus.
    """
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = one.count()
    part = min(1.0, sample_rows / max(1, n))
    chosen = one.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))).select(F.col("doc_id").alias("_id"), "toxic")
    named = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic", copy_key().alias("copy"))
    named = materialize(named)
    train = materialize(named.join(named.groupBy("copy").agg((1 / F.count(F.lit(1))).alias("share")), "copy").select("text", "toxic", "share"))
    totals = {r["toxic"]: r["n"] for r in train.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).agg(F.sum("share").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    folded = {fold(w): w for w in INSULTS}
    exceptions = tuple(dict.fromkeys(fold(p) for p in EXCEPTIONS))
    prior = dict.fromkeys(folded, 3.0)
    if not bad or not good:
        return ToxicityModel(prior, exceptions, (-4.0, 1.0, 1.0))

    schema = pa.schema([("entry", pa.string()), ("bad", pa.float64()), ("good", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[dict, dict] = ({}, {})

        def flush() -> pa.RecordBatch:
            keys = list(sums[0] | sums[1])
            out = frame(schema, keys, [sums[1].get(k, 0.0) for k in keys], [sums[0].get(k, 0.0) for k in keys])
            sums[0].clear()
            sums[1].clear()
            return out

        for texts, toxic, shares in slices(batches, "text", "toxic", "share"):
            for text, y, share_ in zip(texts, toxic, shares, strict=True):
                words = set(fold(text).split())
                own = sums[1 if y else 0]
                for k in {f" {w} " for w in words} | {" " + w[:k] for w in words for k in (4, 5, 6, 7, 8) if len(w) > k}:
                    own[k] = own.get(k, 0.0) + share_
            if len(sums[0]) + len(sums[1]) > 200_000:
                yield flush()
        yield flush()

    odds = F.log((F.col("bad") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("good") + 0.5) / F.lit(good + 1.0))
    share = bad / (bad + good)
    expected = (F.col("bad") + F.col("good")) * share
    surprise = (F.col("bad") - expected) / F.sqrt(expected * (1 - share))
    # Sums of shares may differ in their last digits from run to run, thresholds must not.
    counted = train.repartition(max(1, min(64, n // 500 + 1))).mapInArrow(count, "entry string, bad double, good double").groupBy("entry").agg(F.round(F.sum("bad"), 6).alias("bad"), F.round(F.sum("good"), 6).alias("good"))
    counted = materialize(counted.where((F.col("bad") >= max(min_documents, min_share * bad)) | F.col("entry").isin(list(folded))))
    strong = (
        counted.withColumn("weight", odds)
        .where((F.col("bad") >= max(min_documents, min_share * bad)) & (F.col("weight") >= 2.5) & (surprise >= 6))
        .orderBy(F.desc(F.round(F.col("bad") * F.col("weight"), 6)), F.length("entry"), "entry")
        .collect()
    )
    weak = {r["entry"] for r in counted.where(F.col("entry").isin(list(folded)) & (F.col("good") >= 3) & (odds < 1.0)).collect()}
    entries = {k: w for k, w in prior.items() if k not in weak}
    # The entries that explain most come first; others that begin alike say the same of the same words.
    begun: list[str] = []
    for r in strong:
        entry = r["entry"]
        if not any(entry.startswith(b) or b.startswith(entry) for b in begun):
            entries[entry] = round(min(8.0, r["weight"]), 6)
            begun.append(entry)
    model = ToxicityModel(entries, exceptions, (0.0, 0.0, 0.0))
    xs = np.array(sorted(tuple(r) for r in weigh(train, model, "toxic", "share").select("weight", "words", "toxic", "share").collect()), float).reshape(-1, 4)
    beta = _logistic(np.array([features(w, int(k)) for w, k, *_ in xs]), (xs[:, 2] != 0).astype(float), xs[:, 3])
    return ToxicityModel(entries, exceptions, tuple(float(b) for b in beta))


def weigh(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """Kept columns, with the weight of the hits, the words, and the score of each row."""
    names = list(keep)
    kinds = {k: "double" if k == "share" else "long" for k in names}
    schema = pa.schema([*[(k, pa.float64() if kinds[k] == "double" else pa.int64()) for k in names], ("weight", pa.float64()), ("words", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(model)
        for *kept, texts in slices(batches, *names, "text"):
            weights, words, scores = [], [], []
            for text in texts:
                folded = fold(text)
                w, n = hits(folded, made), word_count(folded)
                weights.append(w)
                words.append(n)
                scores.append(_score(model, w, n))
            yield frame(schema, *kept, weights, words, scores)

    return docs.select(*[F.col(k).cast(kinds[k]) for k in names], "text").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in names) + ", " * bool(names) + "weight double, words long, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod("doc_id", 4) != 2)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, weight, words of every document; labels of held-out ids are not used."""
    model = learn(docs, training_labels(labels), **options)
    return weigh(docs, model, "doc_id").select(
        "doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight", "words"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    model = learn(docs, training_labels(labels), **options)

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(model)
        for batch in batches:
            keep = []
            for (texts,) in slices([batch], "text"):
                for text in texts:
                    folded = fold(text)
                    keep.append(_score(model, hits(folded, made), word_count(folded)) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(verdict, docs.schema)
