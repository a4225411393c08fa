"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one and towards a multiple of the
identity. The score of a text is the posterior of the good class, from the difference of the two Gaussian log
densities; Mahalanobis distances come from Cholesky factors that are computed once and kept in the model.

Moments are sums, gathered from at most about ``sample_rows`` labelled rows (chosen by a hash of the id).
Defined results: null and blank texts have the statistics of the empty text; with labels of one class or none,
the score is that class's share, or one half; of rows repeating a label's id the highest label counts; repeated
documents each get their row; an empty table gives an empty result; texts are read whole at any length; texts that tie
in score are all predicted alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, frame, slices
from .quality_rules import FUNCTION_WORDS

_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_STOPS = b".,;:?"
_HIGH = bytes(range(128, 192))
DIMENSIONS = 14


def document_statistics(text: str | None) -> list[float]:
    """Transformed statistics: logs of counts, roots of shares."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * DIMENSIONS
    size = len(raw)

    def count(characters: bytes) -> int:
        return size - len(raw.translate(None, characters))

    chars = max(1, len(b"".join(words).translate(None, _HIGH)))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    lower = raw.lower().split()
    distinct = len(set(lower))
    triples = len(set(zip(lower, lower[1:], lower[2:]))) if n > 2 else n
    return [
        np.log1p(n),
        np.log(chars / n),
        (count(_SYMBOLS) / n) ** 0.5,
        (count(b"!") / n) ** 0.5,
        (count(_UPPER) / chars) ** 0.5,
        (count(_DIGITS) / chars) ** 0.5,
        (count(_STOPS) / n) ** 0.5,
        (1 - len(set(lines)) / max(1, len(lines))) ** 0.5,
        np.log(distinct / n) / np.log(n + 2),
        (1 - triples / max(1, n - 2)) ** 0.5 if n > 2 else 0.0,
        (sum(map(_FUNCTION.__contains__, lower)) / n) ** 0.5,
        (sum(map(eq, lower, lower[1:])) / n) ** 0.5,
        np.log1p(n / max(1, len(lines))),
        np.log1p(max(map(len, words))),
    ]


def forward_substitution(lower: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of lower @ z = right for a lower triangular matrix, a row after the other."""
    z = np.empty_like(right)
    for i in range(len(lower)):
        z[i] = (right[i] - lower[i, :i] @ z[:i]) / lower[i, i]
    return z


@dataclass(frozen=True)
class Discriminant:
    """Per class (bad, good): log prior, mean, Cholesky factor of the shrunk covariance, half its log determinant."""

    log_priors: tuple[float, float]
    means: np.ndarray
    factors: np.ndarray
    half_logdets: tuple[float, float]

    def posterior(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for y in (0, 1):
            z = forward_substitution(self.factors[y], (x - self.means[y]).T)
            logs.append(self.log_priors[y] - self.half_logdets[y] - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = 0.1, to_identity: float = 0.05) -> Discriminant | float:
    """From (count, sum, sum of outer products) of both classes; a lone class gives its share as a constant score."""
    n = {y: moments.get(y, (0.0,))[0] for y in (0, 1)}
    if min(n.values()) < 2:
        return n[1] / sum(n.values()) if sum(n.values()) else 0.5
    means, scatter = [], []
    for y in (0, 1):
        count, total, outer = moments[y]
        means.append(total / count)
        scatter.append(outer - np.outer(total, total) / count)
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    factors, dets = [], []
    for y in (0, 1):
        # Few rows lean more on the pooled covariance.
        weight = to_pooled + (1 - to_pooled) * DIMENSIONS / (DIMENSIONS + n[y])
        cov = (1 - weight) * scatter[y] / n[y] + weight * pooled
        scale = np.diag(pooled).clip(1e-4)
        cov = (1 - to_identity) * cov + to_identity * np.diag(scale)
        factor = np.linalg.cholesky(cov)
        factors.append(factor)
        dets.append(float(np.log(np.diag(factor)).sum()))
    total = n[0] + n[1]
    return Discriminant((float(np.log(n[0] / total)), float(np.log(n[1] / total))), np.array(means), np.array(factors), (dets[0], dets[1]))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 50_000) -> Discriminant | float:
    """Fit on the documents that ``labels`` (doc_id, quality) names, at most about ``sample_rows`` of them."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    part = min(1.0, sample_rows / max(1, one.count()))
    chosen = one.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < int(part * (1 << 30))).select(F.col("doc_id").alias("_id"), "quality")
    schema = pa.schema([("quality", pa.int64()), ("at", pa.int32()), ("value", pa.float64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {y: np.zeros(1 + DIMENSIONS + DIMENSIONS**2) for y in (0, 1)}
        for texts, quality in slices(batches, "text", "quality"):
            x = np.array([document_statistics(t) for t in texts]).reshape(-1, DIMENSIONS)
            y = np.array([1 if q else 0 for q in quality], int)
            for c in (0, 1):
                own = x[y == c]
                sums[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        for c in (0, 1):
            yield frame(schema, [c] * len(sums[c]), list(range(len(sums[c]))), sums[c].tolist())

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "quality").mapInArrow(gather, "quality long, at int, value double")
    found = rows.groupBy("quality", "at").agg(F.sum("value").alias("value")).collect()
    moments = {}
    for y in (0, 1):
        flat = np.zeros(1 + DIMENSIONS + DIMENSIONS**2)
        for r in found:
            if r["quality"] == y:
                flat[r["at"]] = r["value"]
        moments[y] = (flat[0], flat[1 : 1 + DIMENSIONS], flat[1 + DIMENSIONS :].reshape(DIMENSIONS, DIMENSIONS))
    return fit(moments)


def score(docs: DataFrame, model: Discriminant | float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches, "doc_id", "text"):
            if isinstance(model, float):
                yield frame(schema, ids, [model] * len(ids))
            else:
                x = np.array([document_statistics(t) for t in texts]).reshape(-1, DIMENSIONS)
                yield frame(schema, ids, model.posterior(x))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out ids are not used."""
    model = learn(docs, labels.where(crc_mod("doc_id", 5) != 0), **options)
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
