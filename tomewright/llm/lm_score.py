"""Language-model scores by subword lattice likelihood, beside a word unigram base score.

The pieces of an existing public vocabulary span a lattice over each word; its probability is the sum over all
segmentations of the product of piece probabilities, by a forward recursion in log space. Words are
independent given their order, so a text's marginal is the product over its words and its end: it is computed
once per distinct word, for many words at a time. The vocabulary's scores are negative ranks; by Zipf's law a
piece starts with a probability inverse to its rank, and expectation-maximisation over the same lattices and all
training words goes on until a round gains less than ``tolerance`` nats per token. Every piece keeps a share, and
characters outside the vocabulary are spelled in byte pieces, so no text has probability zero.

The corpus yields a table of distinct words and counts. The most frequent ``head_words`` of them (a bound) go to
the workers; the rest meet their documents in a join by word, counted per document first.

Defined results: null text is the empty text, which is its end token alone; with no training rows the base has
N = V = 0 and the pieces keep their initial weights; rows repeating an id each get their row; an empty table
gives an empty result; texts and words are read whole at any length, long words in smaller batches; words that tie in
count are taken in byte order; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.slices import slices as text_slices
from .common import crc_mod, frame, materialize, slices, text_rank

MARK = "▁"
HELD_CLASS, CLASSES = 2, 7
FLUSH = 150_000
#: Words whose lattices are gone through at once.
STEP = 10_000
#: Letters of such words together; a longer word is gone through alone.
LETTERS = 1_000_000


def within_letters(rows: Iterator[tuple[list, ...]]) -> Iterator[tuple[list, ...]]:
    """The same rows in batches of no more than LETTERS bytes of words, the first column, or of one word."""
    for lists in rows:
        start = total = 0
        for i, word in enumerate(lists[0]):
            if i > start and total + len(word) > LETTERS:
                yield tuple(x[start:i] for x in lists)
                start, total = i, 0
            total += len(word)
        yield tuple(x[start:] for x in lists)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def read_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces with the vocabulary's scores; control and unknown pieces are empty, byte pieces read <0xNN>."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = range(model.vocab_size())
    return ["" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i) for i in size], np.array([model.get_score(i) for i in size])


class Lattice:
    """Piece lookups of a vocabulary: a tree of characters, its edges found by a hash of (node, character)."""

    #: Places of the hash table as a power of two; few of them are shared by two edges.
    BITS = 20

    def __init__(self, pieces: list[str]) -> None:
        self.size = len(pieces)
        self.bytes = np.zeros(256, np.int64)
        children: list[dict[int, int]] = [{}]
        number = [-1]
        for i, p in enumerate(pieces):
            if len(p) == 6 and p.startswith("<0x") and p.endswith(">"):
                self.bytes[int(p[3:5], 16)] = i
                continue
            node = 0
            for c in map(ord, p):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    number.append(-1)
                node = children[node][c]
            if p:
                number[node] = i
        edges = [(node << 21 | c, to) for node, own in enumerate(children) for c, to in own.items()]
        # Edge 0 is none; edges of one place of the table are a chain.
        self.keys, self.to = np.array([-1, *(k for k, _ in edges)], np.int64), np.array([-1, *(t for _, t in edges)], np.int64)
        self.number = np.array([-1, *(number[t] for _, t in edges)], np.int64)
        self.inner = np.array([False, *(bool(children[t]) for _, t in edges)])
        self.first, self.next = np.zeros(1 << self.BITS, np.int32), np.zeros(len(self.keys), np.int32)
        for i, place in enumerate(self._place(self.keys[1:]).tolist(), 1):
            self.next[i], self.first[place] = self.first[place], i

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def edges(self, keys: np.ndarray) -> np.ndarray:
        """The edge of each key, 0 where there is none."""
        found = self.first[self._place(keys)]
        wrong = np.flatnonzero((self.keys[found] != keys) & (found > 0))
        while len(wrong):
            found[wrong] = self.next[found[wrong]]
            wrong = wrong[(self.keys[found[wrong]] != keys[wrong]) & (found[wrong] > 0)]
        return found

    def read(self, words: list[str]) -> Words:
        return Words(self, words)


class Words:
    """The lattices of many words: ``arcs[d - 1]`` has (starts, ends, pieces) of the pieces of d characters, by place.

    Places are the words' first characters, then their second ones, and so on, the longest words first, each with
    a place for its end. So the arcs of one length that end after j characters are a slice, in which no place is twice.
    Characters that no piece stands for have numbers above the pieces.
    """

    #: The character of an end; no edge has it.
    END = (1 << 21) - 1

    def __init__(self, own: Lattice, words: list[str]) -> None:
        self.own = own
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        # How many words have a j-th place, and where those places begin.
        deep = int(sizes[0]) + 1 if len(sizes) else 0
        wide = len(sizes) - np.searchsorted(sizes[::-1], np.arange(deep))
        self.begin = np.concatenate(([0], np.cumsum(wide)))
        self.places = int(self.begin[-1])
        self.ends = self.begin[sizes] + np.arange(len(sizes))
        place = np.empty(len(words), np.int64)
        place[self.order] = np.arange(len(words))
        inside = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        chars = np.full(self.places, self.END)
        chars[self.begin[inside] + np.repeat(place, lengths)] = text
        follows = np.arange(self.places) + np.repeat(wide, wide)
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        start = np.flatnonzero(chars != self.END)
        at, node = start, np.zeros(len(start), np.int64)
        while len(start) or not self.arcs:
            edge = own.edges(node << 21 | chars[at])
            piece = own.number[edge]
            after = follows[at]
            if self.arcs:
                real = np.flatnonzero(piece >= 0)
                self.arcs.append((start[real], after[real], piece[real]))
            else:
                bare = np.flatnonzero(piece < 0)
                spelled, which = np.unique(chars[at[bare]], return_inverse=True)
                piece[bare] = own.size + which
                self.spelled = [own.bytes[list(chr(c).encode("utf-8", "surrogatepass"))] for c in spelled.tolist()]
                self.arcs.append((start, after, piece))
            on = np.flatnonzero(own.inner[edge])
            start, at, node = start[on], after[on], own.to[edge[on]]
        # Per number of characters, the slices of arcs of each length that end there.
        cuts = np.stack([np.searchsorted(ends, self.begin) for _, ends, _ in self.arcs]).T.tolist()
        self.slices = [[(d, a, b) for d, (a, b) in enumerate(zip(*x, strict=True)) if a < b] for x in zip(cuts[1:], cuts[2:], strict=False)]

    def weights(self, logs: np.ndarray) -> np.ndarray:
        """Log probabilities by piece number, then of spelled characters."""
        return np.concatenate((logs, [logs[b].sum() for b in self.spelled]))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Forward recursion in log space over the pieces that end at each place."""
        out = np.full(self.places, -np.inf)
        out[: len(self.order)] = 0.0
        weights = [logs[piece] for _, _, piece in self.arcs]
        for own in self.slices:
            for d, a, b in own:
                starts, ends, _ = self.arcs[d]
                to = ends[a:b]
                out[to] = np.logaddexp(out[to], out[starts[a:b]] + weights[d][a:b])
        return out

    def log_probabilities(self, logs: np.ndarray) -> np.ndarray:
        """The marginal log probability of each word, in the order given."""
        out = np.empty(len(self.order))
        out[self.order] = self.forward(self.weights(logs))[self.ends]
        return out

    def expected(self, logs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        """(expected uses of each piece, log likelihood) of words that occur ``counts`` times."""
        weights = self.weights(logs)
        forward = self.forward(weights)
        counts = np.asarray(counts, float)[self.order]
        mass, uses = np.zeros(self.places), np.zeros(len(weights))
        mass[self.ends] = counts
        # Backwards: the mass at an end splits over its arcs in proportion to what came through them.
        shares = [np.exp(forward[starts] + weights[piece] - forward[ends]) for starts, ends, piece in self.arcs]
        for own in reversed(self.slices):
            for d, a, b in own:
                starts, ends, _ = self.arcs[d]
                shares[d][a:b] *= mass[ends[a:b]]
                mass[starts[a:b]] += shares[d][a:b]
        for (_, _, piece), share in zip(self.arcs, shares, strict=True):
            uses += np.bincount(piece, share, len(weights))
        out = uses[: self.own.size].copy()
        for b, n in zip(self.spelled, uses[self.own.size :], strict=False):
            np.add.at(out, b, n)
        return out, float(counts @ forward[self.ends])


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(read_pieces(path)[0])
    return _LATTICES[path]


@dataclass(frozen=True)
class WordTable:
    """``words``: (word binary, seen, trained) over all texts; totals N and V count ends as tokens."""

    words: DataFrame
    train_tokens: int
    train_types: int
    ends: int


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def few_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Rows, ids and texts, so few that all their words may be held."""
    for batch in batches:
        at = 0
        for texts in text_slices(batch.column("text")):
            part = batch.slice(at, len(texts))
            at += len(texts)
            yield part.column("row"), part.column("doc_id"), texts


def marked(words: list[bytes]) -> list[str]:
    """Words, which hold no line feed, as the lattices read them."""
    return (MARK + b"\n".join(words).decode("utf-8", "surrogatepass").replace("\n", "\n" + MARK)).split("\n") if words else []


def count_words(docs: DataFrame) -> WordTable:
    """Counts of all words, and of those in training texts; each task counts before the shuffle."""
    rows = docs.select(F.col("text").cast("binary").alias("text"), (crc_mod("doc_id", CLASSES) != HELD_CLASS).alias("train"))
    schema = pa.schema([("word", pa.binary()), ("seen", pa.int64()), ("trained", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            only = [k for k in rest if k not in train]
            seen = [*map(add, train.values(), map(rest.get, train, repeat(0))), *map(rest.get, only)]
            out = frame(schema, [*train, *only], seen, [*train.values(), *repeat(0, len(only))])
            train.clear()
            rest.clear()
            return out

        for texts, flags in slices(batches, "text", "train"):
            for text, flag in zip(texts, flags, strict=True):
                (train if flag else rest).update(tokens(text))
            if len(train) + len(rest) > FLUSH:
                yield flush()
        yield flush()

    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("train").alias("ends")).first()
    ends = sizes["ends"]
    # Tasks have counted already; partitions follow the number of texts, so that none grows with the corpus.
    parts = max(text_rank(docs.sparkSession), sizes["n"] // 8192)
    counted = rows.mapInArrow(run, "word binary, seen long, trained long").repartition(parts, "word").groupBy("word").agg(F.sum("seen").alias("seen"), F.sum("trained").alias("trained"))
    words = materialize(counted)
    total = words.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.count_if(F.col("trained") > 0).alias("v")).first()
    return WordTable(words, total["n"] + ends, total["v"] + (1 if ends else 0), ends)


def initial_weights(scores: np.ndarray) -> np.ndarray:
    """Log probabilities by Zipf's law, from scores that are negative ranks (all pieces and a hundredth for the end sum to one)."""
    ranks = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
    start = 1.0 / (ranks + 10)
    return np.log(start / start.sum() * 0.99)


def learn_pieces(table: WordTable, path: str, rounds: int = 12, tolerance: float = 0.01, smoothing: float = 0.01) -> tuple[np.ndarray, float]:
    """Natural log probabilities of the pieces, and of a text's end; ``rounds`` bounds expectation-maximisation."""
    logs = initial_weights(read_pieces(path)[1])
    end = math.log(0.01)
    schema = pa.schema([("piece", pa.int32()), ("uses", pa.float64())])
    trained = table.words.where("trained > 0").select("word", "trained")
    before = -math.inf
    for _ in range(rounds if table.train_tokens else 0):
        now = logs

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            own = lattice(path)
            uses, likelihood = np.zeros(own.size), 0.0
            for words, counts in within_letters(slices(batches, "word", "trained", step=STEP)):
                some, more = own.read(marked(words)).expected(now, counts)
                uses += some
                likelihood += more
            at = np.flatnonzero(uses)
            yield frame(schema, [*at.tolist(), -1], [*uses[at].tolist(), likelihood])

        found = trained.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(len(logs), smoothing)
        likelihood = table.ends * end
        for r in found:
            if r["piece"] < 0:
                likelihood += r["uses"]
            else:
                uses[r["piece"]] += r["uses"]
        if likelihood - before < tolerance * table.train_tokens:
            break
        before = likelihood
        total = uses.sum() + table.ends
        logs, end = np.log(uses / total), math.log(max(table.ends, smoothing) / total)
    return logs, end


def score_documents(docs: DataFrame, path: str | None = None, head_words: int = 100_000, rounds: int = 12, lattice_score: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Without ``lattice_score`` there is no score, and the pieces it needs are not learned; the other columns are the same.
    """
    table = count_words(docs)
    if lattice_score:
        vocabulary = path or default_vocabulary()
        logs, end = learn_pieces(table, vocabulary, rounds)
    ten = math.log(10)
    scale = math.log10(table.train_tokens + table.train_types + 1)
    schema = pa.schema([("word", pa.binary()), ("seen", pa.int64()), ("trained", pa.int64()), ("lattice", pa.float64())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(vocabulary)
        for words, seen, trained in within_letters(slices(batches, "word", "seen", "trained", step=STEP)):
            yield frame(schema, words, seen, trained, own.read(marked(words)).log_probabilities(logs) / ten)

    if lattice_score:
        rated = materialize(table.words.mapInArrow(rate, "word binary, seen long, trained long, lattice double"))
    else:
        rated = table.words.withColumn("lattice", F.lit(0.0))
    # A bounded head, ties and all: what it holds changes no result, only the road to it.
    head = rated.orderBy(F.desc("seen"), "word").limit(head_words).select("word", "trained", "lattice").toArrow()
    # What a word of the head adds, by its place there; the last place is that of other words.
    trained = np.append(head.column("trained").to_numpy(), 0)
    adds = [(trained > 0).astype(float), np.log10(trained + 1.0), np.append(head.column("lattice").to_numpy(), 0.0)]
    shipped = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(head.column("word").to_pylist())}, adds))

    # A word of a text outside the head is a row; the row without a word carries the sums over the head.
    part = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("n", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("lattice", pa.float64())])
    ddl = "row long, doc_id long, word binary, times long, n long, n_known long, base double, lattice double"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, adds = shipped.value
        for row, doc, texts in few_texts(batches):
            owns = [tokens(text) for text in texts.to_pylist()]
            lengths = [len(own) for own in owns]
            upto = np.cumsum(lengths)
            at = np.fromiter(map(heads.get, chain.from_iterable(owns), repeat(-1)), np.int64, upto[-1])
            of = np.repeat(np.arange(len(row)), lengths)
            sure, bases, lattices = (np.bincount(of, x[at], len(row)) for x in adds)
            others = np.flatnonzero(at < 0)
            cuts = np.searchsorted(others, upto).tolist()
            inside = (others - (upto - lengths)[of[others]]).tolist()
            words, times, sizes = [], [], []
            for own, start, stop in zip(owns, [0, *cuts], cuts, strict=False):
                tail = Counter([own[i] for i in inside[start:stop]])
                sizes.append(len(tail))
                words += tail.keys()
                times += tail.values()
            at = pa.array(np.repeat(np.arange(len(row)), sizes))
            n = len(words)
            yield frame(part, row, doc, [None] * len(row), [0] * len(row), lengths, sure.astype(np.int64), bases, lattices)
            yield frame(part, row.take(at), doc.take(at), words, times, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))

    numbered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = materialize(numbered.mapInArrow(split, ddl))
    tail = parts.where("word IS NOT NULL").select("row", "doc_id", "word", "times")
    met = tail.join(rated.select("word", "trained", F.col("lattice").alias("x")), "word").select(
        "row", "doc_id", F.lit(0).cast("long").alias("n"), F.when(F.col("trained") > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * F.log10(F.col("trained") + 1)).alias("base"), (F.col("times") * F.col("x")).alias("lattice"),
    )
    sums = parts.where("word IS NULL").select("row", "doc_id", "n", "n_known", "base", "lattice").unionByName(met)
    ended = 1 if table.ends else 0
    return (
        sums.groupBy("row", "doc_id")
        .agg(*[F.sum(c).alias(c) for c in ("n", "n_known", "base", "lattice")])
        .select(
            "doc_id",
            (crc_mod("doc_id", CLASSES) == HELD_CLASS).alias("held_out"),
            (F.col("n") + 1).alias("n_tokens"),
            (F.col("n_known") + ended).alias("n_known"),
            F.lit(table.train_tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.lit(math.log10(table.ends + 1)) - (F.col("n") + 1) * F.lit(scale)).alias("base_score"),
            *([(F.col("lattice") + F.lit(end / ten)).alias("score")] if lattice_score else []),
        )
    )
