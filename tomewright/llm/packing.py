"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token ids; those longer than a sequence are cut, with the rest in the first piece. Pieces
that fill a sequence stand alone. The others are dealt by hash (with their place in the task, so that repeated
rows part) to shards of a bounded number of pieces, each evolved on several islands: individuals are partitions
of the shard's pieces into bins; crossover injects whole well-filled bins of one parent into the other, removes
the bins that hold the same pieces, exchanges displaced pieces for smaller ones wherever that fills a bin better,
and places the rest by best fit; after each epoch every island sends its elite to the next one, by a shuffle.
A search ends at the lower bound (the tokens over the capacity, rounded up), or where a generation saves no bin: one
rule for all shards, however many there are. The emptiest bins of
all shards are opened again and their pieces dealt to fewer shards, level by level, until one shard is left.

Defined results: null text is the empty document, whose only token is the end token; repeated rows are packed
once each; an empty table gives an empty result; texts of any length are cut into pieces, none of
which is lost; pieces that tie in length may change places, which changes no count of bins; further columns are ignored.
"""

from __future__ import annotations

import base64
import random
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frame, materialize, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
CACHE_ENTRIES = 150_000
#: Bins of a parent that are injected at most.
SECTION = 64
#: Generations without a bin less after which a search ends, whatever the input's size.
PATIENCE = 1
#: Loose pieces up to which pairs of them are tried.
FEW = 64
#: A space whose neighbours are both blank (or that ends a run of blanks) may share a token with them.
JOINED_BLANKS = re.compile(r"\s (?:\s|\Z)")


class Encoder:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes.

    The pattern that precedes the merges always cuts before a single space, so words after such a cut are
    encoded once and remembered; texts with runs of blanks are encoded whole.
    """

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(vocabulary, "rb"))}
        self.model = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = self.whole

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE_ENTRIES:
                    self.clear()
                out = encode(" " + word)
                if len(word) <= 48:
                    self[word] = out
                return out

        self.words = Words()

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if JOINED_BLANKS.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.words.__getitem__, rest))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, pattern: str) -> Encoder:
    if (vocabulary, pattern) not in _ENCODERS:
        _ENCODERS[vocabulary, pattern] = Encoder(vocabulary, pattern)
    return _ENCODERS[vocabulary, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    vocab = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("deal", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(*vocab), 0
        for ids, texts in slices(batches, "doc_id", "text"):
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(ids, texts, strict=True):
                tokens = encode(text or "") + end
                n = len(tokens) // 4
                at, k = 0, 0
                while at < n:
                    upto = at + ((n - at) % capacity or capacity)
                    crc = zlib.crc32(tokens[4 * at : 4 * upto])
                    row += 1
                    deal = xxhash.xxh3_64_intdigest(f"{doc} {k} {crc} {row}") >> 1
                    for column, value in zip(out, (doc, k, at, upto - at, crc, deal), strict=True):
                        column.append(value)
                    at, k = upto, k + 1
            yield frame(schema, *out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Bins:
    """Bins under construction: best fit by a bit set of the residual sizes in use."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.lengths, self.capacity, self.mask = lengths, capacity, 0
        self.of: list[list[list[int]]] = [[] for _ in range(capacity + 1)]

    def add_bin(self, members: list[int]) -> None:
        left = self.capacity - sum(self.lengths[i] for i in members)
        self.of[left].append(members)
        self.mask |= 1 << left

    def best_fit(self, items: list[int]) -> None:
        of, lengths = self.of, self.lengths
        for i in items:
            n = lengths[i]
            fits = self.mask >> n
            if fits:
                left = n + (fits & -fits).bit_length() - 1
                members = of[left].pop()
                if not of[left]:
                    self.mask ^= 1 << left
                members = [*members, i]
            else:
                left, members = self.capacity, [i]
            of[left - n].append(members)
            self.mask |= 1 << (left - n)

    def bins(self) -> list[list[int]]:
        return [m for some in self.of for m in some]


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> float:
    """Mean squared fill: of two packings with as many bins, the one with fuller bins leads further."""
    return sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def exchange(bins: list[list[int]], loose: list[int], lengths: list[int], capacity: int) -> list[int]:
    """Exchange up to two pieces of a bin for one loose piece, or two of few, wherever that fills the bin better; what is loose after it."""
    free = sorted((lengths[i], i) for i in loose)
    moved = True
    while moved and free:
        moved = False
        for b in bins:
            room = capacity - sum(lengths[i] for i in b)
            if not room or not free:
                continue
            gain, out_, in_ = 0, (), ()
            options = [(), *((i,) for i in b), *((i, j) for k, i in enumerate(b) for j in b[k + 1 :])]
            for out in options:
                gone = sum(lengths[i] for i in out)
                most = gone + room
                at = bisect_right(free, (most, 1 << 60)) - 1
                if at >= 0 and free[at][0] - gone > gain:
                    gain, out_, in_ = free[at][0] - gone, out, (free[at],)
                low, high = 0, at if len(free) <= FEW else 0
                while low < high and gain < room:
                    both = free[low][0] + free[high][0]
                    if both > most:
                        high -= 1
                    else:
                        if both - gone > gain:
                            gain, out_, in_ = both - gone, out, (free[low], free[high])
                        low += 1
                if gain == room:
                    break
            if gain:
                for x in in_:
                    free.remove(x)
                b[:] = [i for i in b if i not in out_] + [i for _, i in in_]
                for i in out_:
                    insort(free, (lengths[i], i))
                moved = True
    return [i for _, i in reversed(free)]


def _filled(kept: list[list[int]], loose: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """A packing of kept bins and loose pieces: exchanges, then best fit by falling length."""
    kept = [list(b) for b in kept]
    loose = exchange(kept, loose, lengths, capacity)
    out = Bins(lengths, capacity)
    for b in kept:
        out.add_bin(b)
    out.best_fit(loose)
    return out.bins()


def crossover(into: list[list[int]], donor: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The better filled bins of a random section of ``donor`` replace what holds their pieces in ``into``."""
    order = sorted(donor, key=lambda b: -sum(lengths[i] for i in b))
    best = order[: max(1, len(order) // 2)]
    injected = rng.sample(best, rng.randint(1, min(len(best), SECTION)))
    taken = {i for b in injected for i in b}
    kept = [b for b in into if taken.isdisjoint(b)]
    displaced = [i for b in into if not taken.isdisjoint(b) for i in b if i not in taken]
    return _filled(injected + kept, displaced, lengths, capacity)


def mutate(bins: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Break up the emptiest bins and a few others, and place their pieces again."""
    order = sorted(bins, key=lambda b: sum(lengths[i] for i in b))
    k = max(1, len(bins) // 50)
    broken = order[:k] + rng.sample(order[k:], min(3 * k, len(order) - k))
    gone = {id(b) for b in broken}
    return _filled([b for b in bins if id(b) not in gone], [i for b in broken for i in b], lengths, capacity)


def evolve(population: list[list[list[int]]], lengths: list[int], capacity: int, rng: random.Random, size: int, generations: int) -> list[list[list[int]]]:
    """The fittest ``size`` packings after some generations; stops when one reaches the lower bound, or ``PATIENCE`` of them save no bin."""
    bound = -(-sum(lengths) // capacity)
    scored = [(len(b), -fitness(b, lengths, capacity), b) for b in population]
    noise = 0
    while len(scored) < size:
        out = Bins(lengths, capacity)
        out.best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i] - noise * rng.random()))
        noise = noise * 2 or 16
        b = out.bins()
        scored.append((len(b), -fitness(b, lengths, capacity), b))
        if len(b) <= bound:
            break
    scored.sort(key=lambda x: x[:2])
    idle = 0
    for _ in range(generations):
        if scored[0][0] <= bound or idle == PATIENCE:
            break
        before = scored[0][0]
        first, second = sorted(rng.sample(range(len(scored)), 2)) if len(scored) > 1 else (0, 0)
        a, b = scored[first][2], scored[second][2]
        for child in (crossover(b, a, lengths, capacity, rng), crossover(a, b, lengths, capacity, rng), mutate(a, lengths, capacity, rng)):
            scored.append((len(child), -fitness(child, lengths, capacity), child))
        # The same packing twice would crowd out others.
        scored = sorted({x[:2]: x for x in reversed(scored)}.values(), key=lambda x: x[:2])[:size]
        idle = idle + 1 if scored[0][0] == before else 0
    return [b for _, _, b in scored]


def _to_bytes(bins: list[list[int]], n: int) -> bytes:
    of = np.zeros(n, "<u4")
    for k, b in enumerate(bins):
        of[b] = k
    return of.tobytes()


def _to_bins(blob: bytes) -> list[list[int]]:
    of = np.frombuffer(blob, "<u4")
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.nonzero(np.diff(of[order]))[0] + 1)] if len(of) else []


def _deal(table: pa.Table) -> pa.Table:
    """The order of pieces that all islands and the final placement share."""
    return table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])


def _level(rest: DataFrame, level: int, shards: int, last: bool, capacity: int, islands: int, epochs: int, generations: int, population: int, seed: int) -> DataFrame:
    """``rest`` with sequence_id, offset and again: whether the piece is in a bin to be opened on the next level."""
    rest = rest.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), "deal"), F.lit(shards)))
    schema = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("lengths", pa.binary()), ("bins", pa.binary())])
    ddl = "shard long, island int, lengths binary, bins binary"

    def state(shard: int, population_: list[list[list[int]]], lengths: list[int], island: int) -> pa.Table:
        blob = np.array(lengths, "<u2").tobytes()
        best = [_to_bytes(b, len(lengths)) for b in population_]
        # The elite goes to the next island too.
        rows = [(island, b) for b in best] + ([((island + 1) % islands, best[0])] if islands > 1 else [])
        return pa.Table.from_batches([frame(schema, [shard] * len(rows), [k for k, _ in rows], [blob] * len(rows), [b for _, b in rows])])

    def start(key: tuple, table: pa.Table) -> pa.Table:
        shard, island = key[0].as_py(), key[1].as_py()
        lengths = _deal(table).column("length").to_pylist()
        rng = random.Random(f"{seed}/{level}/{shard}/{island}/0")
        return state(shard, evolve([], lengths, capacity, rng, population, generations), lengths, island)

    def step(epoch: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            shard, island = key[0].as_py(), key[1].as_py()
            lengths = np.frombuffer(table.column("lengths")[0].as_py(), "<u2").tolist()
            blobs = sorted(table.column("bins").to_pylist())
            rng = random.Random(f"{seed}/{level}/{shard}/{island}/{epoch}")
            return state(shard, evolve([_to_bins(b) for b in blobs], lengths, capacity, rng, population, generations), lengths, island)

        return run

    def place(key: tuple, pieces_: pa.Table, states: pa.Table) -> pa.Table:
        table = _deal(pieces_)
        lengths = table.column("length").to_pylist()
        found = [_to_bins(b) for b in sorted(states.column("bins").to_pylist())]
        best = min(found, key=lambda b: (len(b), -fitness(b, lengths, capacity)))
        fill = [sum(lengths[i] for i in b) for b in best]
        # The emptiest bin, and all that a fiftieth of the capacity is free in.
        emptiest = min(range(len(best)), key=fill.__getitem__)
        sequence, offset, again = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        for k, members in enumerate(best):
            at = 0
            for i in members:
                sequence[i], offset[i], again[i] = k, at, not last and (k == emptiest or 50 * (capacity - fill[k]) > capacity)
                at += lengths[i]
        # Level, shard and bin in one number; sequences of full pieces are negative.
        ids = sequence + (key[0].as_py() << 20) + (level << 56)
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("again", pa.array(again))

    columns = [c.split()[0] for c in PIECES.split(", ")]
    dealt = rest.select("shard", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), *columns)
    world = dealt.groupBy("shard", "island").applyInArrow(start, ddl)
    for epoch in range(1, epochs):
        world = world.groupBy("shard", "island").applyInArrow(step(epoch), ddl)
    return rest.select("shard", *columns).groupBy("shard").cogroup(world.groupBy("shard")).applyInArrow(place, PIECES + ", sequence_id long, offset long, again boolean")


def pack(
    items: DataFrame,
    capacity: int = 1024,
    shard_pieces: int = 4096,
    islands: int = 2,
    epochs: int = 2,
    generations: int = 12,
    population: int = 4,
    seed: int = 11,
) -> DataFrame:
    """``items`` (columns of PIECES, none longer than the capacity) with sequence_id and offset."""
    items = materialize(items)
    full = items.where(F.col("length") >= capacity)
    rest = items.where(F.col("length") < capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = [full.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    level, left = 0, rest.count()
    while left:
        shards = max(1, -(-left // shard_pieces))
        found = materialize(_level(rest, level, shards, shards == 1, capacity, islands, epochs, generations, population, seed))
        done.append(found.where("NOT again").select(*columns, "sequence_id", "offset"))
        rest = found.where("again").drop("sequence_id", "offset", "again")
        level, before, left = level + 1, left, 0 if shards == 1 else rest.count()
        # Levels shrink; pieces that no level places better stay as the last one has them.
        if left > before // 2:
            done.append(found.where("again").select(*columns, "sequence_id", "offset"))
            break
    return reduce(DataFrame.unionByName, done)


def pack_documents(docs: DataFrame, capacity: int = 1024, **options) -> DataFrame:
    return pack(pieces(docs, capacity), capacity, **options)
