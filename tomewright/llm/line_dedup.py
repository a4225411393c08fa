"""Fuzzy line deduplication: window SimHashes as pigeonhole blocks, edit similarity, one occurrence per connected group.

Lines are normalised (lower case, digits as one, words only); equal lines meet by hash and count as one. The
SimHash of every window of three words of a line (taken around its end) is a block: an edit of a word touches at
most three of n blocks, so a line and one at the least similarity have some in common. Each distinct line is
posted under the ``POSTED`` blocks of least rank, those of few letters last, and lines meet in the postings that
two or more share: of pairs at exactly the least similarity, edits spread as evenly as can be, 94 in 100 or more do. The pairs of a posting are compared by the parity of their words, which no similar pair can
fail; of what is left the words are fetched and compared by edit similarity (0.8 or more): one pair per two
unconnected groups, each pair in one posting only, so a posting gives the links of a spanning forest and not all
pairs. Postings longer than ``BLOCK`` are dealt to tasks as pairs of parts. Of each connected group the first
occurrence by (id, line) stays.

Defined results: lines below ``min_words`` words and ``min_chars`` letters always stay; of lines below five words
only equal ones are similar; a null text stays null; rows agreeing in id and text are one occurrence and keep
the same lines; rows without an id come last; a text that loses all its lines is dropped from the documents; an
empty table gives an empty result; further columns stay as they are, whatever their names, and n_chars, where
there is one, follows the text. Texts and lines are read whole at any length; of lines that tie in (id, text, line) one
occurrence counts. Equal lines, and equal words of a pair of lines, are told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stretches, discard, frame, fresh, materialize, mixed, only_marked, slices
from .components import connected_components
from .postings import UNIT, by_unit, read_units, spans, units

SIMILARITY = 0.8
#: Words of a window, blocks that a line is posted under, letters below which a window ranks last.
WIDTH, POSTED, FEW_LETTERS = 3, 6, 16
#: Lines of a posting, or of each of two parts of a longer one, that are compared in one task.
BLOCK = 512
#: Pairs per 64 words below which they are compared one by one, words of such pairs in an array, and pairs looked at together.
FEW_PAIRS, CELLS, PAIRS = 16, 1 << 20, 500_000
_NONE = np.uint64(2**64 - 1)
_TABLE = bytes(10 if c == 10 else 48 if 48 <= c < 58 else c + 32 if 65 <= c < 91 else c if c == 95 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower case, digits as 0, every other sign below 128 as a space; line feeds stay."""
    return (text if text.isascii() else text.lower()).encode("utf-8", "surrogatepass").translate(_TABLE)


def normalise(line: str) -> list[bytes]:
    return plain(line).split()


def window_blocks(hashes: np.ndarray, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of ``POSTED`` ranks per line from the hashes and lengths of its words; lines have at least ``WIDTH`` words."""
    start = np.cumsum(sizes) - sizes
    first, n = np.repeat(start, sizes), np.repeat(sizes, sizes)
    at = np.arange(len(hashes)) - first
    follows = [first + np.where(at + k < n, at + k, at + k - n) for k in range(1, WIDTH)]
    a, (b, c) = hashes, (hashes[f] for f in follows)
    # The SimHash of three words: each bit as most of them have it.
    rank = mixed((a & b) | (b & c) | (a & c)) >> np.uint64(1)
    short = letters + sum(letters[f] for f in follows) < FEW_LETTERS
    rank |= short.astype(np.uint64) << np.uint64(63)
    out = np.empty((len(sizes), POSTED), np.uint64)
    for k in range(POSTED):
        out[:, k] = np.minimum.reduceat(rank, start)
        rank[rank == np.repeat(out[:, k], sizes)] = _NONE
    return out


def lines_of(texts: list[str | None], min_words: int, min_chars: int) -> tuple[np.ndarray, ...]:
    """(text, line, key, words, parity, blocks) of the lines that can be duplicates, by place in ``texts``."""
    raws = [plain(t or "") for t in texts]
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    inside = data > 32
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    begin, end = edges[::2], edges[1::2]
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, begin)
    hashes = mixed(Stretches(data).of(begin, end))
    letters = np.concatenate(([0], np.cumsum(inside & ((data & 0xC0) != 0x80))))
    letters = letters[end] - letters[begin]
    n = np.bincount(line, minlength=len(breaks))
    chars = np.bincount(line, weights=letters, minlength=len(breaks))
    wanted = (n >= min_words) | ((n > 0) & (chars >= min_chars))
    chosen = np.flatnonzero(wanted)
    upto = np.cumsum(n)
    keys = mixed(Stretches(hashes).of(upto[chosen] - n[chosen], upto[chosen]) + n[chosen].astype(np.uint64))
    blocks = np.full((len(chosen), POSTED), _NONE)
    odd = np.zeros((len(chosen), 2), np.uint64)
    near = n[chosen] >= 5
    if near.any():
        ours = (wanted & (n >= 5))[line]
        h, sizes = hashes[ours], n[chosen[near]]
        blocks[near] = window_blocks(h, letters[ours], sizes)
        bit = np.uint64(1) << (h & np.uint64(63))
        high = (h >> np.uint64(6) & np.uint64(1)).astype(bool)
        for k, half in enumerate((~high, high)):
            odd[near, k] = np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), np.cumsum(sizes) - sizes)
    starts = np.cumsum([0] + [r.count(b"\n") + 1 for r in raws])
    text = np.searchsorted(starts, chosen, side="right") - 1
    return text, chosen - starts[text], keys, n[chosen], odd, blocks


def parity(words: list[bytes]) -> bytes:
    """512 bits: whether the words of each bit are odd in number. An edit changes two of them at most."""
    return reduce(xor, [1 << (xxhash.xxh3_64_intdigest(w) & 511) for w in words], 0).to_bytes(64, "little")


def edit_similar(a: list, b: list, least: float = SIMILARITY) -> bool:
    """Whether the word edit distance is at most (1 - least) of the longer line (bit-parallel recurrence)."""
    n, m = len(a), len(b)
    allowed = int((1 - least) * max(n, m) + 1e-9)
    if abs(n - m) > allowed:
        return False
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = full, 0, n
    for w in b:
        eq = where.get(w, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        gained = down | ~(diagonal | up) & full
        lost = up & diagonal
        if gained & top:
            distance += 1
        elif lost & top:
            distance -= 1
        gained = gained << 1 | 1
        up = (lost << 1 | ~(diagonal | gained)) & full
        down = gained & diagonal & full
    return distance <= allowed


def row_digest() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


BLOCKS = [f"b{k}" for k in range(POSTED)]
#: 128 bits: whether the words of each bit are odd in number.
ODD = ["odd0", "odd1"]
#: Where a line is.
PLACE = ["doc_id", "digest", "line"]


def line_table(docs: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """(digest, doc_id, line, key, words, odd0, ..., b0, ...): the lines that can be duplicates, with their number of words."""
    names = [*ODD, *BLOCKS]
    schema = pa.schema([("digest", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("key", pa.int64()), ("words", pa.int32()), *[(b, pa.int64()) for b in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few texts at once, so that their arrays stay in a core's cache.
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                text, line, key, n, odd, blocks = lines_of(part.column("text").to_pylist(), min_words, min_chars)
                own = part.take(pa.array(text))
                yield frame(schema, own.column("digest"), own.column("doc_id"), line, key.view(np.int64), n, *odd.view(np.int64).T, *blocks.view(np.int64).T)

    ddl = "digest long, doc_id long, line int, key long, words int, " + ", ".join(f"{b} long" for b in names)
    return docs.select(row_digest().alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def first_posting(posted: list[np.ndarray], a: np.ndarray, b: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Which pairs of rows (places) have no common block below that of their posting, so that no other posting compares them."""
    out = np.ones(len(a), bool)
    for x in posted:
        below = (x[a] < block[a]) & (x[a] != -1)
        for y in posted:
            out &= ~(below & (x[a] == y[b]))
    return out


def shared_blocks(distinct: DataFrame) -> DataFrame:
    """(key, block): the postings that two lines or more are in. Rows are told by those beside them, so a long posting is never held."""
    schema = pa.schema([("key", pa.int64()), ("block", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row of what came before waits for the first of what follows.
        held = [np.zeros(0, np.int64)] * 2
        again = False
        for batch in chain(batches, [None]):
            new = held if batch is None else [np.concatenate((x, batch.column(c).to_numpy())) for x, c in zip(held, schema.names, strict=True)]
            if not len(new[1]):
                continue
            same = np.concatenate(([again], new[1][1:] == new[1][:-1], [False]))
            upto = len(new[1]) if batch is None else -1
            met = np.flatnonzero((same[:-1] | same[1:])[:upto])
            if len(met):
                yield frame(schema, *[x[met] for x in new])
            held, again = [x[-1:] for x in new], same[-2]

    rows = distinct.select("key", F.explode(F.array(*BLOCKS)).alias("block")).where(F.col("block") != -1)
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "key long, block long")


def candidates(distinct: DataFrame) -> DataFrame:
    """(block, key, part, left, right, n, doc_id, digest, line, b0, ...): units of work, without the lines that nothing in their unit can be similar to and meets there first."""
    met = units(materialize(shared_blocks(distinct)), ["block"], "key", BLOCK).join(distinct, "key")
    longs = ["n", "doc_id", "digest"]
    schema = pa.schema([("block", pa.int64()), ("key", pa.int64()), *[(c, pa.int32()) for c in UNIT], *[(c, pa.int64()) for c in longs], ("line", pa.int32()), *[(b, pa.int64()) for b in BLOCKS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, upto in read_units(batches, ["block"]):
            n = table.column("words").to_numpy().astype(np.int64)
            odd = [table.column(c).to_numpy().view(np.uint64) for c in ODD]
            part = table.column("part").to_numpy()
            block = table.column("block").to_numpy()
            posted = [table.column(c).to_numpy() for c in BLOCKS]
            cross = (table.column("left").to_numpy() != table.column("right").to_numpy())
            keep = np.zeros(len(n), bool)
            # Each row with the next, the one after it, and so on to the end of its unit, all units at once.
            at, step = np.flatnonzero(np.arange(len(n)) + 1 < upto), 1
            while len(at):
                other = at + step
                longer = np.maximum(n[at], n[other])
                near = np.bitwise_count(odd[0][at] ^ odd[0][other]).astype(np.int64) + np.bitwise_count(odd[1][at] ^ odd[1][other]) <= 2 * (longer // 5)
                near &= (np.minimum(n[at], n[other]) >= SIMILARITY * longer - 1e-6) & (~cross[at] | (part[at] != part[other]))
                a, b = at[near], other[near]
                first = first_posting(posted, a, b, block)
                keep[a[first]] = keep[b[first]] = True
                step += 1
                at = at[at + step < upto[at]]
            if keep.any():
                yield from table.select(schema.names).filter(pa.array(keep)).cast(schema).combine_chunks().to_batches()

    ddl = "block long, key long, part int, left int, right int, n long, doc_id long, digest long, line int, " + ", ".join(f"{b} long" for b in BLOCKS)
    return by_unit(met, ["block"]).mapInArrow(run, ddl)


def words_of(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The words of ``lines`` one after the other."""
    n = sizes[lines]
    return flat[np.arange(n.sum()) + np.repeat(start[lines] - (np.cumsum(n) - n), n)]


def shares(pairs: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``pairs`` in parts of about CELLS words."""
    ends = np.cumsum(sizes[pairs])
    return np.split(pairs, np.flatnonzero(np.diff(ends // CELLS)) + 1) if len(pairs) else []


def unlike_in_place(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words of pairs of equally long lines differ from that in the same place: the edit distance at most."""
    unlike = words_of(flat, start, sizes, a) != words_of(flat, start, sizes, b)
    return np.add.reduceat(unlike, np.cumsum(sizes[a]) - sizes[a], dtype=np.int64)


def common_words(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words pairs of lines have in common wherever they stand, repeats counted; all others of b are edits.

    Words are told by 40 bits here, beside the number of their line or pair; words told as one only add to what is common.
    """
    bits = 40
    low = (1 << bits) - 1
    lines, own = np.unique(b, return_inverse=True)
    there = np.sort(np.repeat(np.arange(len(lines)) << bits, sizes[lines]) | (words_of(flat, start, sizes, lines) & low))
    n = sizes[a]
    word = np.sort(np.repeat(np.arange(len(a)) << bits, n) | (words_of(flat, start, sizes, a) & low))
    # Which of its equals in a line a word is: the second one needs a second one.
    at = np.arange(len(word))
    nth = at - np.maximum.accumulate(np.where(np.diff(word, prepend=-1) != 0, at, 0))
    word = np.repeat(own << bits, n) | (word & low)
    place = np.searchsorted(there, word) + nth
    found = there[np.minimum(place, len(there) - 1)] == word
    return np.add.reduceat(found & (place < len(there)), np.cumsum(n) - n, dtype=np.int64)


def similar_pairs(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``edit_similar`` of many pairs of lines (places), a's lines the shorter ones, from hashes of words and where each line has them.

    Pairs with few words unlike in place are similar, pairs with few words in common are not. Others of like length are
    gone through at once, a word of each per step, in blocks of 64 words (Myers' recurrence).
    """
    allowed = ((1 - SIMILARITY) * sizes[b] + 1e-9).astype(np.int64)
    out = np.zeros(len(a), bool)
    for some in shares(np.flatnonzero(sizes[a] == sizes[b]), sizes[a]):
        out[some] = unlike_in_place(flat, start, sizes, a[some], b[some]) <= allowed[some]
    open_ = ~out
    for some in shares(np.flatnonzero(open_), sizes[a]):
        open_[some] = sizes[b[some]] - common_words(flat, start, sizes, a[some], b[some]) <= allowed[some]
    blocks = (sizes[a] + 63) // 64
    for deep in np.unique(blocks[open_]).tolist():
        ours = np.flatnonzero(open_ & (blocks == deep))
        ours = ours[np.argsort(-sizes[b[ours]], kind="stable")]
        most = max(1, CELLS // (64 * deep))
        for some in (ours[k : k + most] for k in range(0, len(ours), most)):
            if len(some) < FEW_PAIRS * deep:
                for k in some.tolist():
                    x, y = (flat[start[i] : start[i] + sizes[i]].tolist() for i in (a[k], b[k]))
                    out[k] = edit_similar(x, y)
            else:
                out[some] = _distances(flat, start, sizes, a[some], b[some], deep) <= allowed[some]
    return out


def _distances(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, deep: int) -> np.ndarray:
    """Word edit distances of pairs in descending order of b's words, whose a's have up to 64 * deep."""
    one = np.uint64(1)
    n, m = sizes[a], sizes[b]
    left = np.full((len(a), 64 * deep), -1)
    left[np.arange(64 * deep) < n[:, None]] = flat[np.repeat(start[a] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    # How many pairs have a j-th word in b.
    active = np.searchsorted(-m, -np.arange(int(m[0])), side="left").tolist()
    up = [np.full(len(a), _NONE) for _ in range(deep)]
    down = [np.zeros(len(a), np.uint64) for _ in range(deep)]
    last, top = (n - 1) // 64, ((n - 1) % 64).astype(np.uint64)
    distance = n.copy()
    for j, k in enumerate(active):
        same = np.packbits(left[:k] == flat[start[b[:k]] + j][:, None], axis=1, bitorder="little").view(np.uint64)
        gained_in, lost_in = one, np.uint64(0)
        for d in range(deep):
            pv, mv, eq = up[d][:k], down[d][:k], same[:, d]
            vertical = eq | mv
            eq = eq | lost_in
            diagonal = (((eq & pv) + pv) ^ pv) | eq
            gained = mv | ~(diagonal | pv)
            lost = pv & diagonal
            ends = last[:k] == d
            distance[:k] += ends * ((gained >> top[:k] & one).astype(np.int64) - (lost >> top[:k] & one).astype(np.int64))
            gained_out, lost_out = gained >> np.uint64(63), lost >> np.uint64(63)
            gained, lost = gained << one | gained_in, lost << one | lost_in
            up[d][:k] = lost | ~(vertical | gained)
            down[d][:k] = gained & vertical
            gained_in, lost_in = gained_out, lost_out
    return distance


def near_pairs(upto: np.ndarray, sizes: np.ndarray, part: np.ndarray, cross: np.ndarray, bits: np.ndarray, posted: list[np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lines of one unit, from lines in order of their number of words, that may be similar and meet there first; by the second."""
    a, b = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    at, step = np.flatnonzero(np.arange(len(sizes)) + 1 < upto), 1
    while len(at):
        other = at + step
        near = (sizes[at] >= SIMILARITY * sizes[other] - 1e-6) & (~cross[at] | (part[at] != part[other]))
        x, y = at[near], other[near]
        allowed = ((1 - SIMILARITY) * sizes[y] + 1e-9).astype(np.int64)
        close = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= 2 * allowed
        x, y = x[close], y[close]
        first = first_posting(posted, x, y, block)
        a.append(x[first].astype(np.int32))
        b.append(y[first].astype(np.int32))
        step += 1
        at = at[at + step < upto[at]]
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((a, b))
    return a[order], b[order]


def forest(a: np.ndarray, b: np.ndarray, n: int, similar: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs, in order of ``b``, that are similar; of ``n`` places each is compared with 1, 2, 4, ... others at once."""
    comp = np.arange(n)
    out = []
    most = 1
    while len(a):
        heads = np.append(0, np.flatnonzero(np.diff(b)) + 1)
        now = np.arange(len(b)) - np.repeat(heads, np.diff(np.append(heads, len(b)))) < most
        x, y = a[now], b[now]
        found = similar(x, y)
        for i, j in zip(x[found].tolist(), y[found].tolist(), strict=True):
            if comp[i] != comp[j]:
                comp[comp == comp[j]] = comp[i]
                out.append((i, j))
        a, b = a[~now], b[~now]
        apart = comp[a] != comp[b]
        a, b = a[apart], b[apart]
        most *= 2
    return out


def unit_links(table: pa.Table, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): keys of the links of a spanning forest of what is similar in each unit of ``table``.

    Lines of one part meet only where all are of one; a pair is compared under the least of its common blocks.
    """
    words = [w.split() for w in table.column("words").to_pylist()]
    keys = table.column("key").to_numpy()
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.lexsort((keys, sizes, upto))
    # Words are told by 64-bit hashes, none of which is -1.
    flat = np.fromiter(map(hash, chain.from_iterable(words[i] for i in order.tolist())), np.int64, sizes.sum())
    del words
    keys, sizes = keys[order], sizes[order]
    start = np.cumsum(sizes) - sizes
    # 512 bits: whether the words of each bit are odd in number. An edit changes two of them at most.
    bit = np.uint64(1) << (flat & 63).astype(np.uint64)
    bits = np.stack([np.bitwise_xor.reduceat(np.where(flat >> 6 & 7 == k, bit, np.uint64(0)), start) for k in range(8)], axis=1)
    part = table.column("part").to_numpy()[order]
    least, most = (np.empty(len(part), np.int64) for _ in range(2))
    for i, j in spans(upto):
        least[i:j], most[i:j] = part[i:j].min(), part[i:j].max()
    posted = list(np.frombuffer(b"".join(table.column("blocks").to_pylist()), "<i8").reshape(-1, POSTED)[order].T)
    a, b = near_pairs(upto, sizes, part, least != most, bits, posted, table.column("block").to_numpy()[order])
    links = np.array(forest(a, b, len(keys), lambda x, y: similar_pairs(flat, start, sizes, x, y)), np.int64).reshape(-1, 2)
    return keys[links[:, 0]], keys[links[:, 1]]


def few_pairs(table: pa.Table, upto: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The same units, so many at once that they have at most PAIRS pairs, or one that has more."""
    first = pairs = 0
    for start, stop in spans(upto):
        own = (stop - start) * (stop - start - 1) // 2
        if start > first and pairs + own > PAIRS:
            yield table.slice(first, start - first), upto[first:start] - first
            first, pairs = start, 0
        pairs += own
    yield table.slice(first), upto[first:] - first


def verified_links(members: DataFrame) -> DataFrame:
    """(a, b) links of keys from (block, left, right, part, key, blocks, words): those of each unit of work."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Words are held as lists here, so few rows at once.
        for whole, ends in read_units(batches, ["block"], 8_000):
            for table, upto in few_pairs(whole, ends):
                yield frame(schema, *unit_links(table, upto))

    return by_unit(members, ["block"]).mapInArrow(run, "a long, b long").distinct()


def line_words(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, blocks, words): normalised lines of (digest, line, key, b0, ...), each place read once."""
    wanted = materialize(places.groupBy("digest").agg(F.collect_list(F.struct("line", "key", *BLOCKS)).alias("wanted")))
    schema = pa.schema([("key", pa.int64()), ("blocks", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, asked in slices(batches, "text", "wanted"):
            keys, blocks, words = [], [], []
            for text, some in zip(texts, asked, strict=True):
                own = plain(text or "").split(b"\n")
                for x in some:
                    keys.append(x["key"])
                    blocks.append(np.array([x[b] for b in BLOCKS], "<i8").tobytes())
                    words.append(b" ".join(own[x["line"]].split()))
            yield frame(schema, keys, blocks, words)

    texts = only_marked(docs.select(row_digest().alias("digest"), "text"), wanted, "digest")
    return texts.join(wanted, "digest").select("text", "wanted").mapInArrow(run, "key long, blocks binary, words binary").dropDuplicates(["key"])


def removed_lines(docs: DataFrame, min_words: int = 5, min_chars: int = 30) -> DataFrame:
    """(digest, lines): numbers of the lines that go, per row digest."""
    lines = materialize(line_table(docs, min_words, min_chars), dictionary=False)
    # Of equal lines any place tells the words; their other columns are the same.
    each = [F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in PLACE[1:]], *[F.min(c).alias(c) for c in ("words", *ODD, *BLOCKS)]]
    distinct = materialize(lines.groupBy("key").agg(*each), dictionary=False)
    met = materialize(candidates(distinct))
    places = met.select("key", "n", *PLACE, *BLOCKS).dropDuplicates(["key"])
    links = verified_links(met.select("block", *UNIT, "key").join(line_words(docs, places), "key"))
    groups = connected_components(links).select(F.col("node").alias("key"), F.col("component"))
    # A line that occurs once and is like no other neither goes nor lets one go.
    # The joins of all occurrences are by key alone, with nothing behind them by key, so that Spark can split a frequent line's.
    several = lines.select("key", *PLACE).join(distinct.where("n > 1").select("key"), "key").unionByName(places.where("n = 1").select("key", *PLACE))
    several = materialize(several)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), *PLACE)).alias("first")
    rooted = several.groupBy("key").agg(first).join(groups, "key", "left").select("key", "first", F.coalesce("component", "key").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    losing = rooted.join(firsts, "root").select("key", F.col("kept.digest").alias("kept_digest"), F.col("kept.line").alias("kept_line"))
    gone = several.join(losing, "key").where((F.col("digest") != F.col("kept_digest")) | (F.col("line") != F.col("kept_line")))
    out = materialize(gone.groupBy("digest").agg(F.collect_set("line").alias("lines")))
    for table in (lines, distinct, met, several):
        discard(table)
    return out


def _applied(docs: DataFrame, **options) -> tuple[DataFrame, str, str]:
    """``docs`` with the numbers of the lines that go and the array of those that stay, both null where none goes."""
    digest, gone, kept = fresh(docs, "digest", "gone", "kept")
    found = removed_lines(docs.select("doc_id", "text"), **options).select(F.col("digest").alias(digest), F.col("lines").alias(gone))
    joined = docs.withColumn(digest, row_digest()).join(found, digest, "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i))
    return joined.withColumn(kept, F.when(F.col(gone).isNotNull(), left)), gone, kept


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without repeated lines; texts with nothing left are dropped."""
    found, gone, kept = _applied(docs, **options)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(text).cast(t)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes]
    return found.where(F.col(gone).isNull() | (F.size(kept) > 0)).select(*columns)


def line_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the remaining text of every row of ``docs``."""
    found, gone, kept = _applied(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), **options)
    return found.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).cast("binary"), 256).alias("kept_sha256"),
    )
