"""MinHash near-duplicates by bottom-k sketches of one hash function.

A document's set is its distinct two-word shingles, hashed once; its sketch is the ``SKETCH`` smallest of them. Two
sets of resemblance 0.8 agree in four of five of the values that either of them retains, in hash order. So each of
a sketch's first ``POSTED`` values is posted together with its successor, and lists of such runs of two generate the
overlaps: small sets that qualify have a common run for certain (their commons outnumber the gaps between them four
times), larger ones miss all 31 runs once in 10^9. Two values in a row are shared far less by chance than one, which
keeps the lists of frequent words short.

What a list generates is filtered by the resemblance estimated from the union's sketch (a pair is let go at more than
``SIGMAS`` standard errors below the threshold), and what is left is verified on whole sets, exactly. In a first round
each node meets one leader of its lists only, which joins groups of near copies at a cost in proportion to them. Then
lists that still hold several components are compared in units of bounded size; of a long list's largest component no
two rows are compared. A pair belongs to the unit of its first common run, rows that have a pair left after the
estimate are given their whole sets there, and all intersections of a unit come from one matrix product. A unit gives a
spanning forest of its links, never all pairs.

Defined results: a null or blank text has an empty set, which links with nothing, copies included; a text of one word
has one shingle; texts of equal sets are copies; rows that repeat an id are documents of their own; a null id is linked
as any other and is the component's only where no row of it has an id; texts are read whole at any length; an empty table
gives an empty result; of other columns no notice is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, frame, materialize, only_marked, slices
from .components import connected_components
from .postings import by_unit, read_units, spans
from .simhash import shingles

#: Retained values of a sketch, each as the upper 32 bits of its hash.
SKETCH = 128
#: Retained values that are posted, each with the next.
POSTED = 32
#: Standard errors by which an estimate may be below the threshold.
SIGMAS = 5.5
#: Rows of a list, or of each of two parts of a longer one, that are compared in one unit.
BLOCK = 1024
#: Lists in which a node must meet a leader to be compared with it first.
LED = 4
#: Members of a leader that are verified in one group.
VERIFIED = 256
PERCENT = 80
#: Stands behind the values of a short sketch; no value is as large.
PAD = np.uint32(0xFFFFFFFF)
#: Rows of a unit up to which all its pairs are merged; above, overlaps are counted first.
FEW = 6
#: Pairs merged at once.
MERGED = 8192


def distinct_shingles(texts: list[str | None], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(sets, digests): ascending distinct shingle hashes of each text, and a hash of each set."""
    hashes, counts, _ = shingles(texts, width)
    sets = [np.unique(h) for h in np.split(hashes, np.cumsum(counts)[:-1])]
    digests = np.array([np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15)) ^ s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
    return sets, digests


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """A row per document: doc_id, row (a hash of its text), node (of its set), n (its size), sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, texts in slices(batches, "doc_id", "row", "text"):
            sets, digests = distinct_shingles(texts, width)
            made = [np.minimum(s[:SKETCH] >> np.uint64(32), PAD - 1).astype(np.uint32).tobytes() for s in sets]
            yield frame(schema, ids, rows, digests.view(np.int64), [len(s) for s in sets], made)

    return docs.mapInArrow(run, "doc_id long, row long, node long, n long, sketch binary")


def posted(groups: DataFrame) -> DataFrame:
    """(key, node, n): a row per run of two of the first retained values, of lists where a set of fitting size has the run too.

    In the order of sizes a row's neighbours are the nearest of its list, so what fits neither of them fits none.
    Sets below four shingles link with none but copies.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, sizes, made in slices(batches, "node", "n", "sketch", step=2000):
            values = [np.frombuffer(s, np.uint32)[:POSTED].astype(np.uint64) for s in made]
            keys = [v[:-1] << np.uint64(32) | v[1:] for v in values]
            counts = [len(k) for k in keys]
            if sum(counts):
                yield frame(schema, np.concatenate(keys).view(np.int64), np.repeat(nodes, counts), np.repeat(sizes, counts))

    rows = groups.where("n > 3").select("node", "n", "sketch").mapInArrow(run, "key long, node long, n long")
    by_size = Window.partitionBy("key").orderBy("n", "node")
    near = F.coalesce(100 * F.lag("n").over(by_size) >= PERCENT * F.col("n"), F.lit(False)) | F.coalesce(PERCENT * F.lead("n").over(by_size) <= 100 * F.col("n"), F.lit(False))
    return rows.withColumn("near", near).where("near").drop("near")


def margin(n_union, whole):
    """How far below the threshold an estimate from so many values may be: a rounding where both sketches are whole sets."""
    t = PERCENT / 100
    return np.where(whole, 1 / n_union, SIGMAS * np.sqrt(t * (1 - t) / n_union))


def resemblances(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Per pair of sketches (rows of SKETCH values, PAD behind the first n) the estimate, or -1 where that is too low for a link.

    Both sketches are merged in order; a value of both stands twice, and the first SKETCH different ones are the union's.
    """
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != PAD)
    rank = np.cumsum(~twice, axis=1)
    whole = np.maximum(na, nb) < SKETCH
    union = na + nb - twice.sum(axis=1)
    within = np.where(whole, union, np.minimum(union, SKETCH))
    found = (twice & (rank <= within[:, None])).sum(axis=1) / np.maximum(within, 1)
    return np.where(found >= PERCENT / 100 - margin(np.maximum(within, 1), whole), found, -1.0)


def padded(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches as rows of SKETCH values, and how many each has."""
    lengths = np.array([len(s) // 4 for s in sketches], np.int64)
    out = np.full((len(sketches), SKETCH), PAD, np.uint32)
    out[np.repeat(np.arange(len(sketches)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.frombuffer(b"".join(sketches), np.uint32)
    return out, lengths


def _sizes_fit(a: str, b: str):
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)) & (F.col("a") != F.col("b"))


def led(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): each node with the list leader (b) that it meets in most lists, if in several, and if sizes and sketches allow a link.

    One pair per node, to join what is alike at little cost; no pair is lost by what is left out here.
    """
    leaders = posts.groupBy("key").agg(F.min(F.struct("node", "n")).alias("l")).select("key", F.col("l.node").alias("b"), F.col("l.n").alias("nb"))
    met = posts.join(leaders, "key").select(F.col("node").alias("a"), F.col("n").alias("na"), "b", "nb").where(_sizes_fit("na", "nb")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("lists"))
    pairs = met.where(F.col("lists") >= LED).groupBy("a").agg(F.max_by("b", F.struct("lists", "b")).alias("b"))
    own = groups.select("node", "sketch")

    @F.arrow_udf("boolean")
    def passes(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), MERGED):
            (x, nx), (y, ny) = (padded(c.slice(at, MERGED).to_pylist()) for c in (a, b))
            out[at : at + MERGED] = resemblances(x, y, nx, ny) >= 0
        return pa.array(out)

    both = pairs.join(own.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a").join(own.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b")
    return both.where(passes("sa", "sb")).select("a", "b")


def shared_values(row: np.ndarray, place: np.ndarray, many: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of ``n`` rows share: of each value's list, all its members get one more in common.

    ``row`` and ``place`` are the rows and values of all entries, ``many`` how often each value stands.
    """
    shared = many > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    row, place = row[keep], number[place[keep]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    width = 2048
    for first in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(place, (first, first + width))
        held = np.zeros((n, min(width, int(shared.sum()) - first)), np.float32)
        held[row[low:high], place[low:high] - first] = 1
        out += held @ held.T
    return out


def overlaps(sketches: np.ndarray) -> np.ndarray:
    """Retained values that each two sketches share."""
    row, _ = at = np.nonzero(sketches != PAD)
    _, place, many = np.unique(sketches[at], return_inverse=True, return_counts=True)
    return shared_values(row, place, many, len(sketches))


def first_met(sketches: np.ndarray, key: int) -> np.ndarray:
    """Which two rows of a list have no common run of retained values before that of the list."""
    values = sketches[:, :POSTED].astype(np.uint64)
    runs = values[:, :-1] << np.uint64(32) | values[:, 1:]
    row, _ = at = np.nonzero((runs < np.uint64(key)) & (values[:, 1:] != PAD))
    if not len(row):
        return np.ones((len(sketches), len(sketches)), bool)
    _, place, many = np.unique(runs[at], return_inverse=True, return_counts=True)
    held = np.zeros((len(sketches), int((many > 1).sum())), np.float32)
    keep = many[place] > 1
    held[row[keep], (np.cumsum(many > 1) - 1)[place[keep]]] = 1
    return held @ held.T == 0


def candidates(sketches: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, comps: np.ndarray, parts: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a unit's pairs that meet here first, are of two components (of both parts, if there are two), and may link by size and overlap."""
    i, j = np.triu_indices(len(sizes), 1)
    fit = (comps[i] != comps[j]) & (100 * np.minimum(sizes[i], sizes[j]) >= PERCENT * np.maximum(sizes[i], sizes[j]))
    if parts.min() < parts.max():
        fit &= parts[i] != parts[j]
    if fit.any():
        fit &= first_met(sketches, key)[i, j]
    if len(sizes) > FEW and fit.any():
        # An estimate is at most the overlap by the larger sketch, and its margin at most that of as many values.
        larger = np.maximum(lengths[i], lengths[j])
        fit &= overlaps(sketches)[i, j] >= (PERCENT / 100 - margin(larger, larger < SKETCH)) * larger
    return i[fit], j[fit]


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, node, n, comp) of the lists with several components, dealt to units (part, left, right).

    A list of up to BLOCK rows is one unit. In a longer one the rows of its largest component never meet each other: they
    are cut into parts of BLOCK rows, all others into parts too, and each part of the others meets every part.
    """
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n_own"))
    lists = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("n_comps"), F.sum("n_own").alias("n_rows"), F.max(F.struct("n_own", "comp")).alias("most")).where("n_comps > 1")
    p_rest = F.ceil((F.col("n_rows") - F.col("most.n_own")) / BLOCK).cast("int")
    p_most = F.ceil(F.col("most.n_own") / BLOCK).cast("int")
    lists = lists.select("key", (F.col("n_rows") > BLOCK).alias("long"), F.col("most.comp").alias("most"), p_rest.alias("p_rest"), p_most.alias("p_most"))
    own = F.xxhash64(F.lit(3), "node")
    major = F.col("comp") == F.col("most")
    part = F.when(~F.col("long"), 0).when(major, F.col("p_rest") + F.pmod(own, "p_most")).otherwise(F.pmod(own, "p_rest")).cast("int")
    others = F.when(~F.col("long"), F.array(F.lit(0))).when(major, F.sequence(F.lit(0), F.col("p_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("p_rest") + F.col("p_most") - 1))
    met = rows.join(lists, "key").select(*rows.columns, part.alias("part"), F.explode(others).alias("other"))
    return met.select(*rows.columns, "part", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"))


UNIT_DDL = "node long, n long, key long, comp long, part int, left int, right int"


def estimated(posts: DataFrame, groups: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of units, with their unit, that have a pair left there after the estimate."""
    rows = dealt(posts.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")).join(groups.select("node", "sketch"), "node")
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("comp", pa.int64()), ("part", pa.int32()), ("left", pa.int32()), ("right", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, upto in read_units(batches, ["key"], 5_000):
            sizes, comps_, parts, keys = (table.column(c).to_numpy() for c in ("n", "comp", "part", "key"))
            sketches, lengths = padded(table.column("sketch").to_pylist())
            a, b = [], []
            for start, stop in spans(upto):
                i, j = candidates(*(x[start:stop] for x in (sketches, lengths, sizes, comps_, parts)), int(keys[start]) & (1 << 64) - 1)
                a.append(i + start)
                b.append(j + start)
            i, j = np.concatenate(a), np.concatenate(b)
            some = [resemblances(*(x[y[at : at + MERGED]] for x in (sketches, lengths) for y in (i, j))) >= 0 for at in range(0, len(i), MERGED)]
            if some:
                some = np.concatenate(some)
                left = np.union1d(i[some], j[some])
                for batch in table.select(schema.names).take(pa.array(left)).cast(schema).to_batches():
                    yield frame(schema, *batch.columns)

    return by_unit(rows, ["key"]).mapInArrow(run, UNIT_DDL)


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    seen = np.zeros(len(links), bool)
    out = []
    for root in range(len(links)):
        if seen[root]:
            continue
        seen[root] = True
        held = [root]
        while held:
            at = held.pop()
            new = np.flatnonzero(links[at] & ~seen)
            seen[new] = True
            out += [(at, x) for x in new.tolist()]
            held += new.tolist()
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets, as one matrix product over the values that several hold."""
    values, place, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return shared_values(row, place, many, len(sets))


def linked(rows: DataFrame, texts: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """(a, b): links of units of ``estimated``, by whole sets; enough to connect all that a unit links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    whole = by_unit(rows.join(whole_sets(rows.select("node").distinct(), texts, groups, width), "node"), ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, upto in read_units(batches, ["key"], 1_000):
            nodes, sizes, comps_, parts = (table.column(c).to_numpy() for c in ("node", "n", "comp", "part"))
            made = table.column("set").to_pylist()
            found = []
            for start, stop in spans(upto):
                met = intersections([np.frombuffer(s, np.uint64) for s in made[start:stop]])
                n, c, p = sizes[start:stop], comps_[start:stop], parts[start:stop]
                links = (100 * met >= PERCENT * (n[:, None] + n[None, :] - met)) & (c[:, None] != c[None, :])
                if p.min() < p.max():
                    links &= p[:, None] != p[None, :]
                found += [(start + i, start + j) for i, j in forest(links)]
            if found:
                a, b = nodes[np.array(found).T]
                yield frame(schema, np.maximum(a, b), np.minimum(a, b))

    return whole.mapInArrow(run, "a long, b long").distinct()


def whole_sets(nodes: DataFrame, texts: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """(node, set): the whole set of each node, made once, from the text of one row."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, values in slices(batches, "node", "text"):
            sets, _ = distinct_shingles(values, width)
            yield frame(schema, own, [s.tobytes() for s in sets])

    wanted = materialize(nodes.join(groups.select("node", "row"), "node"))
    return only_marked(texts, wanted, "row").join(wanted, "row").dropDuplicates(["node"]).select("node", "text").mapInArrow(make, "node long, set binary")


def verified(pairs: DataFrame, texts: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets have the resemblance.

    A set is made once per node, from the text of one row, and sent once per pair; the members of one ``b`` are dealt
    to groups of bounded size, each with its set first.
    """
    heads = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / VERIFIED).cast("int").alias("groups"))
    members = pairs.join(heads, "b").select("b", F.pmod(F.xxhash64(F.lit(5), "a"), F.col("groups")).cast("int").alias("group"), F.lit(1).alias("place"), F.col("a").alias("node"))
    first = heads.select("b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(0).alias("place"), F.col("b").alias("node"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for bs, places, nodes, sets in slices(batches, "b", "place", "node", "set"):
            a, b = [], []
            for i, place in enumerate(places):
                own = np.frombuffer(sets[i], np.uint64)
                if place == 0:
                    head = own
                    continue
                met = len(np.intersect1d(head, own, assume_unique=True))
                if 100 * met >= PERCENT * (len(head) + len(own) - met):
                    a.append(nodes[i])
                    b.append(bs[i])
            if a:
                yield frame(schema, a, b)

    sets = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, groups, width)
    grouped = members.unionByName(first).join(sets, "node").repartition("b", "group").sortWithinPartitions("b", "group", "place")
    return grouped.mapInArrow(confirm, "a long, b long")


def merged(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) after more ``edges``: components are the nodes of a smaller graph."""
    label = lambda c: F.coalesce("component", c)
    known = materialize(edges)
    a = known.join(comps.withColumnRenamed("node", "a"), "a", "left").select(label("a").alias("x"), "b")
    links = a.join(comps.withColumnRenamed("node", "b"), "b", "left").select(F.col("x").alias("a"), label("b").alias("b"))
    roots = materialize(connected_components(links.where("a <> b").distinct()))
    moved = comps.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return moved.unionByName(roots.join(comps, "node", "left_anti"))


def near_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    own = materialize(sketched(texts, width))
    groups = materialize(own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    posts = materialize(posted(groups))
    rows = texts.select("row", "text")
    comps = materialize(connected_components(verified(materialize(led(posts, groups)), rows, groups, width)))
    left = materialize(estimated(posts, groups, comps))
    comps = materialize(merged(comps, linked(left, rows, groups, width)))
    discard(posts)
    labelled = groups.select("node", "least").join(comps, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    found = own.select("doc_id", "node", "n").join(labelled.join(named, "root").select("node", "component_id", F.lit(True).alias("some")), "node", "left")
    component = F.when(F.col("some") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
