"""Bottom-k near duplicates, the Merkle manifest and impact-ordered search, held against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.llm import impact_search, merkle, minhash, postings, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def components(docs):
    """(doc_id, n, component, kept) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    comp = list(range(len(docs)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            comp[find(i)] = find(j)
    out = []
    for i, (name, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        least = min(ids) if ids else None
        out.append((name, len(sets[i]), least, name == least))
    return sorted(out, key=str)


def found_components(spark, docs):
    return rows_of(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_shingles", "component_id", "kept")


def at_threshold(rng, n, size):
    """Pairs of texts of ``size`` words of which ``n`` apart words are replaced."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(size)]
    other = list(words)
    for at in rng.sample(range(size), n):
        other[at] = f"x{rng.randrange(10**9)}"
    return " ".join(words), " ".join(other)


def test_minhash_equals_brute_force_on_hard_texts(spark):
    rng = random.Random(4)
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (5, "one two"), (None, "one two three four five six"), (7, "ONE  two\tthree four five six"), (None, "nothing like the others here"), (8, "a " * 5000), (9, "A\na")]
    for size, n in [(6, 1), (12, 1), (20, 1), (20, 2), (40, 2), (60, 5), (120, 6), (300, 14), (300, 18), (800, 40), (2000, 90)]:
        for _ in range(6):
            for t in at_threshold(rng, n, size):
                docs.append((100 + len(docs), t))
    # Chains that only steps connect, and a passage that differing texts share.
    words = [f"c{i}" for i in range(100)]
    for step in range(12):
        docs.append((1000 - step, " ".join(words[step * 4 : step * 4 + 50])))
    shared = " ".join(f"p{i}" for i in range(40))
    docs += [(2000 + i, f"{shared} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(5 + i % 30))) for i in range(60)]
    rng.shuffle(docs)
    assert found_components(spark, docs) == components(docs)


@pytest.mark.parametrize("size", [30, 200, 1000])
def test_minhash_finds_pairs_at_the_threshold(spark, size):
    """Resemblance just above 0.8: every planted pair is linked, and none just below."""
    rng = random.Random(size)
    docs, want = [], {}
    for p in range(100):
        while True:
            a, b = at_threshold(rng, max(1, round(size * 0.055)), size)
            sa, sb = shingle_set(a), shingle_set(b)
            if 0.78 <= len(sa & sb) / len(sa | sb) <= 0.83:
                break
        docs += [(2 * p, a), (2 * p + 1, b)]
        want[2 * p + 1] = 2 * p if 100 * len(sa & sb) >= 80 * len(sa | sb) else 2 * p + 1
    found = {r[0]: r[2] for r in found_components(spark, docs)}
    assert {k: found[k] for k in want} == want


def test_minhash_long_list_of_near_copies(spark, monkeypatch):
    """A list above the block: near copies join by their leader, and what does not join is compared in parts."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(9)
    words = [f"h{i}" for i in range(60)]
    docs = []
    for i in range(150):
        own = list(words)
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 4, 5, 8])):
            own[at] = f"y{rng.randrange(10**9)}"
        docs.append((i, " ".join(own)))
    assert found_components(spark, docs) == components(docs)


def test_forest_connects_what_the_links_connect():
    rng = np.random.default_rng(1)
    links = rng.random((60, 60)) < 0.02
    links |= links.T
    made = minhash.forest(links)
    assert all(links[i, j] for i, j in made)
    reach = np.linalg.matrix_power((links | np.eye(60, dtype=bool)).astype(float), 64) > 0
    own = np.eye(60, dtype=bool)
    for i, j in made:
        own[i, j] = own[j, i] = True
    assert ((np.linalg.matrix_power(own.astype(float), 64) > 0) == reach).all() and len(made) == 60 - len({tuple(r) for r in reach.tolist()})


def test_intersections_and_first_runs():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 900, 300)).astype(np.uint64) for _ in range(30)]
    got = minhash.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i, j in combinations(range(30), 2))
    sketches, _ = minhash.padded([np.unique(rng.integers(0, 60, 50)).astype(np.uint32).tobytes() for _ in range(20)])
    runs = [{int(a) << 32 | int(b) for a, b in zip(s[: minhash.POSTED - 1], s[1 : minhash.POSTED], strict=False) if b != minhash.PAD} for s in sketches]
    for key in sorted(runs[0])[:10]:
        met = minhash.first_met(sketches, key)
        assert all(met[i, j] == (not any(r < key for r in runs[i] & runs[j])) for i, j in combinations(range(20), 2))


def test_minhash_overlaps_and_estimates():
    rng = np.random.default_rng(3)
    own = [np.unique(rng.integers(0, 400 if i < 20 else 3000, 300))[: minhash.SKETCH if i % 3 else 5 + i].astype(np.uint32) for i in range(40)]
    sketches, lengths = minhash.padded([s.tobytes() for s in own])
    assert lengths.tolist() == [len(s) for s in own]
    got = minhash.overlaps(sketches)
    pairs = list(combinations(range(40), 2))
    i, j = np.array(pairs).T
    estimates = minhash.resemblances(sketches[i], sketches[j], lengths[i], lengths[j])
    for (x, y), estimate in zip(pairs, estimates, strict=True):
        assert got[x, y] == len(np.intersect1d(own[x], own[y]))
        whole = max(len(own[x]), len(own[y])) < minhash.SKETCH
        union = np.union1d(own[x], own[y])
        union = union if whole else union[: minhash.SKETCH]
        want = np.isin(union, own[x]) & np.isin(union, own[y])
        assert estimate == (want.mean() if want.mean() >= 0.8 - minhash.margin(len(union), whole) else -1)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, proof of each node as (left, right) per level)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    level = list(nodes)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k in range(len(nodes)):
            run, place = runs[at[k] // 16], at[k] % 16
            ways[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
            at[k] //= 16
        level = [h("".join(run)) for run in runs]
    return level[0], ways


def manifest_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[s] = own, *tree([leaf_of(r, r["text"]) for r in own])
    root, outer = tree([trees[s][1] for s in order])
    out = []
    for s, above in zip(order, outer, strict=True):
        own, subroot, ways = trees[s]
        for r, way in zip(own, ways, strict=True):
            drawn = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            at = leaf_of(r, r["text"].translate(LOW) if drawn and r["text"] is not None else r["text"])
            for left, right in way + above:
                at = h(left + at + right)
            proof = h("".join(left + right for left, right in way + above))
            out.append((r["doc_id"], leaf_of(r, r["text"]), subroot, root, proof, at, at == root))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, KEY string, pos int, h string, f int"


def found_manifest(spark, rows):
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "k", 1, "x", 2) for r in rows], DOCS)
    drawn = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    out = merkle.manifest(docs, tampered={"text": merkle.lower_ascii(F.col("text"))}, where=drawn)
    return rows_of(out, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_rows(sizes):
    rng = random.Random(1)
    rows = []
    for source, n in sizes:
        rows += [{"doc_id": rng.randrange(10**6), "text": rng.choice([None, "", "Ünï Text", "lower only", f"A{rng.random()}"]), "lang": rng.choice([None, "de"]), "source": source, "n_chars": rng.choice([None, 5])} for _ in range(n)]
    return rows


@pytest.mark.parametrize("sizes", [[("a", 1)], [(None, 2)], [("a", 16), ("b", 17), (None, 256), ("", 257), ("é", 1), ("z", 40)], [(f"s{i}", 1) for i in range(300)], [("big", 4097), ("small", 3)], [("only", 4096)]], ids=str)
def test_manifest_equals_a_tree_by_hand(spark, sizes):
    rows = manifest_rows(sizes)
    rows += [dict(rows[0]), rows[0] | {"text": "other"}, rows[-1] | {"doc_id": None}, rows[-1] | {"doc_id": None}] if len(sizes) > 1 and len(rows) < 1000 else []
    want = manifest_of(rows)
    assert found_manifest(spark, rows) == want
    assert len(rows) < 20 or {r[-1] for r in want} == {True, False}


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_blocks_stay_bounded(spark, monkeypatch):
    """Blocks are cut between keys and buckets, however the batches fall."""
    import pyarrow as pa

    table = pa.table({"key": ["a"] * 10 + ["b"] * 5 + ["c"], "bucket": [0] * 4 + [1] * 6 + [0] * 5 + [0], "pos": list(range(10)) + list(range(5)) + [0]})
    for size in (1, 3, 7, 100):
        cut = list(merkle._blocks(iter(table.to_batches(max_chunksize=size)), 4))
        assert pa.concat_tables(cut).to_pydict() == table.to_pydict()
        keys = [set(zip(t.column("key").to_pylist(), t.column("bucket").to_pylist(), strict=True)) for t in cut]
        assert all(not a & b for a, b in combinations(keys, 2))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [t.translate(LOW) for t in TERM.findall(text or "")]


def ranked(docs, items, k=10):
    own = [(name, Counter(terms_of(t))) for name, t in docs if terms_of(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    by_item = {}
    for name, t in items:
        by_item.setdefault(name, set()).update(terms_of(t))
    out = []
    for item, terms in by_item.items():
        scored = []
        for name, c in own:
            m = 10 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, name is None, name or 0, name))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **more):
    out = impact_search.search(spark.createDataFrame(docs, "doc_id long, text string, item long, n int"), spark.createDataFrame(items, "item_id long, text string, doc_id int"), **more)
    return rows_of(out, "item_id", "rank", "doc_id", "score")


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_search_equals_brute_force(spark, block):
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 8, 40, 200])))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, " .,- "), (5, docs[5][1]), (None, "t50 t51 t52"), (None, "t50 t51 t52"), (903, "É é T1_t2 日本 t3"), (904, "t1 " * 20000)]
    items = [(i, " ".join(rng.sample(vocabulary, rng.choice([1, 2, 6, 20])))) for i in range(40)]
    items += [(50, None), (51, "..."), (52, "unknown words"), (53, "É 日本"), (53, "T3"), (None, "t50 t51")]
    got = searched(spark, [(*d, 1, 2) for d in docs], [(*i, 3) for i in items], block=block)
    assert got == ranked(docs, items)


def test_search_of_nothing(spark):
    assert searched(spark, [], [(1, "a", 1)]) == [] and searched(spark, [(1, "a", 1, 1)], []) == [] and searched(spark, [(1, " ", 1, 1)], [(1, "a", 1)]) == []


def test_search_stops_only_when_the_bounds_prove_it(spark):
    """Evaluation ends early where few documents have a term of high impact, and gives what the last group gives."""
    rng = np.random.default_rng(2)
    n_docs, n_terms = 3000, 12
    starts, terms, impacts = [0], [], []
    for d in range(n_docs):
        own = [t for t in range(n_terms) if rng.random() < (0.01 if t < 3 else 0.6)]
        terms += own
        impacts += [int(rng.integers(900, 1000)) * (100 if t < 3 else 1) for t in own]
        starts.append(len(terms))
    made = impact_search.Postings(np.array(starts), np.array(terms, np.int64), np.array(impacts, np.int64), n_terms)
    found, scores, seen = made.best(np.arange(n_terms), 10, 1)
    whole = np.zeros(n_docs, np.int64)
    np.add.at(whole, np.repeat(np.arange(n_docs), np.diff(starts)), impacts)
    best = np.sort(whole)[-10:]
    assert sorted(scores.tolist())[-10:] == best.tolist() and (whole[found] == scores).all()
    assert set(np.flatnonzero(whole >= best[0]).tolist()) <= set(found.tolist())
    assert seen < 0.5 * len(terms)


def test_new_queries_are_registered():
    assert {"op11_minhash", "op12_merkle_manifest", "op13_ranked_search"} <= queries.QUERIES.keys() & queries.ORACLE.keys()
    assert postings.UNIT
