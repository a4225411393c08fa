"""The corpus operators against brute force, on a table that holds every awkward row, and on empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, fp string, component string, `key` string, score string, n long"


def _prose(rng, n):
    return " ".join(rng.choice("tha ren edon ouer ingst shble wher ander tion ofre lyand hest ere thou".split()) + str(rng.randrange(400)) for _ in range(n))


def _rows():
    rng = random.Random(3)
    base = [_prose(rng, 150) for _ in range(8)]
    passage = _prose(rng, 80)
    texts = [
        None, "", " \t\n\x0b\x0c\r ", "one", "one two", "one two three", "A b c 　 d",
        base[0], base[0], base[0] + " tail", base[1] + "\n" + passage, passage + "\n" + base[2], "x" * 1000, "ab" * 700, base[3].upper(),
        _prose(rng, 30_000), "\n".join([base[4][:300]] * 4), base[5].replace("tha", "thb", 1), base[5], "You are an 1d10t and a mоron " + base[6], "a clown fish swims " + base[6][:200],
        "  double  spaces \n  and\t\ttabs  \n\n end ", "éèê ñ ß 你好 😀 " * 40, base[7], base[7],
    ]
    rows = [(i * 3 % 101, t, "en", [f"s{i % 3}", "s1", None][i % 3], None, i, "d", "f", "c", "k", "s", 1) for i, t in enumerate(texts)]
    rows.append((None, base[0], "en", "s0", None, 0, "d", "f", "c", "k", "s", 1))
    rows.append((None, "no id here at all, none", "en", "s0", None, 0, "d", "f", "c", "k", "s", 1))
    rows.append(rows[7])  # the same row again
    rows.append((rows[9][0], "another text of the same id", "en", "s2", None, 0, "d", "f", "c", "k", "s", 1))
    return rows


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(ROWS, DDL).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(r[0], 1 if r[1] and len(r[1]) > 50 else 0, 0) for r in ROWS if r[0] is not None], "doc_id long, quality int, toxic int")


def multiset(rows):
    return Counter(tuple(r) for r in rows)


def test_suffix_dedup(docs, none):
    from tomewright.llm.suffix_dedup import repeat_digests

    length = 400
    raws = [(r[0], (r[1] or "").encode()) for r in ROWS]
    seen = Counter(raw[i : i + length] for _, raw in raws for i in range(len(raw) - length + 1))
    want = []
    for doc, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        want.append((doc, len(raw), len(raw) - len(kept), sum(k for k, _ in itertools.groupby(gone)), hashlib.sha256(kept).hexdigest()))
    rows = repeat_digests(docs).collect()
    assert multiset(r[:5] for r in rows) == multiset(want)
    assert sum(w[2] for w in want) > 2000
    # Words in strings of 50 (44 at least) that a row with another id or text has.
    words = [(r[0], (r[1] or "").split()) for r in ROWS]
    places = {size: defaultdict(set) for size in (44, 50)}
    for k, (_, w) in enumerate(words):
        for size in (44, 50):
            for i in range(len(w) - size + 1):
                places[size][tuple(w[i : i + size])].add((words[k][0], ROWS[k][1]))
    bounds = Counter()
    for k, (doc, w) in enumerate(words):
        covered = []
        for size in (50, 44):
            own = set()
            for i in range(len(w) - size + 1):
                if len(places[size][tuple(w[i : i + size])]) > 1:
                    own.update(range(i, i + size))
            covered.append(len(own))
        bounds[doc, len((ROWS[k][1] or "").encode()), *covered] += 1
    found = Counter((r.doc_id, r.n_bytes, r.shared_words) for r in rows)
    for doc, n, at_least, at_most in bounds:
        # At steps of six words up to five at each end of a passage are not counted.
        assert any(0.8 * at_least <= x[2] <= at_most for x in found if x[:2] == (doc, n))
    assert sum(at_least > 0 for _, _, at_least, _ in bounds) > 5 and sum(r.shared_words > 0 and r.n_removed == 0 for r in rows) >= 0
    assert repeat_digests(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_anchor_of_equal_strings(seed):
    from tomewright.llm.suffix_dedup import anchors

    rng = np.random.default_rng(seed)
    shared = bytes(rng.integers(97, 101, 900, np.uint8))
    a, b = bytes(rng.integers(97, 101, 333, np.uint8)) + shared, bytes(rng.integers(97, 101, 71, np.uint8)) + shared

    def of(raw):
        return {p: int(x - p) for x, lo, hi, *_ in zip(*anchors(raw), strict=True) for p in range(lo, hi + 1)}

    left, right = of(a), of(b)
    assert len(left) == len(a) - 399
    assert all(left[333 + i] == right[71 + i] for i in range(501))


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tomewright.llm.packing import pack_documents

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for r in ROWS:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(sequences) <= 1 - (-sum(r.length for r in rows) // 1024)
    assert pack_documents(none).count() == 0


def test_genetic_search_beats_its_start():
    from tomewright.llm.packing import Bins, evolve

    rng = random.Random(1)
    # Triples that fill a bin exactly, which best fit by length does not find.
    lengths = []
    for _ in range(120):
        a, b = rng.randint(250, 480), rng.randint(250, 300)
        lengths += [a, b, 1024 - a - b]
    start = Bins(lengths, 1024)
    start.best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]))
    # At the production setting; the optimum is 120, best fit by length needs 135.
    best = evolve([], lengths, 1024, rng, 4, 12)[0]
    assert sorted(i for b in best for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 1024 for b in best)
    assert len(start.bins()) >= 132 and len(best) <= 124


def test_shards_are_packed_to_the_bound(spark):
    from tomewright.llm.packing import pack

    rng = random.Random(5)
    rows = [(k % 7, 0, 0, rng.randint(1, 700), 1, k * 977) for k in range(3000)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")
    found = pack(items, shard_pieces=256).collect()
    assert Counter((r.doc_id, r.length) for r in found) == Counter((r[0], r[3]) for r in rows)
    filled = Counter()
    for r in found:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024
    # Twelve shards, each of which wastes half a sequence by itself.
    assert len(filled) <= 2 - (-sum(r[3] for r in rows) // 1024)


def test_base_scores_learn_no_pieces(docs, monkeypatch):
    from tomewright.llm import lm_score

    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    want = Counter(tuple(r) for r in lm_score.score_documents(docs, rounds=1).select(*columns).collect())
    monkeypatch.setattr(lm_score, "learn_pieces", None)
    found = lm_score.score_documents(docs, lattice_score=False)
    assert found.columns == columns and Counter(tuple(r) for r in found.collect()) == want


def test_search_of_a_shard_does_not_depend_on_how_many_there_are(spark, monkeypatch):
    from tomewright.llm import packing

    seen, level = [], packing._level

    def noted(rest, depth, shards, last, capacity, islands, epochs, generations, population, seed):
        seen.append((shards > 1, (islands, epochs, generations, population)))
        return level(rest, depth, shards, last, capacity, islands, epochs, generations, population, seed)

    monkeypatch.setattr(packing, "_level", noted)
    rng = random.Random(5)
    items = spark.createDataFrame([(k, 0, 0, rng.randint(1, 700), 1, k * 977) for k in range(600)], "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")
    assert packing.pack(items, shard_pieces=256).count() == 600
    assert {many for many, _ in seen} == {True, False} and len({search for _, search in seen}) == 1


def test_fingerprints(docs, none):
    from tomewright.llm.fingerprints import compare_edited

    order = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))

    def shingles(text):
        w = WORD.findall(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    want = defaultdict(list)
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        made = text[: len(text) - half] + after[:half]
        want[doc, len(text), hashlib.sha256(made.encode()).hexdigest()].append((jaccard(shingles(text), shingles(made)), jaccard(shingles(text), shingles(after))))
    rows = compare_edited(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == Counter({k: len(v) for k, v in want.items()})
    prints = defaultdict(set)
    for r in rows:
        edited, after = want[r.doc_id, r.n_chars, r.edited_sha256][0]
        assert abs(r.near_edited - edited) < 0.12
        assert abs(r.near_next - after) < 0.12 or len(want[r.doc_id, r.n_chars, r.edited_sha256]) > 1
        prints[r.edited_sha256].add(r.edited_fingerprint)
    # Equal texts have equal fingerprints, and the sketch of a text is made of its shingles alone.
    assert all(len(p) == 1 for p in prints.values())
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id, r.n_chars].add(r.fingerprint)
    for doc, text in order:
        hashes = sorted({xxhash.xxh3_64_intdigest(" ".join(x).encode()) for x in (shingles(text) if len(WORD.findall(text)) >= 5 else [WORD.findall(text)] if WORD.search(text) else [])})[:256]
        assert "".join(f"{h:016x}" for h in hashes) in by_id[doc, len(text)]
    assert compare_edited(none).count() == 0


def test_fingerprint_parts():
    from tomewright.llm import fingerprints as f

    rng = random.Random(2)
    words = [f"w{i}".encode() for i in range(40_000)]
    whole = f.shingle_hashes(words)
    left, right = f.bottom(whole[:25_000]), f.bottom(whole[15_000:])
    assert (f.merge(left, right) == f.bottom(whole)).all()
    assert abs(f.distinct_count(f.bottom(whole)) / len(whole) - 1) < 0.2
    assert abs(f.containment(f.bottom(whole[:5000]), f.bottom(whole[:20_000])) - 1) < 0.35
    assert (f.from_hex(f.to_hex(left)) == left).all()
    repeated = np.repeat(whole[:300], 50)
    rng.shuffle(repeated)
    assert (f.bottom(repeated) == np.unique(whole[:300])[: f.K]).all()


def test_targets():
    from tomewright.llm.mixing import targets

    sizes = [("a", 100), ("b", 1000), ("c", 10), (None, 0)]
    out = targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert out[0] == 200 and out[2] == 20 and out[3] == 0
    assert math.isclose(sum(out), 1.5 * 1110)
    assert all(t <= 2 * n + 1e-9 for t, (_, n) in zip(out, sizes, strict=True))


def test_permutation(spark):
    from pyspark.sql import functions as F

    from tomewright.llm.mixing import permuted

    for n in (1, 2, 7, 1000):
        rows = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), 5, F.lit(1)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_mixing(docs, none):
    from tomewright.llm.mixing import mix_documents, mix_sources

    rows = mix_sources(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r[0], r[3], len(WORD.findall(r[1] or ""))) for r in ROWS)
    by = defaultdict(lambda: [0, 0, 0.0, 0])
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        s = by[r.source]
        s[0], s[1], s[2], s[3] = s[0] + r["size"], r.source_size, r.target, s[3] + r.taken
    for size, source_size, target, taken in by.values():
        assert size == source_size and abs(taken - target) <= 130
    assert multiset(mix_sources(docs.repartition(5)).collect()) == multiset(rows)
    out = mix_documents(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mix_sources(none).count() == 0 and mix_documents(none).count() == 0


def test_mix_by_brute_force(spark, docs, monkeypatch):
    """Every word of every slot counted on its own, from spans that must follow each other without a gap."""
    from tomewright.llm import mixing as m

    small = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    table = small.unionByName(docs.select("doc_id", "text", "source"))
    for group, threshold in ((1024, 10_000), (2, 3)):
        monkeypatch.setattr(m, "SHARD_GROUP", group)
        monkeypatch.setattr(m, "BROADCAST_SOURCES", threshold)
        plan = m.plan_mix(table, shard_slots=64, bucket_docs=16)
        owners = defaultdict(list)
        for r in sorted(plan.documents.collect(), key=lambda r: (r.idx, r.start, r["size"])):
            if r["size"]:
                assert r.start == len(owners[r.idx])
                owners[r.idx] += [(r.doc_id, r.digest)] * (r["size"] * r.copies)
        slots = plan.slots.collect()
        per_source = defaultdict(list)
        want = Counter()
        for r in slots:
            per_source[r.idx].append(r.slot)
            want.update((r.idx, *x) for x in owners[r.idx][64 * r.block : 64 * r.block + r.words])
        assert all(sorted(x) == list(range(len(x))) for x in per_source.values())
        found = Counter()
        for r in m.taken(plan).collect():
            found[r.idx, r.doc_id, r.digest] += r.taken
        assert +found == want
        goal = {r.idx: r.target for r in plan.sources.collect()}
        for idx, target in goal.items():
            assert abs(sum(n for k, n in want.items() if k[0] == idx) - target) <= 64


def test_toxicity_folding():
    from tomewright.llm.toxicity import EXCEPTIONS, INSULTS, ToxicityModel, automaton, fold, hits

    model = ToxicityModel({fold(w): 3.0 for w in INSULTS}, tuple(fold(p) for p in EXCEPTIONS), (0.0, 0.0, 0.0))
    made = automaton(model)

    def weight(text):
        return hits(fold(text), made)

    assert weight("such an idiot!") == weight("such an 1d10t!") == weight("such an ідіоt") == weight("SUCH AN ＩＤＩＯＴ") == 3.0
    assert weight("a c1own and a m0r0n") == 6.0
    assert weight("the clown fish by the trash can") == 0.0
    assert weight("the clown by the trash can") == 3.0
    assert weight("idiotic clownish scumble") == 0.0
    assert weight(None) == weight("") == 0.0


def test_toxicity(spark, docs, labels, none):
    from tomewright.llm.toxicity import drop_toxic, score_toxicity

    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    clash = docs.withColumnsRenamed({"key": "toxic", "score": "_id", "n": "quality", "fp": "share"})
    assert drop_toxic(clash, labels).columns == clash.columns and score_toxicity(clash, labels).count() == len(ROWS)
    assert not [r for r in kept.collect() if r.text and "1d10t" in r.text]
    assert score_toxicity(none, labels).count() == 0 and score_toxicity(docs, labels.limit(0)).count() == len(ROWS)
    spark.catalog.clearCache()


def test_toxicity_scores_by_brute_force(docs, spark):
    """Every entry tried at every place of every text, with the model that the labels give."""
    from tomewright.llm import toxicity as m

    small, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = m.learn(small, m.training_labels(labels))
    assert len(model.entries) > 20
    texts = [(r.doc_id, r.text) for r in small.where("doc_id % 3 = 0").collect()] + [(r[0], r[1]) for r in ROWS]
    found = {(r.doc_id, r.words, round(r.weight, 6)): r.score for r in m.weigh(spark.createDataFrame(texts, "doc_id long, text string"), model, "doc_id").collect()}
    for doc, text in texts:
        folded = m.fold(text)
        hidden = {i for p in model.exceptions for i in range(len(folded)) if folded.startswith(p, i)}
        hidden = {k for i in hidden for p in model.exceptions if folded.startswith(p, i) for k in range(i, i + len(p))}
        weight = 0.0
        for i, c in enumerate(folded):
            if c == " " and i not in hidden:
                rest = folded[i : i + 40]
                weight += max((w for e, w in model.entries.items() if rest.startswith(e)), default=0.0)
        words = len(folded.split())
        a, b = math.log1p(weight), math.log1p(1000 * weight / max(10, words))
        c = model.coefficients
        assert math.isclose(found[doc, words, round(weight, 6)], 1 / (1 + math.exp(-(c[0] + c[1] * a + c[2] * b))), rel_tol=1e-9)


@pytest.mark.parametrize("name, column, least", [("toxic", "toxic", 0.9), ("quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, column, least):
    from tomewright.llm import quality_qda, toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = (toxicity.score_toxicity if name == "toxic" else quality_qda.score_quality)(docs, labels)
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", column).collect()
    assert len(rows) > 30
    assert sum(r[0] == r[1] for r in rows) / len(rows) >= least - (0.1 if name == "toxic" else 0)


def test_quality(docs, labels, none):
    from tomewright.llm.quality_qda import DIMENSIONS, document_statistics, score_quality

    rows = score_quality(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert all(len(document_statistics(r[1])) == DIMENSIONS and np.isfinite(document_statistics(r[1])).all() for r in ROWS)
    assert score_quality(none, labels).count() == 0
    assert score_quality(docs.withColumnsRenamed({"key": "quality", "score": "_id"}), labels).count() == len(ROWS)
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_by_brute_force(spark):
    """The fit and the scores from plain numpy covariances over all training rows."""
    from tomewright.llm.quality_qda import document_statistics, score_quality

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    stats = {d: np.array(document_statistics(t)) for d, t in texts.items()}
    train = {y: np.array([stats[d] for d in sorted(marks) if d in stats and zlib.crc32(str(d).encode()) % 5 != 0 and marks[d] == y]) for y in (0, 1)}
    n = {y: len(x) for y, x in train.items()}
    covs = {y: np.cov(x.T, bias=True) for y, x in train.items()}
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    size = len(pooled)
    want = {}
    parts = {}
    for y in (0, 1):
        weight = 0.1 + 0.9 * size / (size + n[y])
        cov = 0.95 * ((1 - weight) * covs[y] + weight * pooled) + 0.05 * np.diag(np.diag(pooled).clip(1e-4))
        parts[y] = (math.log(n[y] / (n[0] + n[1])) - 0.5 * np.linalg.slogdet(cov)[1], train[y].mean(axis=0), np.linalg.inv(cov))
    for d, x in stats.items():
        logs = [c - 0.5 * (x - mean) @ inverse @ (x - mean) for c, mean, inverse in (parts[0], parts[1])]
        want[d] = 1 / (1 + math.exp(max(-500, min(500, logs[0] - logs[1]))))
    rows = score_quality(docs, labels).collect()
    assert len(rows) == len(texts)
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 for r in rows)


def test_discriminant_is_the_density_ratio():
    from tomewright.llm.quality_qda import DIMENSIONS, fit

    rng = np.random.default_rng(5)
    data = {0: rng.normal(0, 1, (400, DIMENSIONS)), 1: rng.normal(0.7, 1.5, (900, DIMENSIONS))}
    model = fit({y: (float(len(x)), x.sum(axis=0), x.T @ x) for y, x in data.items()})
    x = rng.normal(0.3, 1, (20, DIMENSIONS))
    logs = []
    for y in (0, 1):
        cov = model.factors[y] @ model.factors[y].T
        diff = x - model.means[y]
        logs.append(model.log_priors[y] - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    assert np.allclose(model.posterior(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def _simhash(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, none):
    from tomewright.llm.simhash import near_duplicates

    far = (1 << 62) + 5  # an id that no reserved range may swallow
    rows_in = [*[(r[0], r[1]) for r in ROWS], (far, "a text with a very large id"), (far + 1, "a text with a very large id"), (-4, ROWS[7][1])]
    prints = [_simhash(t) for _, t in rows_in]
    root = list(range(len(rows_in)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows_in)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows_in):
        least[find(i)] = min((x for x in (least.get(find(i)), doc) if x is not None), default=None)
    want = Counter((doc, prints[i], least[find(i)]) for i, (doc, _) in enumerate(rows_in))
    rows = near_duplicates(spark.createDataFrame(rows_in, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component) for r in rows) == want
    assert near_duplicates(none).count() == 0


def _alike(a, b):
    a, b = (WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in (a, b))
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_keep_one(spark, docs, none):
    from tomewright.llm.simhash import keep_one

    rng = random.Random(12)
    base = _prose(rng, 240).split()
    copies = []
    for k in range(30):
        words = list(base)
        for at in rng.sample(range(240), 2):  # resemblance about 0.92 to the base and 0.84 to each other
            words[at] = f"edit{k}x{at}"
        copies.append((1000 + k, " ".join(words)))
    unlike = [(2000 + k, _prose(rng, 200)) for k in range(40)]
    rows_in = [*[(r[0], r[1]) for r in ROWS], (999, " ".join(base)), *copies, *unlike]
    root = list(range(len(rows_in)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows_in)), 2):
        if _alike(rows_in[i][1], rows_in[j][1]) >= 0.8:
            root[find(j)] = find(i)
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows_in):
        groups[find(i)].append((doc is None, doc or 0, doc, text or ""))
    kept = keep_one(spark.createDataFrame(rows_in, "doc_id long, text string").repartition(3)).collect()
    # Each group keeps one row, one of its least id; texts alike by 30,000 words are compared whole.
    assert len(kept) == len(groups)
    assert Counter(r.doc_id for r in kept) == Counter(min(g)[2] for g in groups.values())
    assert all(any((r.doc_id, r.text or "") == (x[2], x[3]) for g in groups.values() for x in g if x[:2] == min(g)[:2]) for r in kept)
    assert sum(r.doc_id is not None and 999 <= r.doc_id < 2000 for r in kept) == 1 and sum(r.doc_id is not None and r.doc_id >= 2000 for r in kept) == 40
    clash = docs.withColumnsRenamed({"digest": "row", "fp": "_row", "key": "doc", "n": "last"})
    assert keep_one(clash).columns == clash.columns and keep_one(none).count() == 0


@pytest.mark.parametrize("n", [1 << 10, 1 << 25, 1 << 40])
def test_position_families(n):
    from tomewright.llm.simhash import position_family

    family = [set(s) for s in position_family(n)]
    for five in itertools.combinations(range(8), 5):
        assert any(s <= set(five) for s in family)


def test_long_postings_lose_no_link(spark, monkeypatch):
    from tomewright.llm import simhash

    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 40, 12, np.uint64)
    flips = np.array([1 << int(rng.integers(0, 40)) for _ in range(300)], np.uint64)
    fps = np.unique(np.concatenate([centres[rng.integers(0, 12, 300)] ^ flips, rng.integers(0, 1 << 40, 100, np.uint64)]))

    def components(pairs):
        root = {int(f): int(f) for f in fps}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            root[find(a)] = find(b)
        out = defaultdict(set)
        for f in root:
            out[find(f)].add(f)
        return {frozenset(s) for s in out.values()}

    every = [(int(a), int(b)) for a, b in itertools.combinations(fps.tolist(), 2) if (a ^ b).bit_count() <= 3]
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    for block in (16, 1024):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(table, len(fps)).collect()]
        assert components(found) == components(every)


def test_components(spark):
    from tomewright.llm.components import connected_components

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7000, k) for k in range(7001, 7050)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for e in edges for x in e if e[0] != e[1]}


def test_quality_rules(docs, none):
    from tomewright.llm.common import materialize
    from tomewright.llm.quality_rules import judge_quality

    want = Counter()
    for r in ROWS:
        text = r[1] or ""
        w = WORD.findall(text)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed] += 1
    rows = judge_quality(docs, materialize).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert judge_quality(none, materialize).count() == 0


def test_quality_verdicts_by_brute_force(spark):
    """Votes from the texts by themselves, posteriors by plain expectation-maximisation over all documents one by one."""
    from tomewright.llm.common import materialize
    from tomewright.llm.quality_rules import FUNCTION_WORDS, judge_quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    forms = {f for w in FUNCTION_WORDS for f in (w, w.capitalize(), w.upper())}
    votes, failed = {}, {}
    for r in docs.collect():
        text = r.text or ""
        w = WORD.findall(text)
        n, size = max(1, len(w)), sum(map(len, w))
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = len({k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        function = sum(x in forms for x in w)
        upper = sum(c.isupper() and c.isalpha() for c in text)

        def against(bad, good=False):
            return -1 if bad else 1 if good else 0

        votes[r.doc_id] = (
            against(len(w) < 10, 50 <= len(w) <= 100_000), against(not 2 <= size / n <= 14), against(len(re.findall(r"[#*$%&|<>]", text)) / n > 0.1),
            against((len(lines) - len(set(lines))) / max(1, len(lines)) > 0.3), against(repeat / n > 0.2), against(upper / max(1, size) > 0.4),
            against(text.count("!") / n > 0.3), against(function / n < 0.01 and len(w) >= 50, function / n > 0.1),
        )
        failed[r.doc_id] = len(w) < 10 or 100 * repeat > 20 * len(w)
    belief = {d: 1 / (1 + math.exp(-(1 + v.count(1) - 3 * v.count(-1)))) for d, v in votes.items()}
    for _ in range(50):
        good = sum(belief.values())
        prior = min(0.99, max(0.01, (good + 1) / (len(votes) + 2)))
        tables = []
        for k in range(8):
            own = [{-1: 1.0, 0: 1.0, 1: 0.25}, {-1: 0.25, 0: 1.0, 1: 1.0}]
            for d, v in votes.items():
                own[1][v[k]] += belief[d]
                own[0][v[k]] += 1 - belief[d]
            tables.append([{x: c / sum(t.values()) for x, c in t.items()} for t in own])
        moved = 0.0
        for d, v in votes.items():
            a = math.log(1 - prior) + sum(math.log(t[0][x]) for t, x in zip(tables, v, strict=True))
            b = math.log(prior) + sum(math.log(t[1][x]) for t, x in zip(tables, v, strict=True))
            now = 1 / (1 + math.exp(max(-700, min(700, a - b))))
            moved, belief[d] = max(moved, abs(now - belief[d])), now
        if moved < 1e-6:
            break
    rows = judge_quality(docs, materialize).collect()
    assert len(rows) == len(votes)
    for r in rows:
        assert abs(r.posterior - belief[r.doc_id]) < 1e-4
        assert r.kept == (not failed[r.doc_id] and r.posterior >= 0.5)


def test_label_model_finds_accuracies():
    from tomewright.llm.quality_rules import fit_label_model

    rng = random.Random(6)
    right = (0.95, 0.8, 0.7, 0.55)
    votes = Counter()
    for _ in range(20_000):
        y = 1 if rng.random() < 0.7 else -1
        votes[tuple(0 if rng.random() < 0.2 else (y if rng.random() < a else -y) for a in right)] += 1
    model = fit_label_model(sorted(votes.items()))
    assert abs(model.prior - 0.7) < 0.05
    for accuracy, (bad, good) in zip(right, model.chances, strict=True):
        assert abs(good[1] / (good[1] + good[-1]) - accuracy) < 0.06
        assert abs(bad[-1] / (bad[1] + bad[-1]) - accuracy) < 0.06


def test_lattice_sums_all_segmentations():
    from tomewright.llm.lm_score import Lattice

    pieces = ["", *(f"<0x{b:02X}>" for b in range(256)), "a", "b", "ab", "ba", "aba", "abab", "▁", "▁a"]
    logs = [math.log(0.001 + i % 7 / 100) for i in range(len(pieces))]
    lattice = Lattice(pieces)
    p = {x: math.exp(logs[i]) for i, x in enumerate(pieces) if x and not x.startswith("<")}

    def total(word):
        out = 1.0 if not word else 0.0
        for k in range(1, len(word) + 1):
            if word[:k] in p:
                out += p[word[:k]] * total(word[k:])
        if word and word[0] not in p:
            out += math.exp(sum(logs[pieces.index(f"<0x{b:02X}>")] for b in word[0].encode())) * total(word[1:])
        return out

    words = ["▁a", "▁abab", "▁babaabab", "▁xéb", "▁😀a", "", "▁" + "ab" * 40]
    found = lattice.read(words).log_probabilities(np.array(logs))
    for word, x in zip(words[:-1], found, strict=False):
        assert math.isclose(x, math.log(total(word)), rel_tol=1e-12, abs_tol=1e-12)
    for word in words[:-1]:
        # A piece's expected uses are the slope of the log probability along its log weight.
        uses, likelihood = lattice.read([word]).expected(np.array(logs), [2.0])
        assert math.isclose(likelihood, 2 * math.log(total(word)), rel_tol=1e-12, abs_tol=1e-12)
        for i in np.flatnonzero(uses):
            moved = np.array(logs)
            moved[i] += 1e-6
            slope = 2 * (lattice.read([word]).log_probabilities(moved)[0] - math.log(total(word))) / 1e-6
            assert math.isclose(slope, uses[i], rel_tol=1e-3, abs_tol=1e-6)


def test_lattices_hold_the_pieces_of_their_words_and_no_more(monkeypatch):
    from tomewright.llm.lm_score import Lattice

    rng = random.Random(4)
    pieces = ["", "<0x61>", *sorted({"".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(300)})]
    words = ["".join(rng.choices("abcdé😀", k=rng.randint(0, 30))) for _ in range(200)]
    want = Counter(p for w in words for i in range(len(w)) for p in pieces if p and w.startswith(p, i))
    bare = sum(c not in pieces for w in words for c in w)
    logs = np.log(np.arange(1, len(pieces) + 1) / 1e5)
    scores = Lattice(pieces).read(words).log_probabilities(logs)
    for bits in (20, 2):
        # With four places of the hash table, almost all edges share theirs.
        monkeypatch.setattr(Lattice, "BITS", bits)
        read = Lattice(pieces).read(words)
        found = np.concatenate([piece for _, _, piece in read.arcs])
        assert Counter(pieces[i] for i in found[found < len(pieces)].tolist()) == want and (found >= len(pieces)).sum() == bare
        assert (read.log_probabilities(logs) == scores).all()


def _lattice_score(counts, tokens_of_rows, ends, rounds=12, tolerance=0.01):
    """log10 probabilities by plain loops: expectation-maximisation over whole words, then the forward sum."""
    from tomewright.llm.lm_score import default_vocabulary, read_pieces

    pieces, scores = read_pieces(default_vocabulary())
    number = {p: i for i, p in enumerate(pieces) if p and not re.fullmatch("<0x[0-9A-F]{2}>", p)}
    at = {int(p[3:5], 16): i for i, p in enumerate(pieces) if re.fullmatch("<0x[0-9A-F]{2}>", p)}
    longest = max(map(len, number))
    rank = {i: k for k, i in enumerate(sorted(range(len(pieces)), key=lambda i: -scores[i]))}
    start = [1 / (rank[i] + 10) for i in range(len(pieces))]
    logs, end = [math.log(x / sum(start) * 0.99) for x in start], math.log(0.01)

    def arcs(word, i):
        out = [(j, (number[word[i:j]],)) for j in range(i + 1, min(len(word), i + longest) + 1) if word[i:j] in number]
        return out if out and out[0][0] == i + 1 else [(i + 1, tuple(at[b] for b in word[i].encode())), *out]

    def plus(a, b):
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)

    def sums(word):
        n = len(word)
        ahead, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        ahead[0] = back[n] = 0.0
        every = [(i, j, ids, sum(logs[k] for k in ids)) for i in range(n) for j, ids in arcs(word, i)]
        for i, j, _, w in every:
            ahead[j] = plus(ahead[j], ahead[i] + w)
        for i, j, _, w in reversed(every):
            back[i] = plus(back[i], w + back[j])
        return ahead, back, every

    before = -math.inf
    total = sum(counts.values()) + ends
    for _ in range(rounds):
        uses, likelihood = [0.01] * len(pieces), ends * end
        for word, n in counts.items():
            ahead, back, every = sums("▁" + word)
            likelihood += n * ahead[-1]
            for i, j, ids, w in every:
                for k in ids:
                    uses[k] += n * math.exp(ahead[i] + w + back[j] - ahead[-1])
        if likelihood - before < tolerance * total:
            break
        before = likelihood
        logs, end = [math.log(u / (sum(uses) + ends)) for u in uses], math.log(ends / (sum(uses) + ends))
    known = {}
    for own in tokens_of_rows:
        for word in own:
            if word not in known:
                known[word] = sums("▁" + word)[0][-1]
    return [(sum(known[w] for w in own) + end) / math.log(10) for own in tokens_of_rows]


def test_lm_score(docs, none):
    from tomewright.llm.lm_score import score_documents

    def tokens(text):
        return [*WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), "\n"]

    counts = Counter()
    for r in ROWS:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2:
            counts.update(tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in ROWS:
        own = tokens(r[1])
        want[r[0], len(own), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 4)] += 1
    trained = [r for r in ROWS if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    plain = Counter({w: c for w, c in counts.items() if w != "\n"})
    scores = _lattice_score(plain, [tokens(r[1])[:-1] for r in ROWS], len(trained))
    for head in (100_000, 3):
        rows = score_documents(docs, head_words=head).collect()
        assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
        found = sorted((r.doc_id or 0, r.n_tokens, r.score) for r in rows)
        for a, b in zip(found, sorted((r[0] or 0, len(tokens(r[1])), x) for r, x in zip(ROWS, scores, strict=True)), strict=True):
            assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-6)
    clash = docs.withColumnsRenamed({"key": "row", "fp": "word", "n": "train"})
    assert score_documents(clash).count() == len(ROWS)
    assert score_documents(none).count() == 0


def test_edit_similarity():
    from tomewright.llm.line_dedup import edit_similar

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(8)
    for _ in range(800):
        a = [rng.choice("abcdef") for _ in range(rng.randint(1, 90))]
        b = [rng.choice("abcdef") if rng.random() < 0.15 else x for x in a if rng.random() > 0.08] or ["a"]
        assert edit_similar(a, b) == (distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


def test_pairs_of_lines_are_compared_many_at_once(monkeypatch):
    from tomewright.llm import line_dedup as m

    rng = random.Random(9)
    lines = []
    for n in (5, 9, 63, 64, 65, 127, 128, 129, 200, 300):
        for _ in range(60):
            a = [rng.randrange(40) for _ in range(n)]
            share = rng.choice((0.03, 0.08, 0.1, 0.15))
            b = [x if rng.random() > share else rng.randrange(40) for x in a if rng.random() > share] + [rng.randrange(40) for _ in range(rng.randrange(3))]
            lines += sorted((a, b), key=len)
    sizes = np.array([len(x) for x in lines])
    flat, start = np.array(list(itertools.chain(*lines))), np.cumsum(sizes) - sizes
    at = np.arange(0, len(lines), 2)
    want = [m.edit_similar(lines[i], lines[i + 1]) for i in at]
    assert 100 < sum(want) < len(want) - 100
    alone = []
    monkeypatch.setattr(m, "edit_similar", lambda a, b, own=m.edit_similar: alone.append(1) or own(a, b))
    for cells in (1 << 20, 64 * 40):
        monkeypatch.setattr(m, "CELLS", cells)
        assert m.similar_pairs(flat, start, sizes, at, at + 1).tolist() == want
    # Only pairs of lines so long that sixty are few are compared one by one.
    monkeypatch.setattr(m, "CELLS", 1 << 20)
    alone.clear()
    m.similar_pairs(flat, start, sizes, at, at + 1)
    assert len(alone) <= sum(sizes[at] > 128)


def test_pairs_that_their_words_decide_need_no_recurrence(monkeypatch):
    from tomewright.llm import line_dedup as m

    rng = random.Random(11)
    lines = []
    for n in (5, 12, 64, 200, 700):
        for kind in range(3):
            for _ in range(20):
                a = [rng.randrange(-n // 3, n // 3) for _ in range(n)]
                b = list(a)
                if kind == 0:  # a tenth replaced in place, or not, but never more than a fifth
                    for at in rng.sample(range(n), n // 10):
                        b[at] = 10**6 + at
                elif kind == 1:  # half of the words are others
                    for at in rng.sample(range(n), n // 2):
                        b[at] = 10**6 + at
                else:  # the same words elsewhere
                    rng.shuffle(b)
                lines += [a, b]
    sizes = np.array([len(x) for x in lines])
    flat, start = np.array(list(itertools.chain(*lines))), np.cumsum(sizes) - sizes
    at = np.arange(0, len(lines), 2)
    want = [m.edit_similar(lines[i], lines[i + 1]) for i in at]
    compared = []
    monkeypatch.setattr(m, "edit_similar", lambda a, b, own=m.edit_similar: compared.append(1) or own(a, b))
    monkeypatch.setattr(m, "_distances", lambda flat, start, sizes, a, b, deep, own=m._distances: compared.extend(a) or own(flat, start, sizes, a, b, deep))
    for cells in (1 << 20, 300):
        monkeypatch.setattr(m, "CELLS", cells)
        compared.clear()
        assert m.similar_pairs(flat, start, sizes, at, at + 1).tolist() == want
        # Only those with the same words elsewhere.
        assert len(compared) <= len(want) / 3
        x, y = np.array([0, *at]), np.array([len(lines) - 1, *at + 1])
        both = [sum((Counter(lines[i]) & Counter(lines[j])).values()) for i, j in zip(x, y, strict=True)]
        assert m.common_words(flat, start, sizes, x, y).tolist() == both
    assert 50 < sum(want) < len(want) - 50


@pytest.mark.parametrize("rows", [1, 2, 3, 1000])
def test_postings_of_one_line_go_in_any_batches(spark, rows):
    from tomewright.llm import line_dedup as m

    rng = random.Random(12)
    lines = [(key, *[rng.randrange(120) if rng.random() < 0.9 else -1 for _ in m.BLOCKS]) for key in range(40)]
    often = Counter(b for x in lines for b in set(x[1:]) - {-1})
    lines = [(x[0], *[b if b not in x[1 : k + 1] else -1 for k, b in enumerate(x[1:])]) for x in lines]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = m.shared_blocks(spark.createDataFrame(lines, "`key` long, " + ", ".join(f"{b} long" for b in m.BLOCKS))).collect()
        none = m.shared_blocks(spark.createDataFrame([], "`key` long, " + ", ".join(f"{b} long" for b in m.BLOCKS))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not none and Counter(map(tuple, found)) == Counter((x[0], b) for x in lines for b in x[1:] if often[b] > 1)
    assert 0 < len(found) < sum(b != -1 for x in lines for b in x[1:])


def test_links_of_a_unit_span_what_is_similar():
    from tomewright.llm import line_dedup as m

    rng = random.Random(10)
    for n in (2, 7, 40):
        group = [rng.randrange(3) for _ in range(n)]
        pairs = sorted((j, i) for i, j in itertools.combinations(range(n), 2))
        a, b = np.array([i for _, i in pairs]), np.array([j for j, _ in pairs])
        seen = []
        links = m.forest(a, b, n, lambda x, y: seen.append(len(x)) or np.array([group[i] == group[j] for i, j in zip(x, y, strict=True)]))
        assert len(links) == n - len(set(group)) and all(group[i] == group[j] for i, j in links)
        # All pairs that are unlike, few of the others.
        assert sum(seen) <= sum(group[i] != group[j] for i, j in zip(a, b, strict=True)) + 2 * n and len(seen) < 8


def _groups(lines, m):
    """Component number per line by brute force: equal, or similar by edit distance alone."""
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(lines)), 2):
        if lines[a] == lines[b] or (min(len(lines[a]), len(lines[b])) >= 0.75 * max(len(lines[a]), len(lines[b])) and m.edit_similar(*sorted((lines[a], lines[b]), key=len))):
            root[find(b)] = find(a)
    return [find(i) for i in range(len(lines))]


def test_line_dedup(docs, none):
    from tomewright.llm import line_dedup as m

    lines = []
    for i, r in enumerate(ROWS):
        for k, line in enumerate((r[1] or "").split("\n")):
            words = m.normalise(line)
            if len(words) >= 5 or sum(len(w.decode()) for w in words) >= 30:
                lines.append((i, k, words))
    groups = defaultdict(set)
    for g, (row, k, _) in zip(_groups([x[2] for x in lines], m), lines, strict=True):
        groups[g].add((ROWS[row][0] is None, ROWS[row][0] or 0, ROWS[row][1], k))
    # The same row twice is one occurrence; of a group the first one stays.
    stays = {x for g in groups.values() for x in [min(g, key=lambda x: x[:2])] if sum(y[:2] == x[:2] for y in g) == 1}
    loose = {x[:3] for g in groups.values() for x in g if sum(y[:2] == min(g)[:2] for y in g) > 1}
    gone = {x for g in groups.values() for x in g} - stays
    want = Counter()
    for doc, text, *_ in ROWS:
        kept = [x for k, x in enumerate((text or "").split("\n")) if (doc is None, doc or 0, text, k) not in gone]
        if (doc is None, doc or 0, text) not in loose:
            want[doc, len((text or "").split("\n")), len((text or "").split("\n")) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    found = multiset(m.line_digests(docs).collect())
    assert not want - found and sum(found.values()) == len(ROWS)
    assert sum(want.values()) > len(ROWS) - 8 and sum(k[2] for k in want) > 3
    out = m.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() < len(ROWS)
    clash = docs.withColumnsRenamed({"digest": "gone", "fp": "kept", "size": "Digest", "key": "_gone"})
    assert m.dedup_lines(clash).columns == clash.columns
    assert m.dedup_lines(none).count() == 0 and m.line_digests(none).count() == 0


def test_long_postings_of_lines_lose_no_link(spark, monkeypatch):
    from tomewright.llm import line_dedup as m

    rng = random.Random(3)
    shared = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima".split()
    lines = []
    for k in range(40):
        own = [c + chr(97 + k // 26) + chr(97 + k % 26) for c in "abcdefgh"]
        base = shared + own
        lines += [" ".join(base), " ".join(base[:-1] + ["other"]), " ".join(base[:5] + base[6:])]
    rng.shuffle(lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    whole = sorted(r.doc_id for r in m.dedup_lines(docs).collect())
    assert len(whole) == 40
    monkeypatch.setattr(m, "BLOCK", 16)
    assert sorted(r.doc_id for r in m.dedup_lines(docs).collect()) == whole


def test_line_dedup_recall(spark):
    """Links between distinct lines of sf0.01, all pairs compared by edit similarity alone."""
    from tomewright.llm import line_dedup as m

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lines = {}
    for r in docs.collect():
        for line in (r.text or "").split("\n"):
            words = m.normalise(line)
            if len(words) >= 5:
                lines[b" ".join(words)] = words
    own = sorted(lines.values(), key=len)
    bits = np.frombuffer(b"".join(map(m.parity, own)), "<u8").reshape(-1, 8)
    first, sizes = np.bitwise_xor.reduce(bits, axis=1), np.array([len(w) for w in own])
    pairs = []
    for i in range(len(own) - 1):
        upto = int(np.searchsorted(sizes, sizes[i] * 1.25 + 1e-6, side="right"))
        near = np.flatnonzero(np.bitwise_count(first[i + 1 : upto] ^ first[i]) <= 2 * (sizes[i + 1 : upto] // 5)) + i + 1
        pairs += [(i, j) for j in near.tolist() if np.bitwise_count(bits[i] ^ bits[j]).sum() <= 2 * (sizes[j] // 5) and m.edit_similar(own[i], own[j])]
    numbered = spark.createDataFrame([(i, b" ".join(w).decode()) for i, w in enumerate(own)], "doc_id long, text string")
    stay = {r.doc_id for r in m.dedup_lines(numbered).collect()}
    root = list(range(len(own)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    want = {i for i in range(len(own)) if find(i) != i}
    assert len(pairs) > 300
    found = set(range(len(own))) - stay
    assert found <= want and len(found) >= 0.99 * len(want)


def test_pipeline_stages_take_awkward_rows(spark, docs, labels, none, tmp_path):
    """Nulls, blanks, repeated rows and ids, long texts, clashing names, and empty tables pass through each stage."""
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    clash = docs.withColumnsRenamed({"key": "toxic", "fp": "times", "component": "digest2", "score": "row", "n": "gone"})
    for start in (clash, none):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, str(tmp_path)).collect()
            assert stage(spark, now, str(tmp_path)).columns == start.columns, name
            now = spark.createDataFrame(out, start.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in out}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() > 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    rows = docs.collect()
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, rows)) == Counter(map(key, again))
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024


def test_line_dedup_at_least_similarity(spark):
    from tomewright.llm import line_dedup as m

    # Lines with up to a fifth of their words replaced, taken out or put in, most of them beyond three bits of SimHash.
    rng = random.Random(8)
    lines = []
    for n in (5, 6, 9, 10, 14, 20, 31, 50, 93, 160):
        for edits in {1, n // 10 or 1, n // 5}:
            words = [f"w{rng.choice('abcdefghijklmnop') * rng.randrange(1, 30)}" for _ in range(n)]
            lines.append(" ".join(words))
            other = list(words)
            for at in sorted(rng.sample(range(n), edits), reverse=True):
                kind = rng.randrange(3) if n > 9 else 0
                other[at : at + 1] = [["x" + "y" * at], [], [other[at], "z" * (at + 1)]][kind]
            lines.append(" ".join(other))
    lines += [" ".join(rng.choice("the of and to in it is was".split()) for _ in range(7)) for _ in range(60)]
    least = {}
    for i, g in enumerate(_groups([m.normalise(x) for x in lines], m)):
        least[g] = min(least.get(g, i), i)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    stay = {r.doc_id for r in m.dedup_lines(docs).collect()}
    # Half of the pairs are at the least similarity itself, the hardest for four posted blocks.
    want = set(range(len(lines))) - set(least.values())
    assert set(range(len(lines))) - stay <= want and len(want) > 20
    assert len(stay & want) <= 0.05 * len(want)


@pytest.mark.parametrize("size", [10, 20, 50, 100, 200])
@pytest.mark.parametrize("even", [True, False])
def test_lines_at_the_least_similarity_meet(size, even):
    """300 pairs of lines of which exactly a fifth of the words is edited, evenly or at random, share a posted block."""
    from tomewright.llm import line_dedup

    rng = random.Random(size)
    word = lambda letters: "".join(rng.choices(letters, k=7))
    first, second = [], []
    for _ in range(300):
        a = [word("abcdefghijklmnop") for _ in range(size)]
        b = list(a)
        for at in [int((k + 0.5) * 5) for k in range(size // 5)] if even else rng.sample(range(size), size // 5):
            b[at] = word("qrstuvwxyz")
        first.append(" ".join(a))
        second.append(" ".join(b))
    blocks = [line_dedup.lines_of(["\n".join(x)], 5, 30)[5] for x in (first, second)]
    met = sum(bool(set(a) & set(b) - {2**64 - 1}) for a, b in zip(blocks[0].tolist(), blocks[1].tolist(), strict=True))
    assert met >= 270


@pytest.mark.parametrize("size", [200, 1000, 5000])
def test_near_copies_at_the_threshold_are_verified_whole(spark, size):
    """Pairs just above and just below a resemblance of 0.8: most of the former are found, none of the latter."""
    from tomewright.llm.simhash import similar_documents

    rng = random.Random(size)
    docs, above, near = [], [], []
    for p in range(60):
        words = [f"w{rng.randrange(10**8)}" for _ in range(size)]
        other = list(words)
        # An edit apart from others changes five shingles of each side.
        at_most = lambda j: int((size - 4) * (1 - j) / (1 + j) / 5)
        edits = [at_most(0.8), at_most(0.85), at_most(0.8) + 1][p % 3]
        for at in rng.sample(range(4, size - 5, 6), edits):
            other[at] = f"x{rng.randrange(10**8)}"
        found = _alike(" ".join(words), " ".join(other))
        docs += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
        (above if found >= 0.8 else near).append(p)
    rows = {r.doc_id: r.root for r in similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    linked = {p for p in range(60) if rows[2 * p] == rows[2 * p + 1]}
    assert not linked & set(near) and len(above) >= 30 and near
    assert len(linked & set(above)) >= 0.85 * len(above)


def test_long_words_go_in_smaller_batches(spark, monkeypatch):
    from tomewright.llm import lm_score

    rows = [([b"a" * n for n in sizes], list(range(len(sizes)))) for sizes in ([3, 4, 5, 100, 1, 1], [], [7])]
    monkeypatch.setattr(lm_score, "LETTERS", 8)
    cut = list(lm_score.within_letters(iter(rows)))
    assert [[len(w) for w in x[0]] for x in cut] == [[3, 4], [5], [100], [1, 1], [], [7]]
    assert [i for x in cut for i in x[1]] == [0, 1, 2, 3, 4, 5, 0]
    docs = spark.createDataFrame([(i, f"{chr(97 + i) * 3000} common words {i}") for i in range(8)], "doc_id long, text string")
    small = {r.doc_id: r.score for r in lm_score.score_documents(docs).collect()}
    monkeypatch.undo()
    assert small == pytest.approx({r.doc_id: r.score for r in lm_score.score_documents(docs).collect()}, rel=1e-9)
