"""Ranked search, SimHash classes and whitening: brute force, odd inputs, every path."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import lexical_search, simhash, whitening

WORDS = [f"w{k}{'abcdefgh'[k % 8]}" for k in range(300)]
LOWER = {k: k + 32 for k in range(65, 91)}


def made_docs():
    random.seed(11)
    rows = [(k, " ".join(random.choices(WORDS[: 20 + 7 * (k % 40)], k=random.choice([3, 12, 12, 40, 40, 200])))) for k in range(600)]
    rows += [(600 + k, rows[3][1]) for k in range(70)] + [(5, "Ä w1b, w1b! É"), (5, "Ä w1b, w1b! É"), (None, "w2c w2c"), (None, None), (700, None), (701, ""), (702, " .,!\x00"), (703, "w9b " * 30_000), (704, "W1B\x00w2c")]
    return rows


def items_of():
    return [(1, "w1b w2c w1b É"), (2, " ".join(WORDS[5:60])), (3, None), (4, "never seen"), (5, "w9b"), (5, "w8a W9B"), (None, "w10c w299d")]


def terms(t):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))


def brute_ranked(rows, items, k):
    held = [(d, Counter(terms(t))) for d, t in rows]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, want in asked.items():
        found = []
        for d, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 20 * m)) for w in want if w in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,cells,restricted", [(50, 1 << 20, True), (7, 64, False), (3, 1 << 20, True)])
def test_ranked_search_against_brute_force(spark, monkeypatch, k, cells, restricted):
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    docs = spark.createDataFrame(made_docs(), "doc_id long, text string").withColumns({"n": F.lit(1), "terms": F.lit("x"), "m": F.lit(2)})
    items = spark.createDataFrame(items_of(), "item_id long, text string").withColumn("term", F.lit("x"))
    index = lexical_search.build_index(docs, lexical_search.item_terms(items).select("term").distinct() if restricted else None)
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(index, items, k).collect()), key=repr)
    assert got == brute_ranked(made_docs(), items_of(), k)


def test_ranked_search_in_blocks_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 20)
    items, docs = spark.createDataFrame(items_of(), "item_id long, text string"), spark.createDataFrame(made_docs(), "doc_id long, text string")
    monkeypatch.setattr(lexical_search, "VOCABULARY", 3)  # so the index holds all terms
    index = lexical_search.build_index(docs, lexical_search.item_terms(items).select("term").distinct())
    assert index.df.count() > 250
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(index, items, 9).collect()), key=repr)
    assert got == brute_ranked(made_docs(), items_of(), 9)
    index.drop()


def test_ranked_search_stops_at_bounds(spark):
    """Strata whose bounds don't reach the k-th score aren't scored."""
    scored = []

    class Counting(lexical_search._Search):
        def _score(self, who, *rest):
            scored.append(len(who))
            super()._score(who, *rest)

    rows = [(k, " ".join(["w1b"] * (1 + k % 7) + ["x"] * (k % 90))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = lexical_search.build_index(docs)
    (batch,) = index.strata.toArrow().combine_chunks().to_batches()
    (term,) = (r.term for r in lexical_search.item_terms(spark.createDataFrame([(1, "w1b")], "item_id long, text string")).collect())
    one = lexical_search._Items(None, np.array([0]), np.array([0]), np.array([term]), np.array([700]), 1 << 20)
    search = Counting(one, 5)
    search.visit(batch)
    search.settle()
    search.visit(batch)
    assert batch.num_rows > 80 and len(scored) < 1.4 * batch.num_rows


def test_ranked_search_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id string, text string"), spark.createDataFrame([(1, "a b")], "item_id int, text string")
    out = lexical_search.search(lexical_search.build_index(docs), items)
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
    named = spark.createDataFrame([("d1", "a c"), ("d0", "a c"), ("d2", "z")], "doc_id string, text string")
    out = lexical_search.search(lexical_search.build_index(named), items)
    assert [r.doc_id for r in out.orderBy("rank").collect()] == ["d0", "d1"] and dict(out.dtypes)["item_id"] == "int"
    assert lexical_search.search(lexical_search.build_index(named), items.limit(0)).count() == 0


def fingerprint(t):
    w = re.findall("[^ \t\n\x0b\x0c\r]+", (t or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash(rows):
    fp = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_simhash_against_brute_force(spark):
    random.seed(5)
    base = [" ".join(random.choices(WORDS, k=90)) for _ in range(12)]
    rows = [(1000 - k, base[k % 12]) for k in range(60)]
    for k in range(300):
        w = base[k % 12].split(" ")
        w[random.randrange(90)] = random.choice(WORDS)
        rows.append((k, (" \n" if k % 2 else " ").join(w).upper() + " " * (k % 3)))
    rows += [(2000, None), (2001, ""), (None, " \t"), (2002, "one"), (2003, "ONE"), (2004, "é\x00 ▁ 😀"), (2005, "x" * 300_000), (7, base[0]), (7, base[0]), (None, "lone words here stand"), (2006, " ".join(WORDS) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "anchor": F.lit(2), "root": F.lit(3), "least": F.lit(4)})
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    want = brute_simhash(rows)
    assert got == want
    assert any(c != d for d, _, c in want if d is not None and d < 300)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    named = docs.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(named).collect()), key=repr)
    text = lambda d: None if d is None else f"{d:05d}"
    assert got == sorted(((text(d), text(c)) for d, _, c in want), key=repr)


def test_xxh64_equals_the_function_of_the_engine(spark):
    random.seed(6)
    texts = ["".join(random.choices("abÄ中 x", k=k)) for k in [*range(1, 140), 254, 255, 256, 257, 5000]]
    raw = [t.encode() for t in texts]
    start = np.cumsum([0, *map(len, raw)])
    ours = simhash.xxh64(np.frombuffer(b"".join(raw), np.uint8), start[:-1].astype(np.int64), np.diff(start).astype(np.int64))
    theirs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", F.xxhash64("t").alias("h")).orderBy("k").collect()
    assert [int(x) for x in ours.view(np.int64)] == [r.h for r in theirs]


@pytest.mark.parametrize("code", range(len(simhash.CODES)))
def test_codes_cover(code):
    chosen = simhash.CODES[code]()
    words = np.random.default_rng(code).integers(0, 1 << 64, 2000, dtype=np.uint64)
    home, near = chosen.home(words), chosen.around(words)
    assert (chosen.home(home) == home).all() and np.bitwise_count(home ^ words).max() <= chosen.radius
    assert np.bitwise_count(near ^ words[:, None]).max() <= chosen.radius + simhash.DIFFER
    flips = np.uint64(1) << np.random.default_rng(1).integers(0, 64, (2, 2000)).astype(np.uint64)
    assert (near == chosen.home(words ^ flips[0])[:, None]).any(1).all() and (near == chosen.home(words ^ (flips[0] | flips[1]))[:, None]).any(1).all()
    assert 1 << chosen.bits >= 64 and simhash.choose_code(simhash.AT_ANCHOR << chosen.bits) == code


@pytest.mark.parametrize("code,hot", [(0, 1 << 15), (1, 40), (2, 3), (3, 1 << 15), (4, 8), (2, 0)])
def test_linked_fingerprints_on_every_path(spark, code, hot):
    """Chains, balls and far words; with few allowed at an anchor, nearly all go the linear way."""
    rng = random.Random(9)
    words = {rng.getrandbits(64) for _ in range(300)}
    for start in list(words)[:6]:
        x = start
        for _ in range(25):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            words.add(x)
        words |= {start ^ 1 << b for b in range(64)}
    words = sorted(words)
    root = {w: w for w in words}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for w in words:
        for b in range(64):
            for c in range(b, 64):
                other = w ^ (1 << b) ^ ((1 << c) if c != b else 0)
                if other in root and find(other) != find(w):
                    root[find(w)] = find(other)
    want = defaultdict(set)
    for w in words:
        want[find(w)].add(w)
    signed = lambda w: w - (1 << 64) if w >> 63 else w
    rows = simhash.linked_fingerprints(spark.createDataFrame([(signed(w),) for w in words], "fp long"), code, hot).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.root].add(r.node % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def vectors():
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6))
    rows = [(int(k), [float(e) for e in (rng.normal(size=6) @ mix).astype(np.float32)]) for k in range(400)]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(250)] + [(7, rows[7][1]), (None, rows[8][1]), (None, None)]
    bad = [[1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], [1.0] * 5, [], None]
    return rows, [(2000 + k, v) for k, v in enumerate(bad)]


@pytest.mark.parametrize("weights,components,scale", [("one", 4, 256), ("count", 9, 1000)])
def test_whitening_against_numpy(spark, weights, components, scale):
    good, bad = vectors()
    rows = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "w": F.lit(2), "count": F.lit(3), "k1": F.lit(4)})
    got = whitening.whiten(rows, components, weights, scale).collect()
    have = [(k, v) for k, v in good if v is not None]
    x = np.floor(scale * np.array([v for _, v in have])).astype(np.int64)
    fit = np.unique(x, axis=0) if weights == "one" else x
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1], q[:, ::-1]
    k = min(components, 6)
    want = np.abs((x - total / n) @ q[:, :k] / np.sqrt(values[:k]))
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
        assert r.n == n and r.identity_error < 1e-8 and abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
    assert sum(map(len, by.values())) == k * len(have) and len(by[7]) == 2 * k and not any(d in by for d, _ in bad)
    for (d, _), y, row in zip(have, want, x, strict=True):
        if d is not None and d != 7:
            assert np.allclose([abs(r.whitened) for r in sorted(by[d], key=lambda r: r.component)], y, atol=1e-9)
            assert {int(r.deviation) for r in by[d]} == {sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, total, strict=True))}
    signs = {tuple(np.sign(r.whitened) for r in sorted(by[d], key=lambda r: r.component)) for d in (0, 1000, 1003)}
    assert len(signs) == 1


def test_whitening_of_little_or_huge(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    out = whitening.whiten(frame([]))
    assert out.count() == 0 and dict(out.dtypes)["vec_id"] == "string"
    assert whitening.whiten(frame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])])).count() == 0
    line = whitening.whiten(frame([("a", [1.0, 2.0]), ("b", [2.0, 4.0]), ("c", [-0.0, 0.0])])).collect()
    assert {r.component for r in line} == {1} and len(line) == 3 and abs(sum(r.whitened**2 for r in line) / 3 - 1) < 1e-12
    big = whitening.whiten(frame([("a", [1e12, 2.0]), ("b", [2e12, 4.0]), ("c", [1e18, 4.0])]), components=1).collect()
    want = {"a": 256 * 10**12, "b": 512 * 10**12, "c": 2**63 - 1}
    total = sum(want.values())
    exact = {k: (3 * v - total) ** 2 for k, v in want.items()}
    for r in big:
        rest = (3 * 512 - 2560) ** 2 if r.vec_id == "a" else (3 * 1024 - 2560) ** 2
        assert r.deviation is None if exact[r.vec_id] + rest >= 10**38 else int(r.deviation) == exact[r.vec_id] + rest


def test_forest_of_random_links():
    from ledgerlens.llm.near_dup import _forest

    rng = np.random.default_rng(4)
    for _ in range(300):
        size = int(rng.integers(2, 80))
        i, j = rng.integers(0, size, (2, int(rng.integers(0, 2 * size))))
        root = np.arange(size)
        for _ in range(size):
            for a, b in zip(i, j, strict=True):
                root[a] = root[b] = min(root[a], root[b])
        assert np.array_equal(_forest(i, j, size), root)
