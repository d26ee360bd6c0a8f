"""Near-duplicates by odd sketches against exact similarities of all pairs."""

import random
from collections import Counter

import numpy as np
import pytest


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k=2, percent=80):
    """(id, set size, smallest id reachable) per row, from all pairs of distinct sets."""
    sets = [shingles(t, k) for _, t in rows]
    nodes = sorted({s for s in sets if s}, key=sorted)
    top = list(range(len(nodes)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(nodes):
        for j in range(i):
            both = len(a & nodes[j])
            if both and 100 * both >= percent * (len(a) + len(nodes[j]) - both):
                top[root(i)] = root(j)
    place = {s: root(i) for i, s in enumerate(nodes)}
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[place[s]] = min(i, least.get(place[s], i))
    out = []
    for (i, _), s in zip(rows, sets):
        c = least.get(place[s]) if s else i
        out.append((i, len(s), c, i == c))
    return Counter(out)


def family(r, first, size, n_words, edits):
    base = [f"w{r.randint(0, 3000)}" for _ in range(n_words)]
    out = []
    for k in range(size):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(n_words)] = f"e{r.randint(0, 10 ** 6)}"
        out.append((first + k, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def texts(rows):
    r = random.Random(8)
    out = [(x[0], x[1]) for x in rows]
    out += family(r, 1000, 60, 80, 5) + family(r, 2000, 80, 200, 24) + family(r, 3000, 40, 12, 1)
    out += [(4000 + i, " ".join(r.choice("abcdef") for _ in range(r.randint(1, 5)))) for i in range(120)]
    out += [(5000 + i, " ".join(f"v{r.randint(0, 40)}" for _ in range(60))) for i in range(40)]
    out += [(1005, out[-1][1]), (None, out[60][1].upper()), (None, "all its own words here"), (6000, "One TWO three"),
            (6000, "one two  THREE"), (6000, ""), (6001, None)]
    r.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, node string, key long, kept string"


@pytest.mark.parametrize("block,block_bytes", [(2048, 8 << 20), (8, 5000)])
def test_components_equal_brute_force(spark, texts, block, block_bytes):
    from flowforge.llm.odd_sketch import near_duplicates
    df = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in texts], SCHEMA).repartition(5)
    got = near_duplicates(df, shingle=2, block=block, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == brute(texts)


def test_other_shingles_and_thresholds(spark, texts):
    from flowforge.llm.odd_sketch import near_duplicates
    df = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in texts], SCHEMA)
    assert Counter(map(tuple, near_duplicates(df, shingle=5, percent=90).collect())) == brute(texts, 5, 90)
    assert near_duplicates(df.limit(0)).count() == 0


def test_query_on_test_data(spark):
    from flowforge.llm.queries import op13_minhash_neardup
    sf = "/root/testdata/sf0.001"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, op13_minhash_neardup(spark, sf).collect())) == brute(rows)


def test_a_very_long_text(spark):
    from flowforge.llm.odd_sketch import near_duplicates
    long = [f"w{k * k % 100_003}" for k in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[5000:])), (3, "a " * 500_000), (4, "a a"), (5, "\n" * 500_000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_sketch_estimates_and_keys():
    """Estimates lie round the true similarity; pairs at the threshold pass and share a key."""
    from flowforge.llm import odd_sketch as o
    r = np.random.default_rng(5)
    most = o.most_differing(0.8, o.ROWS * o.BANDS)
    low, shared, passed, far = [], 0, 0, 0
    for trial in range(200):
        union = r.integers(0, 1 << 63, 200).astype(np.uint64)
        a, b = np.sort(union[:180]), np.sort(union[20:])  # 160 of 200 in common
        c = np.sort(np.r_[union[:60], r.integers(0, 1 << 63, 120).astype(np.uint64)])
        v = o.min_hashes(np.r_[a, b, c], np.array([0, 180, 360]), o.ROWS * o.BANDS)
        s, k = o.odd_sketches(v), o.band_keys(v)
        x = np.bitwise_count(s[0] ^ s[1]).sum()
        low.append(o.likeness(x, v.shape[1]))
        passed += x <= most
        far += np.bitwise_count(s[0] ^ s[2]).sum() <= most
        shared += bool(set(k[0].tolist()) & set(k[1].tolist()))
        assert np.array_equal(k, o.band_keys(v.copy()))
    assert abs(np.mean(low) - 0.8) < 0.01 and np.std(low) < 0.05
    assert passed == 200 and shared == 200 and far == 0


def test_min_hashes_are_independent_of_steps(monkeypatch):
    from flowforge.llm import odd_sketch as o
    r = np.random.default_rng(6)
    sizes = [1, 5, 40, 3, 700, 2]
    flat = r.integers(0, 1 << 63, sum(sizes)).astype(np.uint64)
    starts = np.cumsum([0] + sizes[:-1])
    one = o.min_hashes(flat, starts, 16)
    monkeypatch.setattr(o, "STEP", 8)
    assert np.array_equal(one, o.min_hashes(flat, starts, 16))
    want = [(flat[a:a + n, None] * o.multipliers(16)[None]).min(axis=0) for a, n in zip(starts, sizes)]
    assert np.array_equal(one, np.array(want))
