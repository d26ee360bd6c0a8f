"""Periodic runs against a brute-force search over all stretches."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest


def words(t):
    return (t or "").encode().split()


def brute_runs(w, least=12):
    """Every lag: stretches of equal words, longest possible; the least lag of a stretch counts."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e + q - i >= max(least, 2 * q):
                found.setdefault((i, e + q), q)
            i = e + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_kept(w, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def planted(i, w):
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def brute_row(i, t):
    w = planted(i, words(t))
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(brute_kept(w, runs)).hexdigest())


def test_query_equals_brute_force(spark, rows, tmp_path):
    from flowforge.llm.queries import op11_periodic_runs
    r = random.Random(3)
    more = [(100 + k, " ".join(r.choice("abc"[:1 + k % 3]) for _ in range(r.randint(0, 90)))) for k in range(120)]
    more += [(300 + k, " ".join((["u", "v", "w", "x", "y", "z"][:1 + k % 6] * 9)[:r.randint(9, 40)] + ["end"] * (k % 3)))
             for k in range(60)]
    docs = [(i, t, "s", "clash", 1) for i, t in [(x[0], x[1]) for x in rows] + more]
    schema = "doc_id long, text string, runs string, collapsed string, id long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_row(d[0], d[1]) for d in docs)
    from flowforge.llm.periodic_runs import periodic_runs
    assert periodic_runs(spark.createDataFrame([], schema)).collect() == []


def test_small_table_of_test_data(spark):
    from flowforge.llm.queries import op11_periodic_runs
    sf = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
            if len(words(r["text"])) < 1500]
    got = {r["doc_id"]: tuple(r) for r in op11_periodic_runs(spark, sf).collect()}
    for r in docs:
        assert got[r["doc_id"]] == brute_row(r["doc_id"], r["text"])


@pytest.mark.parametrize("n,letters", [(400, 2), (300, 3), (500, 1), (200, 12), (64, 4)])
def test_segments_and_runs_of_random_words(n, letters):
    from flowforge.llm.periodic_runs import runs_in_segments, stable_segments
    r = np.random.default_rng(n + letters)
    for _ in range(20):
        code = r.integers(0, letters, n)
        if letters > 3:  # words that stand once split the text
            code[r.integers(0, n, 20)] = 1000 + np.arange(20)
        first, end = stable_segments(code, np.zeros(n, np.int64))
        for a, b in zip(first, end):
            assert min(Counter(code[a:b].tolist()).values()) > 1
        assert [tuple(x) for x in runs_in_segments(code, first, end).tolist()] == brute_runs(code.tolist())


def test_splitting_in_chains_is_searched_from_both_ends(monkeypatch):
    """Every round makes one more word rare, so rounds over all words would be quadratic."""
    from flowforge.llm import periodic_runs as p
    n = 3000
    code = np.repeat(np.arange(n), 2)
    code = np.r_[0, code[:-1]]  # 0 0 0 1 1 2 2 ...: stable
    chain = np.array([x for k in range(n) for x in (k, k + n + 1, k + 1, k + n)])
    for c in (code, chain):
        doc = np.zeros(len(c), np.int64)
        a, b = p.stable_segments(c, doc)
        monkeypatch.setattr(p, "SLOW_ROUND", 2.0)
        x, y = p.stable_segments(c, doc)
        monkeypatch.undo()
        assert a.tolist() == x.tolist() and b.tolist() == y.tolist()


def test_hash_collisions_do_no_harm():
    """Prefix hashes that are all alike: the stretches are compared word by word."""
    from flowforge.llm.periodic_runs import runs_in_segments
    r = np.random.default_rng(1)
    for _ in range(30):
        code = r.integers(0, 2, 60)
        one = runs_in_segments(code, np.array([0]), np.array([60]), sums=np.zeros(61, np.uint64))
        assert [tuple(x) for x in one.tolist()] == brute_runs(code.tolist())


def test_very_long_texts(spark):
    from flowforge.llm.periodic_runs import periodic_runs
    r = random.Random(2)
    prose = [f"w{min(int(r.expovariate(0.01)), 5000)}" for _ in range(300_000)]
    rows = [(1, "a " * 200_000), (2, " ".join(f"w{k % 300}" for k in range(200_000))), (3, " ".join(prose)),
            (4, " ".join(r.choice("ab") for _ in range(200_000))), (5, " " * 1_000_000), (6, "z" * 1_000_000)]
    got = {x["doc_id"]: x for x in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 200_000, 1)] and got[1]["collapsed"] == "a"
    assert [tuple(x) for x in got[2]["runs"]] == [(0, 200_000, 300)]
    assert got[3]["n_words"] == 300_000 and got[5]["n_words"] == 0 and got[6]["n_words"] == 1
    w = rows[3][1].split()
    for s, m, q in map(tuple, got[4]["runs"]):
        assert m >= max(12, 2 * q) and w[s:s + m - q] == w[s + q:s + m]
        assert (s == 0 or w[s - 1] != w[s + q - 1]) and (s + m == len(w) or w[s + m] != w[s + m - q])
