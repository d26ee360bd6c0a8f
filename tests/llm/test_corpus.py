"""Corpus operators against brute force on a small fixture of odd cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest


def words(t):
    return (t or "").encode().split()


def test_quality_rules(docs, rows, none):
    from flowforge.llm.quality import quality_rules
    got = Counter()
    for r in quality_rules(docs).collect():
        got[(r["doc_id"], r["text"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
             r["n_repeat_words"], r["base_failed"], r["kept"])] += 1
    want = Counter()
    for i, t, *_ in rows:
        w = words(t)
        tri, cov = Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if tri[tuple(w[k:k + 3])] > 1:
                cov |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(cov) > 50 * len(w)
        want[(i, t, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"),
              len(lines) - len(set(lines)), len(cov), failed, not failed)] += 1
    assert got == want  # no line reaches the limit here
    assert quality_rules(none).count() == 0


def test_quality_line_frequency(spark):
    from flowforge.llm.quality import quality_rules
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(12)]
    rows = [(i, own[i] + "\nAccept  ALL cookies", "h") for i in range(12)] \
        + [(100 + i, "Accept all cookies\n" * 30 + "tail %d" % i, "h") for i in range(3)] \
        + [(200, own[0] + "\nAccept all cookies", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (0, 500_000):  # joined by shuffle, and broadcast
        got = {r["doc_id"]: r for r in quality_rules(df, min_line_docs=4, line_share=0.1, max_repeat_share=100,
                                                     broadcast_rows=limit).collect()}
        assert got[0]["removed_words"] == 0 and got[0]["clean_text"] == rows[0][1]  # first holder keeps it
        assert got[5]["removed_words"] == 3 and got[5]["clean_text"] == own[5] and got[5]["kept"]
        assert got[101]["removed_words"] == 90 and not got[101]["kept"]  # depleted
        assert got[200]["removed_words"] == 0


def test_quality_line_limits_of_small_and_hot_hosts(spark):
    from flowforge.llm.quality import quality_rules
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(60)]
    rows = [(i, own[i] + "\nOn every page" + ("\nheld by four" if i < 4 else ""), "small") for i in range(20)]
    rows += [(1000 + i, own[i] + "\nOn some pages" + ("\nheld by forty" if i < 40 else ""), "hot") for i in range(55)]
    rows += [(2000 + i, f"page {i}", "hot") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["removed_words"] for r in quality_rules(df).collect()}
    assert got == {i: 3 if 0 < i < 20 or 1000 < i < 1055 else 0 for i in got} and len(got) == len(rows)


def test_quality_repeated_rows(spark):
    from flowforge.llm.quality import quality_rules
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(9)]
    common = "\n" + " ".join(f"c{k}" for k in range(30))
    rows = [(i, own[i] + common, "h") for i in range(7)]
    rows += [rows[5]] * 2 + [(6, own[7] + common + common, "h")]  # a row that stands thrice, an id with two texts
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["doc_id"], r["n_words"], r["removed_words"], r["kept"]) for r in quality_rules(df).collect()]
    assert sorted(got) == [(0, 90, 0, True)] + [(i, 90, 30, True) for i in (1, 2, 3, 4, 5, 5, 5, 6)] + [(6, 120, 60, True)]


def test_chat_masks(spark):
    from flowforge.llm.chat import conversation_digests, escape, format_conversations, unescape
    x = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", x), (-1, 1, "assistant", x), (1, 0, "user", None), (1, 1, "assistant", None),
            (2, 0, "system", "s"), (2, 1, "assistant", "a\n<\\|b"), (2, 2, "user", "q"), (2, 2, "assistant", "日🙂é "),
            (3, 0, "assistant", "\n\n lead"), (None, 0, "assistant", "no id")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k} | <|im_sep|> " * 9) for k in range(40)]
    rows += [(5, 0, "assistant", "twice"), (5, 0, "assistant", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for c in {r[0] for r in rows}:
        v = sorted((t, r, x or "") for i, t, r, x in rows if i == c)
        loss = "".join(x for _, r, x in v if r == "assistant")
        want[c] = (len(v), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in v).encode()).hexdigest(),
                   len(loss), hashlib.sha256(loss.encode()).hexdigest())
    rendered = {c: sum(len(f"<|im_start|><|im_sep|><|im_end|>{escape(r)}{escape(x or '')}") for i, _, r, x in rows if i == c)
                for c in want}
    for chunk in (1 << 20, 300):  # whole, and cut between turns
        for in_order in (True, False):
            out = conversation_digests(format_conversations(df, chunk_chars=chunk), in_order).collect()
            assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in out} == want
            assert {r["conv_id"]: r["formatted_chars"] for r in out} == rendered
    for s in ("", "<|", "<\\|", "<\\\\|x<|", x, "<<||"):
        assert unescape(escape(s)) == s and "<|" not in escape(s)
    assert format_conversations(df.limit(0)).count() == 0


def test_offsets_are_those_of_the_library():
    from flowforge.llm.chat import make_tokenizer, token_bytes, token_offsets
    tok = make_tokenizer("byte_bpe_50k.json")
    lengths = token_bytes(tok)
    for s in ("", "a b  c\n\n", "<|im_start|>user<|im_sep|> 日🙂é ﬁ<|im_end|>", "<|endoftext|>x", "e\u0301 \u200b" * 50, " " * 3000):
        enc = tok.encode(s, add_special_tokens=False)
        got = token_offsets(s, np.array(enc.ids, np.int32), lengths)
        assert [tuple(x) for x in np.stack(got, axis=1).tolist()] == enc.offsets


def test_cut_spans():
    from flowforge.llm.chat import cut_spans
    m, a, e = cut_spans(np.array([0, 3, 5, 9, 12]), np.array([3, 5, 9, 12, 12]), np.array([4, 10]), np.array([6, 12]))
    assert m.tolist() == [False, True, True, True, False]
    assert [(x, y) for x, y, k in zip(a, e, m) if k] == [(4, 5), (5, 6), (10, 12)]


def brute_fingerprint(t):
    import xxhash
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {f: root(f) for f in fps}


def test_simhash(docs, rows, none):
    from flowforge.llm.simhash import keep_one_of_each, simhash_components
    fp = [brute_fingerprint(r[1]) for r in rows]
    root = brute_components(set(fp))
    low = defaultdict(list)
    for r, f in zip(rows, fp):
        low[root[f]].append(r[0])
    name = {k: min([x for x in v if x is not None], default=None) for k, v in low.items()}
    want = Counter((r[0], f"{f:016x}", name[root[f]]) for r, f in zip(rows, fp))
    assert Counter(tuple(r) for r in simhash_components(docs).collect()) == want
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(name.values())
    assert simhash_components(none).count() == 0


def test_components_with_one_smallest_id(spark):
    from flowforge.llm.simhash import keep_one_of_each
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "pq")
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in keep_one_of_each(df).collect()) == [(1, a), (1, b)]


def test_simhash_links_of_near_fingerprints(spark):
    from flowforge.llm.simhash import candidate_links, connected_components
    r = np.random.default_rng(3)
    fps = set()
    for base in r.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        for _ in range(12):
            x = base
            for b in r.choice(64, r.integers(0, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    want = Counter(Counter(brute_components(fps).values()).values())
    for block in (2048, 4):  # whole keys, and keys cut into pairs of blocks
        comp = connected_components(candidate_links(df, block=block))
        sizes = Counter(r["count"] + 1 for r in comp.groupBy("root").count().collect())
        sizes[1] = len(fps) - sum(k * v for k, v in sizes.items())
        assert sizes == want


def test_substrings(docs, rows, none):
    from flowforge.llm.substrings import remove_repeated_windows
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k:k + 13])] = min(i, first.get(tuple(w[k:k + 13]), i))
    want = Counter()
    for i, t, src, *_ in rows:
        w = words(t)
        cut = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                cut[k:k + 13] = [True] * 13
        want[(i, len(w), sum(cut), b" ".join(x for x, c in zip(w, cut) if not c).decode(), src)] += 1
    got = remove_repeated_windows(docs, carry=["source"])
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text", "carried.source").collect()) == want
    assert remove_repeated_windows(none).count() == 0


def test_windows_of_hot_minimisers_are_split(spark, docs):
    from flowforge.llm import substrings as S
    from flowforge.llm.batches import unpack
    import pyarrow as pa
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, " ".join(f"a{i}x{k}" for k in range(20)) + f" {passage} " + " ".join(f"b{i}x{k}" for k in range(20)))
            for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total = sum(len(t) for _, t in rows)
    hot = S.hot_minimisers(df, "doc_id", "text", 13, 3, total, 60)
    batch = pa.table({"batch": [0] * 200, "id": [i for i, _ in rows], "text": [t for _, t in rows]})
    most = [max(len(unpack(b, np.int32, np.int64, np.int64, None)[3].split()) for b in S._send(13, 3, 4096, h)(
        (pa.scalar(0),), batch).column("strings").to_pylist()) for h in (S.NO_HOT, hot)]
    assert len(hot) and most[1] * 10 < most[0]  # one bucket had the strings of all holders
    got = {r["doc_id"]: r["n_removed"] for r in S.remove_repeated_windows(df, hot_windows=60).collect()}
    assert got == {i: 30 if i else 0 for i, _ in rows}
    want, got = (Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in
                         S.remove_repeated_windows(docs, hot_windows=h).collect()) for h in (S.HOT_WINDOWS, 20))
    assert got == want


def test_partitions_follow_the_bytes(docs, monkeypatch):
    from flowforge.llm import common
    from flowforge.llm.lm_score import stupid_backoff
    from flowforge.llm.minhash_order import fingerprint_neighbours
    from flowforge.llm.substrings import remove_repeated_windows
    from flowforge.llm.suffixes import remove_repeated_bytes

    def results():
        return [Counter(map(str, op(docs).collect())) for op in (
            remove_repeated_windows, remove_repeated_bytes, lambda d: stupid_backoff(d, batch_bytes=4000),
            fingerprint_neighbours)]

    few = results()
    monkeypatch.setattr(common, "TASK_BYTES", 5000)  # more partitions than the session sets
    width = common.deal_width(docs.sparkSession, common.text_bytes(docs, "text"))
    assert width > common.shuffle_width(docs.sparkSession)
    assert common.dealt(docs, "doc_id", 10 * 5000).rdd.getNumPartitions() == 10
    assert results() == few


def test_hot_list_is_bounded(docs, monkeypatch):
    from flowforge.llm import substrings as S
    asked = []
    find = S.hot_minimisers
    monkeypatch.setattr(S, "HOT_LIST", 4000)
    monkeypatch.setattr(S, "hot_minimisers", lambda *a: asked.append((find(*a), a[-2], a[-1])) or asked[-1][0])
    want = Counter(map(str, S.remove_repeated_windows(docs, hot_windows=1 << 17).collect()))
    got = Counter(map(str, S.remove_repeated_windows(docs, hot_windows=1).collect()))
    assert got == want
    hot, total, limit = asked[-1]
    assert 0 < len(hot) <= 4000 and limit >= total / 4000 and (np.diff(hot.view(np.int64)) != 0).all()


def test_window_sort_survives_hash_collisions(monkeypatch):
    from flowforge.llm import substrings as S
    r = np.random.default_rng(1)
    word = r.integers(0, 3, 400)
    start = np.arange(400 - 12)
    monkeypatch.setattr(S, "span_hash", lambda s, a, b: (a % 5).astype(np.uint64) * 0)  # one hash for all
    order, first = S.same_windows(word, start, 13)
    group = np.cumsum(first) - 1
    of = np.empty(len(start), int)
    of[order] = group
    text = [tuple(word[k:k + 13]) for k in start]
    assert len(set(zip(of.tolist(), text))) == len(set(text)) == group[-1] + 1


def test_url_filter(spark):
    from flowforge.llm.urls import filter_urls, labelled_urls
    rows = [(1, "https://A.Example.ORG/es/1?x", "allowed"), (2, "http://example.org/en/17#t", None), (3, "http://x.com/fr/", None),
            (4, "http://x.com/de/q", None), (5, None, None), (6, "no scheme", None), (7, "http://notexample.org/es/", None),
            (8, "https://www.cheap-pills.example.net/buy/now", None), (9, "https://library.example.net/en/3", None),
            (10, "http://x.org", None), (10, "http://x.org", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    labelled = labelled_urls(spark)
    got = {r["page_id"]: r for r in filter_urls(df, labelled).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == \
        ("a.example.org", "/es/1", "example.org/es/", "block")
    assert [got[k]["rule"] for k in (2, 3, 4, 5, 6, 7, 10)] == \
        ["example.org/en/1", "com/fr/", "com/de/", None, None, "org/", None]
    assert (got[5]["host"], got[6]["path"]) == ("", "")
    assert got[8]["verdict"] == "block" and got[9]["verdict"] == "allow"
    assert filter_urls(df.limit(0), labelled).count() == 0
    # the columns that come in keep clashing names out of the result, repeated rows stay
    clash = df.select("page_id", "url", "verdict", "verdict").toDF("score", "url", "rule", "host")
    assert Counter(filter_urls(clash, labelled).groupBy("url").count().collect()) == \
        Counter(df.groupBy("url").count().collect())


def test_url_filter_on_words_it_has_not_seen(spark):
    from flowforge.llm.urls import filter_urls, labelled_urls, labelled_words
    every = labelled_words()
    assert len(every) == len({w for w, _ in every})
    fit, held = [w for i, w in enumerate(every) if i % 4 != 2], [w for i, w in enumerate(every) if i % 4 == 2]
    out = filter_urls(labelled_urls(spark, held), labelled_urls(spark, fit), rules=()) \
        .select("host", "label", "verdict").collect()
    right = {x: np.mean([(r["verdict"] == "block") == (x == 1.0) for r in out if r["label"] == x]) for x in (0.0, 1.0)}
    assert right[0.0] >= 0.93 and right[1.0] >= 0.4  # 0.96 and 0.49 when written
    # sites outside the table, each on many paths: the path's number does not turn the verdict
    pages = spark.createDataFrame([(h, f"http://{h}/{lang}/{137 * n}{end}") for n in range(30)
                                   for lang in ("en", "es") for end in ("", ".html", "/")
                                   for h in ("m.slots-palace.example.com", "cheap-viagra.example.net",
                                             "town-library.example.org", "www.rosen.example.com")], "site string, url string")
    got = {r["site"]: r["b"] for r in filter_urls(pages, labelled_urls(spark), rules=()).groupBy("site").agg(
        {"verdict": "max", "*": "count"}).withColumnRenamed("max(verdict)", "b").collect()}
    low = {r["site"]: r["b"] for r in filter_urls(pages, labelled_urls(spark), rules=()).groupBy("site").agg(
        {"verdict": "min"}).withColumnRenamed("min(verdict)", "b").collect()}
    assert got == low == {"m.slots-palace.example.com": "block", "cheap-viagra.example.net": "block",
                          "town-library.example.org": "allow", "www.rosen.example.com": "allow"}


def brute_bytes(texts, length):
    count = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        cut = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k:k + length]] > 1:
                cut[k:k + length] = True
        out.append(cut)
    return out


def test_suffixes(docs, rows, none):
    from flowforge.llm.suffixes import remove_repeated_bytes
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, cut in zip(rows, texts, brute_bytes(texts, 200)):
        spans = int((np.diff(np.concatenate(([0], cut.astype(int)))) == 1).sum())
        want[(r[0], len(t), int(cut.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~cut]))] += 1
    for shard in (2 << 20, 700):  # one shard, and shards merged by binary search
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
                      for r in remove_repeated_bytes(docs, shard_bytes=shard).collect())
        assert got == want
    assert remove_repeated_bytes(none).count() == 0


def test_hot_minimisers_are_split(docs):
    from flowforge.llm import suffixes as S
    from flowforge.llm.batches import blob_table, unpack
    import pyarrow as pa
    r = np.random.default_rng(3)
    passage = bytes(r.integers(97, 123, 120, dtype=np.uint8))
    texts = [bytes(r.integers(97, 123, 40, dtype=np.uint8)) + passage + bytes(r.integers(97, 123, 40, dtype=np.uint8))
             for _ in range(60)]
    batch = pa.table({"batch": [0] * 60, "id": list(range(60)), "text": [t.decode() for t in texts]})
    sizes = {}
    for hot_bytes in (400, 1 << 30):
        seen = S._send_minimisers(50, 16, 1)((pa.scalar(0),), batch)
        hot = S._repeated_minimisers(hot_bytes / 84)((pa.scalar(0),), seen)
        sent = S._send_segments(50, 16, 1024)((pa.scalar(0),), batch, hot).to_pylist()
        sizes[hot_bytes] = max(len(unpack(x["segments"], np.int32, np.uint8, np.uint64, np.int32, None)[0])
                               for x in sent if x["bucket"] >= 0)
        answers = pa.concat_tables([S._find_repeats(50, 1 << 20)((pa.scalar(x["bucket"]),), pa.Table.from_pylist([x]))
                                    for x in sent] or [blob_table(batch=([], pa.int64()), answer=([], pa.binary()))])
        out = S._remove(50, 16)((pa.scalar(0),), batch, answers).to_pylist()
        assert [x["n_removed"] for x in out] == brute_removed(texts, 50)
    assert sizes[400] * 2 < sizes[1 << 30]  # a whole minimiser is in one bucket before the cut
    want, got = (Counter((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.remove_repeated_bytes(
        docs, hot_bytes=h).collect()) for h in (S.HOT_BYTES, 400))
    assert got == want


def brute_removed(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone.update(range(i, i + length))
        out.append(len(gone))
    return out


def test_suffix_array_and_prefixes():
    from flowforge.llm.suffixes import common_prefixes, suffix_array
    r = np.random.default_rng(2)
    t = np.concatenate([r.integers(1, 4, 300), np.tile([1, 2], 60), r.integers(1, 3, 200)]).astype(np.uint8)
    sa = suffix_array(t, len(t))
    raw = t.tobytes()
    assert sa.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
    lcp = common_prefixes(t, sa)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
        n = 0
        while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert lcp[b] == n


def test_stupid_backoff(docs, rows, none):
    from flowforge.llm.lm_score import stupid_backoff
    texts = [(r[0], words(r[1])) for r in rows]

    def grams(w):
        return Counter(tuple(w[k - n + 1:k + 1]) for n in (1, 2, 3) for k in range(n - 1, len(w)))
    every = sum((grams(w) for _, w in texts), Counter())
    total = sum(len(w) for _, w in texts)
    want = []
    for i, w in texts:
        own, s = grams(w), 0.0
        for k in range(len(w)):
            top = min(3, k + 1)
            for n in range(top, 0, -1):
                g = tuple(w[k - n + 1:k + 1])
                c = every[g] - own[g]
                if n == 1:
                    s += math.log(max(c, 1) / max(total - len(w), 1)) + (top - 1) * math.log(0.4)
                elif c:
                    s += math.log(c / (every[g[:-1]] - own[g[:-1]])) + (top - n) * math.log(0.4)
                    break
        want.append((-1 if i is None else i, len(w), round(s, 6)))
    got = stupid_backoff(docs, batch_bytes=4000).collect()  # several batches
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], round(r["log_score"], 6)) for r in got) == sorted(want)
    assert stupid_backoff(none).count() == 0


def test_packing(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from flowforge.llm.packing import best_fit_packing
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = best_fit_packing(docs, capacity=256).collect()
    want, total = Counter(), 0
    for i, t, *_ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        at = 0
        for k, n in enumerate([(len(ids) - 1) % 256 + 1] + [256] * ((len(ids) - 1) // 256)):
            want[(i, k, at, n, zlib.crc32(ids[at:at + n].tobytes()))] += 1
            at += n
    assert Counter(tuple(r)[:5] for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 256
    assert len(by) <= -(-total // 256) + 2
    assert best_fit_packing(none).count() == 0


def test_plan_equals_best_fit_decreasing():
    from flowforge.llm.packing import plan_best_fit
    r = np.random.default_rng(4)
    for _ in range(30):
        hist = {int(k): int(r.integers(1, 40)) for k in r.choice(np.arange(1, 101), 12, replace=False)}
        bins = []
        for n in sorted(hist, reverse=True):
            for _ in range(hist[n]):
                fit = [b for b in bins if b[0] >= n]
                best = min(fit, key=lambda b: b[0]) if fit else None
                if best is None:
                    bins.append(best := [100])
                best[0] -= n
        plan = plan_best_fit(hist, 100)
        used = defaultdict(int)
        for p in plan:
            for i in range(p.count):
                assert used[p.sequence + i // p.per] == p.offset + i % p.per * p.length
                used[p.sequence + i // p.per] += p.length
        assert sum(p.count for p in plan) == sum(hist.values()) and len(used) == len(bins)


def test_fast_encoder_equals_library():
    import random
    from flowforge.llm.packing import ByteBpeEncoder
    enc, lib = ByteBpeEncoder(), ByteBpeEncoder(ranks=None)
    r = random.Random(1)
    chars = [chr(c) for c in range(0x260)] + list("日🙂 ")
    for _ in range(3000):
        s = "".join(r.choice(chars) if r.random() < .5 else r.choice(" \n\tab's1!") for _ in range(r.randint(0, 40)))
        assert enc.ids(s).tolist() == lib.ids(s).tolist()
    assert enc.ids("a<|endoftext|>b").tolist() == lib.ids("a<|endoftext|>b").tolist()


def test_order_minhash(docs, none):
    from flowforge.llm.minhash_order import (fingerprint_neighbours, likeness, order_min_hash, with_edited)
    known = docs.filter("doc_id < 50 or doc_id = 60")
    rows = sorted((r["doc_id"], r["text"] or "") for r in known.collect())
    got = {r["doc_id"]: r for r in fingerprint_neighbours(known).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        e = with_edited(t, after)
        a, b, c = (order_min_hash(x) for x in (t, e, after))
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (got[i]["near_edited"], got[i]["near_next"]) == (likeness(a, b), likeness(a, c))
    assert fingerprint_neighbours(none).count() == 0
    assert fingerprint_neighbours(docs).count() == docs.count()
    text = " ".join(str(k * k) for k in range(3000))
    assert (order_min_hash(text) == order_min_hash(text, pass_kmers=1000)).all()  # bounded passes
    parts = text.split(" ")
    near, moved = " ".join(parts[:-30]), " ".join(parts[1500:] + parts[:1500])
    base = order_min_hash(text, picks=3)
    assert likeness(base, order_min_hash(near, picks=3)) > likeness(base, order_min_hash(moved, picks=3)) > 0


def brute_order_min_hash(text, k=8, picks=2, sketches=64):
    """The definition in plain integers: no blocks, no passes, every order sorted whole."""
    m, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    if not text:
        return [0] * sketches
    code = [ord(c) for c in text] + [0x110000] * (k - len(text))
    seen, grams = Counter(), []
    for at in range(len(code) - k + 1):
        g = tuple(code[at:at + k])
        h = 0
        for c in g:
            h = (h * base + c) & m
        h = mix(h)
        grams.append((mix((h + seen[g] * base) & m), at, h))
        seen[g] += 1
    out = []
    for i in range(1, sketches + 1):
        a = mix(i * base & m) | 1
        least = sorted((x * a & m, at, h) for x, at, h in grams)[:picks]
        entry = a
        for _, _, h in sorted(least, key=lambda p: p[1]):
            entry = mix((entry * base + h) & m)
        out.append(entry >> 32)
    return out


def test_order_minhash_by_its_definition(spark, docs, rows):
    import random

    from flowforge.llm.minhash_order import _chosen, _factors, _kmer_hashes, _numbered, fingerprint_neighbours, order_min_hash
    r = random.Random(3)
    for n in (0, 1, 7, 8, 9, 10, 30, 300, 2047, 2056, 5000):  # below and above one block
        text = "".join(r.choice("ab é日🙂") for _ in range(n))
        assert order_min_hash(text).tolist() == brute_order_min_hash(text)
        assert order_min_hash(text, pass_kmers=700).tolist() == brute_order_min_hash(text)
    assert order_min_hash("ab" * 3000, picks=3).tolist() == brute_order_min_hash("ab" * 3000, picks=3)
    # the functions choose apart from each other: 64 of 93 * 92 / 2 pairs
    code = np.array([ord(r.choice("abcdefgh ")) for _ in range(100)], np.uint32)
    _, at = _chosen(_numbered(_kmer_hashes(code, 8)), _factors(64), 2)
    assert len({tuple(sorted(p)) for p in at.tolist()}) >= 60
    # the whole query: rows of one id, null ids and clashing columns too
    key = [(i is not None, i or 0, t or "") for i, t, *_ in rows]
    own = {x[2]: "".join(f"{e:08x}" for e in brute_order_min_hash(x[2])) for x in key if len(x[2]) < 3000}
    out = fingerprint_neighbours(docs).collect()
    assert len(out) == len(rows)
    by_id = defaultdict(list)
    for i, t, *_ in rows:
        by_id[i].append(t or "")
    for x in out:
        known = [own[t] for t in by_id[x["doc_id"]] if t in own]
        assert x["fingerprint"] in known or len(known) < len(by_id[x["doc_id"]])
    alone = spark.createDataFrame([(1, "one text of its own")], "doc_id long, text string")
    x = fingerprint_neighbours(alone).first()
    assert x["near_next"] == 1.0 and x["n_chars"] == 19
    assert x["edited_fingerprint"] == "".join(f"{e:08x}" for e in brute_order_min_hash("one text o" + "one text "))


def test_bpe_stream(docs, rows, none):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from flowforge.llm.bpe_stream import (Decoder, StreamEncoder, decode_documents, encode_digests, encode_documents)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in encode_digests(docs).collect()) == want
    assert encode_digests(none).count() == 0
    enc = StreamEncoder()
    back = decode_documents(encode_documents(docs.select("doc_id", "text"))).collect()
    for r in back:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["input_ids"] == ids and r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    rnd = random.Random(7)
    for n in range(60):  # words far longer than the lookahead
        w = "".join(rnd.choice("aaabeenothrisngABé日🙂ßΣİ") for _ in range(rnd.randint(40, 300))) if n % 2 \
            else rnd.choice(["a", "ab", "the", "nann", "é"]) * rnd.randint(20, 100)
        assert list(enc.encode(w)) == tok.encode(w, add_special_tokens=False).ids
    for s in ("İstanbul ΑΣ ΟΔΟΣ", "a\x1cb\x85c d", "é x", "<|startoftext|>hi<|endoftext|>", "it's I'LL 12 3½"):
        assert list(enc.encode(s)) == tok.encode(s, add_special_tokens=False).ids
    d = Decoder.byte_level(enc)
    assert "".join(d.feed([i]) for i in enc.encode("straße 日本🙂")) + d.finish() == "straße 日本 🙂 "


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline as cp
    for start in (docs, none):
        df = start
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns, name
            df = spark.createDataFrame(out.collect(), out.schema)
        packed = cp.STAGES[-1][1](spark, df, "")
        assert Counter(r["doc_id"] for r in packed.filter("piece = 0").collect()) == \
            Counter(r["doc_id"] for r in df.collect())


def test_shared_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace

    from flowforge.llm.common import shared_folder
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="local-cluster[3,2,1024]")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf={}, sparkContext=sc))


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 11])
def test_sliding_min(width):
    from flowforge.llm.batches import sliding_min
    g = np.random.default_rng(0).integers(0, 99, 40).astype(np.uint64)
    assert sliding_min(g, width).tolist() == [g[k:k + width].min() for k in range(40 - width + 1)]


def test_every_code_point_is_split_as_the_library_splits_it():
    from tokenizers import Tokenizer

    from flowforge.llm.bpe_stream import POINTS, encoder
    from flowforge.llm.common import tokenizer_path
    enc = encoder("word_bpe_49k.json")
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    texts = [f"a{chr(c)}b 1{chr(c)}!" for c in POINTS if c < 0x20000]
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert list(enc.encode(t)) == want.ids, t
