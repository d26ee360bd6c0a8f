"""N-gram levels of the language model score, and the remembered words of the encoder."""

from __future__ import annotations

from collections import Counter

import numpy as np


def test_an_answered_level_is_sorted_once(monkeypatch):
    from flowforge.llm import lm_score
    texts = [b"a b a b a b c", b"", b"a b c", b"c c c c", b" ", b"a b a b a b c", b"x y"]
    words = [t.split() for t in texts]
    totals = []
    for level in (1, 2, 3):
        asked = lm_score.Levels(texts, totals, level)
        totals.append(asked.counts)
    searched = []
    real = np.unique
    monkeypatch.setattr(lm_score.np, "unique", lambda *a, **k: (searched.append(k), real(*a, **k))[1])
    got = lm_score.Levels(texts, totals, 3)
    assert not searched  # the order of the n-grams also tells how often one text holds them
    every = [Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1)) for k in range(1, 4)]
    at = 0
    for w in words:
        own = [Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) for k in range(1, 4)]
        for i in range(len(w)):
            for k in range(1, min(i + 1, 3) + 1):
                gram = tuple(w[i - k + 1:i + 1])
                assert got.others[k][at] == every[k - 1][gram] - own[k - 1][gram]
            at += 1
    assert at == len(got.doc)


def test_pairs_of_tokens_are_judged_without_merging_and_words_are_remembered_whole(monkeypatch):
    import hashlib
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from flowforge.llm.bpe_stream import StreamEncoder
    enc = StreamEncoder()
    model, r = enc.model, random.Random(1)
    tokens = r.sample(sorted(model.by_text.values()), 300) + [model.first[97], model.final[97], model.first[32]]
    want = {}
    for _ in range(3000):
        a, b = r.choice(tokens), r.choice(tokens)
        want[(a, b)] = model.merge(model.symbols_of(a) + model.symbols_of(b)) == [a, b]
    assert 0 < sum(want.values()) < len(want)
    for t in tokens:
        model.alone(t)
    merged = []
    real = model.merge
    monkeypatch.setattr(model, "merge", lambda ids: (merged.append(ids), real(ids))[1])
    assert {p: model.stands(*p) for p in want} == want
    assert not merged
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("", " \n", "it's", "Straße ÉCOLE é <|endoftext|><|startoftext|> \x1c 3½ ok", "é" * 40 + " 日本🙂", "a" * 33):
        for _ in range(2):  # new words, then remembered ones
            ids = tok.encode(text, add_special_tokens=False).ids
            assert enc.digest(text) == (
                len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    n, numerals, raw = enc.known["ok"]
    assert n == len(numerals.split()) and raw


def test_components_of_few_links_run_in_few_tasks(spark):
    from flowforge.llm.simhash import LEAST_TASKS, connected_components
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 7), (7, 9), (5, 3)], "src long, dst long")
        got = connected_components(links)
        assert sorted(map(tuple, got.collect())) == [(2, 1), (3, 1), (5, 1), (9, 7)]
        assert got.rdd.getNumPartitions() <= LEAST_TASKS
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
