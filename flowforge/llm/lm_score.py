"""Stupid-backoff scores of documents under the n-gram counts of the corpus.

Score of a word after its context, with counts c that leave out the document
itself (so every score is a held-out score):

    S(w | ctx) = c(ctx w) / c(ctx)        where c(ctx w) > 0
               = alpha * S(w | ctx without its first word)   otherwise
    S(w)       = max(c(w), 1) / (words of the other documents)

Method
------
The count tables are partitioned by the hash of the n-gram and joined to the
documents' n-grams, one level after the other:

1. Each batch of documents sends its distinct n-grams of a level, sorted by hash,
   with their counts in the batch (pre-aggregated), to the buckets, which are
   ranges of the hash.
2. A bucket adds up the counts of all batches, and sends each batch the totals of
   its n-grams in the same order.
3. An n-gram whose first or last n-1 words occur in no other document cannot occur
   there either, so only the others are sent at the next level.  (All
   documents that hold an n-gram agree on this, so its count stays whole.)
4. With the totals of all levels a batch scores its words, and the parts are
   summed per document.

A hot n-gram reaches its bucket once per batch.  All counts cover all documents.

Defined results: a null, empty or blank text has no words, a score of 0 and a null
mean; rows with equal ids are documents of their own; a null id is scored too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.batches import (blob_table, in_packed_batches, mix, opened_rows, pack, prefix_sums, span_hash,
                                   unpack)
from flowforge.llm.common import dealt, materialize
from flowforge.llm.substrings import Words

ORDER, ALPHA = 3, 0.4
BATCH = 8 << 20
BUCKET_GRAMS = 1 << 20
_NEXT = np.uint64(0xD1342543DE82EF95)


class Levels:
    """N-grams of the texts of a batch, level by level.

    ``totals``: corpus counts of the levels already answered, in the order of
    their sorted distinct hashes.  ``others[k]``: per word, how often its level-k
    n-gram occurs in other documents (0 where it has none, or can have none)."""

    def __init__(self, texts: list[bytes], totals: list[np.ndarray], upto: int):
        w = Words(texts)
        self.doc, n = w.doc, w.n
        self.place = np.arange(n) - np.searchsorted(w.doc, w.doc)  # word number in its text
        word = span_hash(prefix_sums(w.flat), w.off[:-1], w.off[1:])
        self.others: list[np.ndarray] = [np.zeros(n, np.int64)]
        self.grams = self.counts = None
        h = word
        for k in range(1, upto + 1):
            need = self.place >= k - 1
            if k > 1:
                h = np.concatenate(([np.uint64(0)], h[:-1])) * _NEXT + word
                h = mix(h)
                low = self.others[k - 1] > 0
                need &= low & np.concatenate(([False], low[:-1]))
            at = np.flatnonzero(need)
            if k > len(totals):  # not answered yet
                self.grams, self.counts = np.unique(h[at], return_counts=True)
                return
            # words stand by text, so a stable order has the n-grams of one text together
            at = at[np.argsort(h[at], kind="stable")]
            gram, doc = h[at], w.doc[at]
            new = np.r_[True, gram[1:] != gram[:-1]][:len(at)]
            first = np.flatnonzero(new | np.r_[True, doc[1:] != doc[:-1]][:len(at)])
            own = np.diff(first, append=len(at))
            c = np.zeros(n, np.int64)
            c[at] = np.repeat(totals[k - 1][np.cumsum(new)[first] - 1] - own, own)
            self.others.append(c)


def _collect(answers: pa.Table) -> list[np.ndarray]:
    """Totals by level: kept rows have bucket -1 - level, the others are the
    parts of the newest level in order of bucket."""
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()))
    kept = [unpack(b, np.int64)[0] for k, b in reversed(rows) if k < 0]
    new = [unpack(b, np.int64)[0] for k, b in rows if k >= 0]
    return kept + ([np.concatenate(new)] if new else [])


def _send(level: int, n_buckets: int):
    width = (1 << 64) // n_buckets + 1

    def rows(batch, texts, totals):
        out_b, out_c, out_g = [], [], []
        for k, t in enumerate(totals):  # pass the older totals on to the batch itself
            out_b.append(-1 - k)
            out_g.append(None)
            out_c.append(pack(t))
        if len(totals) == level - 1:  # a level without n-grams has none above it
            lv = Levels(texts, totals, level)
            cuts = np.searchsorted(lv.grams, np.array([b * width for b in range(1, n_buckets)], np.uint64))
            for b, (g, c) in enumerate(zip(np.split(lv.grams, cuts), np.split(lv.counts, cuts))):
                if len(g):
                    out_b.append(b)
                    out_g.append(pack(np.diff(g, prepend=np.uint64(0))))
                    out_c.append(pack(c.astype(np.int64)))
        n = len(out_b)
        return pa.table({"part": pa.array([b if b >= 0 else -1 - batch for b in out_b], pa.int64()),
                         "batch": pa.array([batch] * n, pa.int64()), "bucket": pa.array(out_b, pa.int64()),
                         "grams": pa.array(out_g, pa.binary()), "counts": pa.array(out_c, pa.binary())})

    def first(key, docs):
        return rows(key[0].as_py(), opened_rows(docs)[1], [])

    def later(key, docs, answers):
        return rows(key[0].as_py(), opened_rows(docs)[1], _collect(answers))

    return first if level == 1 else later


def _add_up(key, t):
    """Totals of a bucket's n-grams, for each batch in its own order."""
    if key[0].as_py() < 0:  # older totals on their way back to their batch
        return t.select(["batch", "bucket", "counts"])
    grams = [np.cumsum(unpack(b, np.uint64)[0]) for b in t.column("grams").to_pylist()]
    counts = [unpack(b, np.int64)[0] for b in t.column("counts").to_pylist()]
    names, inv = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(inv, weights=np.concatenate(counts), minlength=len(names)).astype(np.int64)
    parts = np.split(total[inv], np.cumsum([len(g) for g in grams])[:-1])
    return blob_table(batch=(t.column("batch").to_pylist(), pa.int64()),
                      bucket=(t.column("bucket").to_pylist(), pa.int64()),
                      counts=([pack(p) for p in parts], pa.binary()))


def _score(order: int, alpha: float):
    def run(key, docs, answers):
        ids, texts = opened_rows(docs)
        totals = _collect(answers)
        lv = Levels(texts, totals, len(totals))
        n = len(lv.doc)
        top = np.minimum(lv.place + 1, order)
        level = np.ones(n, np.int64)
        num = np.maximum(lv.others[1], 1) if len(totals) else np.ones(n, np.int64)
        den = np.ones(n, np.int64)  # of level 1: divided by the words of the others later
        for k in range(2, len(lv.others)):
            hit = lv.others[k] > 0
            level[hit], num[hit] = k, lv.others[k][hit]
            den[hit] = np.concatenate(([0], lv.others[k - 1][:-1]))[hit]
        part = np.log(num) - np.log(den) + (top - level) * math.log(alpha)
        m = len(texts)
        at = lv.doc
        return blob_table(
            id=(ids, pa.int64()), n_tokens=(np.bincount(at, minlength=m), pa.int64()),
            part=(np.bincount(at, weights=part, minlength=m), pa.float64()),
            n_single=(np.bincount(at[level == 1], minlength=m), pa.int64()),
            n_top=(np.bincount(at[level == order], minlength=m), pa.int64()))
    return run


def stupid_backoff(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER,
                   alpha: float = ALPHA, batch_bytes: int = BATCH) -> DataFrame:
    """Per input row: doc_id, n_tokens, log_score (natural log of the product),
    mean_log_score, n_top (words scored with the full context), n_single."""
    batched, total = in_packed_batches(docs, doc_id, text, batch_bytes)
    n_buckets = max(1, math.ceil(total / 7 / BUCKET_GRAMS))
    by_batch = batched.groupBy("batch")
    sent_schema = "part long, batch long, bucket long, grams binary, counts binary"
    answers = None
    for level in range(1, order + 1):
        send = _send(level, n_buckets)
        sent = by_batch.applyInArrow(send, sent_schema) if answers is None else \
            by_batch.cogroup(answers.groupBy("batch")).applyInArrow(send, sent_schema)
        answers = dealt(sent, "part", total).groupBy("part").applyInArrow(_add_up, "batch long, bucket long, counts binary")
    rows = materialize(by_batch.cogroup(answers.groupBy("batch")).applyInArrow(
        _score(order, alpha), "id long, n_tokens long, part double, n_single long, n_top long"))
    words = rows.agg(F.sum("n_tokens")).first()[0] or 0
    rest = F.greatest(F.lit(words).cast("long") - F.col("n_tokens"), F.lit(1).cast("long"))
    log_score = F.col("part") - F.col("n_single") * F.log(rest.cast("double"))
    return rows.select(F.col("id").alias(doc_id), "n_tokens", log_score.alias("log_score"),
                       F.try_divide(log_score, F.col("n_tokens")).alias("mean_log_score"), "n_top", "n_single")
