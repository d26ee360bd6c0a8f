"""Exact removal of repeated byte strings with suffix arrays.

Every byte covered by a ``length``-byte string that also starts elsewhere (in
any document, also the same one) is removed.

Method
------
1. Each batch of documents cuts its texts into segments: runs of consecutive
   ``length``-byte strings with the same minimiser (smallest hash of their
   ``gram``-byte grams, the first of equal ones) at the same place.  Every string
   of the corpus lies in one segment, and equal strings have equal minimisers.  First only the minimisers travel: those
   seen once in the corpus need no further work.
2. Segments of minimisers seen twice or more travel, distinct within a batch and
   with their count, to the bucket of their minimiser.  A bucket puts its distinct
   segments one after the other, minimisers together, and cuts them into shards of
   bounded size.  Each shard gets a suffix array by Larsson-Sadakane refinement (sort by
   the first eight bytes, then double the sorted depth, touching only groups not
   yet single) and common prefixes by Kasai's rule in text order: a position whose
   predecessor in the array moves along with it has the common prefix of the
   position before, less one, so only the others are compared.  A string is
   repeated when a neighbour in the array shares ``length`` bytes, or when its
   segment stands in the corpus twice.
3. Shards that share a minimiser (one whose segments fill more than a shard) are
   merged by binary search: the strings of each are looked up in the suffix arrays of
   the others.
4. The batches get the repeated ranges back and remove them.

The first round also counts the segments of each minimiser.  A hot minimiser, one
whose segments could fill more than ``hot_bytes``, has its segments cut into single
strings, distinct within a batch, and each goes to the bucket of its own hash: equal
strings still meet and no task gets the whole group.

The inside of a passage that a third of all documents hold is one segment per batch
and one segment of a shard; where the passage meets the documents' own texts the
segments differ, which is what makes its minimisers there hot.

Defined results: a null or empty text has no bytes; documents with equal ids are
documents of their own (their texts repeat); a null id is like any other; an empty
table gives an empty result.  The remaining bytes need not be valid UTF-8, so they
are returned as binary.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowforge.llm.batches import (blob_table, by_bucket, in_batches, mix, pack, prefix_sums,
                                   sliding_min, sorted_rows, span_hash, unpack)
from flowforge.llm.common import dealt

GRAM = 32
PIECE_BYTES = 1 << 20
SHARD_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
HOT_BYTES = 8 << 20


# ------------------------------------------------------------ suffix arrays

def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``t`` sorted by their first ``depth`` bytes or more
    (Larsson-Sadakane: only groups that still tie are refined)."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k:k + n]
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    sorted_key = key[sa]
    head = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
    rank[sa] = np.repeat(head, np.diff(np.append(head, n)))
    size = np.diff(np.append(head, n))
    tied = np.flatnonzero(np.repeat(size > 1, size))
    h = 8
    while h < depth and len(tied):
        at = sa[tied]
        key = (rank[at] << 32) | (rank[np.minimum(at + h, n)] + 1)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[tied] = at
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(key)))
        rank[at] = np.repeat(tied[first], size)
        tied = tied[np.repeat(size > 1, size)]
        h *= 2
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Per text position, the common prefix with the position before it in the
    array (Kasai's order of work, by whole runs)."""
    n = len(t)
    before = np.full(n, n, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([t, np.zeros(16, np.uint8)])
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] < n - 1) \
        & (t[:-1] == padded[np.minimum(before[:-1], n)])
    first = np.flatnonzero(~follows)
    lcp = np.zeros(len(first), np.int64)
    live = np.flatnonzero(before[first] < n)
    i, j = first[live], before[first[live]]
    stop = n - np.maximum(i, j)
    while len(live):
        same = np.ones(len(live), bool)
        done = np.zeros(len(live), bool)
        for _ in range(8):
            same &= (lcp[live] < stop) & (padded[np.minimum(i + lcp[live], n)] == padded[np.minimum(j + lcp[live], n)])
            lcp[live[same]] += 1
            done |= ~same
        keep = ~done
        live, i, j, stop = live[keep], i[keep], j[keep], stop[keep]
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    return np.maximum(lcp[run] - (np.arange(n) - first[run]), 0)


def repeated_in_shard(t: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, mask of the positions whose ``length`` bytes start twice).
    ``valid``: positions whose bytes lie inside one segment."""
    sa = suffix_array(t, length)
    long = common_prefixes(t, sa) >= length
    hit = long.copy()
    inv_next = np.zeros(len(t), bool)
    inv_next[sa[:-1]] = long[sa[1:]]
    return sa, (hit | inv_next) & valid


def compare_at(t: np.ndarray, a: np.ndarray, u: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Sign of t[a:a+length] against u[b:b+length], pair by pair."""
    out = np.zeros(len(a), np.int8)
    live = np.arange(len(a))
    for k in range(length):
        if not len(live):
            break
        x, y = t[np.minimum(a[live] + k, len(t) - 1)].astype(np.int16), u[np.minimum(b[live] + k, len(u) - 1)]
        x = np.where(a[live] + k < len(t), x, 0)
        y = np.where(b[live] + k < len(u), y, 0)
        diff = np.sign(x - y)
        out[live] = diff
        live = live[diff == 0]
    return out


def search_shard(t: np.ndarray, sa: np.ndarray, u: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Mask of the strings ``u[at:at+length]`` that start somewhere in ``t``."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            break
        mid = (lo[open_] + hi[open_]) // 2
        less = compare_at(t, sa[mid], u, at[open_], length) < 0
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    found = lo < len(sa)
    found[found] = compare_at(t, sa[lo[found]], u, at[found], length) == 0
    return found


def repeated_in_bucket(segments: list[bytes], mini: np.ndarray, count: np.ndarray, length: int,
                       shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """Per segment, a mask of its ``length``-byte strings that start twice among
    all.  Segments are distinct; ``count`` says how often each stands in the
    corpus."""
    out = [np.full(len(s) - length + 1, c > 1) for s, c in zip(segments, count.tolist())]
    order = np.argsort(mini, kind="stable")
    m = mini[order]
    shared = np.concatenate(([False], m[1:] == m[:-1])) | np.concatenate((m[1:] == m[:-1], [False]))
    order = order[shared]  # a minimiser with one distinct segment: the count says all
    shards, size = [[]], 0
    for k in order.tolist():
        if size + len(segments[k]) > shard_bytes and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(k)
        size += len(segments[k]) + 1
    built = []
    for own in shards:
        if not own:
            continue
        raw = b"\x00".join(segments[k] for k in own) + b"\x00"
        # bytes move up by one, so that the separator is below them all and no byte of a text
        t = np.frombuffer(raw, np.uint8).astype(np.uint8) + np.uint8(1)
        begins = np.cumsum([0] + [len(segments[k]) + 1 for k in own])[:-1]
        lens = np.array([len(segments[k]) for k in own])
        t[begins + lens] = 0
        valid = np.zeros(len(t), bool)
        for b, n in zip(begins.tolist(), lens.tolist()):
            valid[b:b + n - length + 1] = True
        sa, hit = repeated_in_shard(t, valid, length)
        built.append((own, t, sa, hit, valid, begins))
    for x in range(len(built)):  # merge: only shards that share a minimiser
        for y in range(x + 1, len(built)):
            if mini[built[x][0][-1]] != mini[built[y][0][0]]:
                break
            last, first = built[x], built[y]
            name = mini[last[0][-1]]
            for here, there in ((last, first), (first, last)):
                ask = np.concatenate([
                    np.arange(b, b + len(segments[k]) - length + 1)
                    for k, b in zip(here[0], here[5].tolist()) if mini[k] == name])
                ask = ask[~here[3][ask]]
                found = search_shard(there[1], there[2], here[1], ask, length)
                here[3][ask[found]] = True
    for own, t, sa, hit, valid, begins in built:
        for k, b in zip(own, begins.tolist()):
            out[k] = out[k] | hit[b:b + len(out[k])]
    return out


# ------------------------------------------------------------------ batches

class Segments:
    """Distinct segments of a batch and where each occurs.  Those of the hot
    minimisers are cut into single strings, named by their own hash (``single``)."""

    def __init__(self, texts: list[bytes], length: int, gram: int, hot: np.ndarray | None = None):
        strings, self_first, minis, singles = [], [], [], []
        self.base = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        whole = b"".join(texts)
        a = np.frombuffer(whole, np.uint8)
        doc_end = self.base[1:]
        for lo in range(0, max(len(a) - length + 1, 0), PIECE_BYTES):
            hi = min(lo + PIECE_BYTES, len(a) - length + 1)  # strings that start in [lo, hi)
            part = a[lo:hi + length - 1]
            sums = prefix_sums(part)
            at = np.arange(len(part) - gram + 1)
            g = span_hash(sums, at, at + gram)
            low = sliding_min(g, length - gram + 1)
            start = np.arange(lo, hi)
            doc = np.searchsorted(doc_end, start, side="right")
            ok = start + length <= doc_end[np.minimum(doc, len(doc_end) - 1)]
            new = np.ones(len(start), bool)
            # also where the next string no longer holds this place of the minimiser
            new[1:] = (low[1:] != low[:-1]) | (g[:len(low) - 1] == low[:-1]) | ~ok[:-1] | (doc[1:] != doc[:-1])
            alone = np.isin(low, hot) & ok if hot is not None and len(hot) else np.zeros(len(start), bool)
            new |= alone
            first = np.flatnonzero(new & ok)
            stop = np.flatnonzero(np.append(new | ~ok, True))
            last = stop[np.searchsorted(stop, first, side="right")]
            strings += [whole[x:y] for x, y in zip((first + lo).tolist(), (last + lo + length - 1).tolist())]
            self_first.append(first + lo)
            names = low[first]
            own = alone[first]
            names[own] = span_hash(sums, first[own], first[own] + length)
            minis.append(names)
            singles.append(own)
        self.first = np.concatenate(self_first) if self_first else np.empty(0, np.int64)
        coded = pa.array(strings, pa.large_binary()).dictionary_encode()
        self.entry = coded.indices.to_numpy().astype(np.int64)
        self.texts = coded.dictionary
        self.mini = np.zeros(len(self.texts), np.uint64)
        self.single = np.zeros(len(self.texts), bool)
        if len(self.entry):
            self.mini[self.entry] = np.concatenate(minis)
            self.single[self.entry] = np.concatenate(singles)
        self.count = np.bincount(self.entry, minlength=len(self.texts))


def _bucket_of(mini: np.ndarray, n: int) -> np.ndarray:
    return (mix(mini) % np.uint64(n)).astype(np.int64)


def _send_minimisers(length: int, gram: int, n_buckets: int):
    def run(key, t):
        s = Segments(sorted_rows(t)[1], length, gram)
        mini, inv = np.unique(s.mini, return_inverse=True)
        many = np.minimum(np.bincount(inv, weights=s.count, minlength=len(mini)), 2).astype(np.uint8)
        out_b, out = [], []
        segments = np.bincount(inv, minlength=len(mini)).astype(np.int32)
        for b, rows in by_bucket(_bucket_of(mini, n_buckets)):
            out_b.append(b)
            step = np.diff(mini[rows], prepend=np.uint64(0))
            out.append(pack(step, many[rows], segments[rows]))
        return blob_table(bucket=(out_b, pa.int64()), batch=([key[0].as_py()] * len(out), pa.int64()),
                          minimisers=(out, pa.binary()))
    return run


def _repeated_minimisers(most: float):
    """Per batch its minimisers seen twice, and which of them have over ``most`` segments."""
    def run(key, t):
        parts = [unpack(b, np.uint64, np.uint8, np.int32) for b in t.column("minimisers").to_pylist()]
        mini = [np.cumsum(p[0]) for p in parts]
        names, inv = np.unique(np.concatenate(mini), return_inverse=True)
        total, segments = (np.bincount(inv, weights=np.concatenate([p[k] for p in parts]), minlength=len(names))
                           for k in (1, 2))
        out_b, out = [], []
        for batch, m in zip(t.column("batch").to_pylist(), mini):
            at = np.searchsorted(names, m)
            twice = total[at] > 1
            if twice.any():
                out_b.append(batch)
                out.append(pack(m[twice], (segments[at[twice]] > most).astype(np.uint8)))
        return blob_table(batch=(out_b, pa.int64()), answer=(out, pa.binary()))
    return run


def _send_segments(length: int, gram: int, n_buckets: int):
    def run(key, docs, answers):
        known = [unpack(b, np.uint64, np.uint8) for b in answers.column("answer").to_pylist()]
        if not known or not docs.num_rows:
            return blob_table(bucket=([], pa.int64()), batch=([], pa.int64()), segments=([], pa.binary()))
        twice, many = (np.concatenate([p[k] for p in known]) for k in range(2))
        hot = twice[many > 0]
        s = Segments(sorted_rows(docs)[1], length, gram, hot)
        use = np.flatnonzero(s.single | np.isin(s.mini, twice))
        batch = docs.column("batch")[0].as_py()
        out_b, out = [], []
        if len(hot):  # for the last round of this batch, which cuts the same segments
            out_b.append(-1 - batch)
            out.append(pack(hot))
        for b, at in by_bucket(_bucket_of(s.mini[use], n_buckets)):
            rows = use[at]
            texts = s.texts.take(pa.array(rows)).to_pylist()
            out_b.append(b)
            out.append(pack(rows.astype(np.int32), np.minimum(s.count[rows], 2).astype(np.uint8), s.mini[rows],
                            np.fromiter(map(len, texts), np.int32, len(texts)), b"".join(texts)))
        return blob_table(bucket=(out_b, pa.int64()), batch=([batch] * len(out), pa.int64()),
                          segments=(out, pa.binary()))
    return run


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False]))))
    return edge[::2], edge[1::2]


def _find_repeats(length: int, shard_bytes: int):
    def run(key, t):
        batches = t.column("batch").to_pylist()
        none = np.empty(0, np.int32)
        if key[0].as_py() < 0:
            hot = [pack(none, none, none, *unpack(b, np.uint64)) for b in t.column("segments").to_pylist()]
            return blob_table(batch=(batches, pa.int64()), answer=(hot, pa.binary()))
        parts = [unpack(b, np.int32, np.uint8, np.uint64, np.int32, None)
                 for b in t.column("segments").to_pylist()]
        strings = []
        for p in parts:
            ends = np.cumsum(p[3]).tolist()
            strings += [p[4][a:e] for a, e in zip([0] + ends[:-1], ends)]
        coded = pa.array(strings, pa.large_binary()).dictionary_encode()
        of = coded.indices.to_numpy().astype(np.int64)
        segments = coded.dictionary.to_pylist()
        del strings
        count = np.bincount(of, weights=np.concatenate([p[1] for p in parts]), minlength=len(segments))
        mini = np.zeros(len(segments), np.uint64)
        mini[of] = np.concatenate([p[2] for p in parts])
        found = [_ranges(m) for m in repeated_in_bucket(segments, mini, count, length, shard_bytes)]
        out_b, out, at = [], [], 0
        for batch, p in zip(batches, parts):
            own = of[at:at + len(p[0])]
            at += len(p[0])
            n = np.array([len(found[k][0]) for k in own.tolist()])
            if not n.sum():
                continue
            out_b.append(batch)
            out.append(pack(np.repeat(p[0], n),
                            np.concatenate([found[k][0] for k in own.tolist()]).astype(np.int32),
                            np.concatenate([found[k][1] for k in own.tolist()]).astype(np.int32),
                            np.empty(0, np.uint64)))
        return blob_table(batch=(out_b, pa.int64()), answer=(out, pa.binary()))
    return run


def _remove(length: int, gram: int):
    def run(key, docs, answers):
        ids, texts, _ = sorted_rows(docs)
        parts = [unpack(b, np.int32, np.int32, np.int32, np.uint64) for b in answers.column("answer").to_pylist()]
        s = Segments(texts, length, gram, np.concatenate([p[3] for p in parts]) if parts else None)
        n = int(s.base[-1])
        cover = np.zeros(n + 1, np.int32)
        if parts and texts:
            entry, lo, hi = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(s.entry, kind="stable")
            at = np.searchsorted(s.entry[order], entry)
            many = np.searchsorted(s.entry[order], entry, side="right") - at
            r = np.repeat(np.arange(len(entry)), many)
            occ = order[at[r] + np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)]
            np.add.at(cover, s.first[occ] + lo[r], 1)
            np.add.at(cover, s.first[occ] + hi[r] + length - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        whole = np.frombuffer(b"".join(texts), np.uint8)
        removed, spans, kept = [], [], []
        for i, t in enumerate(texts):
            cut = gone[s.base[i]:s.base[i + 1]]
            removed.append(int(cut.sum()))
            spans.append(len(_ranges(cut)[0]) if removed[-1] else 0)
            kept.append(whole[s.base[i]:s.base[i + 1]][~cut].tobytes() if removed[-1] else t)
        return blob_table(id=(ids, pa.int64()), n_bytes=([len(t) for t in texts], pa.int64()),
                          n_removed=(removed, pa.int64()), n_spans=(spans, pa.int64()),
                          kept=(kept, pa.binary()))
    return run


def remove_repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200,
                          gram: int = GRAM, shard_bytes: int = SHARD_BYTES,
                          hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per input row: (doc_id, n_bytes, n_removed, n_spans, kept binary)."""
    batched, total = in_batches(docs, doc_id, text)
    n_buckets = max(1, math.ceil(total / BUCKET_BYTES))
    few = max(1, n_buckets // 4)
    by_batch = batched.groupBy("batch")
    seen = by_batch.applyInArrow(_send_minimisers(length, gram, few), "bucket long, batch long, minimisers binary")
    hot = seen.groupBy("bucket").applyInArrow(
        _repeated_minimisers(hot_bytes / (2 * length - gram)), "batch long, answer binary")
    sent = by_batch.cogroup(hot.groupBy("batch")).applyInArrow(
        _send_segments(length, gram, n_buckets), "bucket long, batch long, segments binary")
    ranges = dealt(sent, "bucket", total).groupBy("bucket").applyInArrow(_find_repeats(length, shard_bytes), "batch long, answer binary")
    return (by_batch.cogroup(ranges.groupBy("batch"))
            .applyInArrow(_remove(length, gram),
                          "id long, n_bytes long, n_removed long, n_spans long, kept binary")
            .withColumnRenamed("id", doc_id))
