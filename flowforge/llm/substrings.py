"""Word-window dedup over super-k-mers.

A window is ``window`` consecutive words of one document; a word goes when a
window over it also starts in a document with a smaller id.

Method
------
1. Each batch of documents finds the minimiser of every window (the smallest
   hash of its ``gram``-word grams).  Consecutive windows that share it travel
   as one packed string, once per batch however often it occurs, to the bucket
   that the minimiser names.  Equal windows have equal minimisers, so all
   occurrences of a window meet in one bucket, and a window of the corpus is
   sent in one packed string only.
2. A bucket numbers its words exactly, sorts all windows by a hash of their word
   numbers and compares neighbours word by word; a group whose hash collides is
   sorted again by the words themselves.  So windows are counted exactly.  It
   answers each batch with the smallest id of the windows that others start.
3. Each batch rebuilds its strings, applies the answers and removes the words.

Where a common passage meets the documents' own words the strings differ but share
minimisers, so one scan first finds the hot minimisers: pieces of the input report
those with more windows than their share of ``hot_windows / 2``, and one is hot when
the reports exceed ``hot_windows / 2``.  So any other has at most ``hot_windows``
windows.  Their list is broadcast: a window takes two bytes of text at least, so with
``hot_windows`` raised to 1/``HOT_LIST`` of the bytes (from half a terabyte on) the
list has at most ``HOT_LIST`` entries of eight bytes.  Windows of hot minimisers travel one by one to the bucket of their own
hash: equal windows still meet, and no bucket gets the whole group.

A passage that a third of all documents hold reaches its bucket once per batch,
not once per document, and the answer also is once per batch.

Defined results: null, empty or blank text has no words and nothing to remove; a
row without an id is kept whole and removes nothing; rows with equal ids do not
remove each other's words; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowforge.llm.batches import (BATCH_BYTES, blob_table, by_bucket, in_batches, mix, pack, prefix_sums,
                                   sliding_min, sorted_rows, span_hash, unpack)
from flowforge.llm.common import dealt

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
PIECE_BYTES = 1 << 19
BUCKET_BYTES = 6 << 20
HOT_WINDOWS = 1 << 17
HOT_LIST = 1 << 22
NO_HOT = np.empty(0, np.uint64)


class Words:
    """Words of some texts: ``flat`` holds each followed by one space, word i
    from ``off[i]`` to ``off[i + 1]``; ``doc`` has the text of each word."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join(texts) + b"\n"
        a = np.frombuffer(raw, np.uint8)
        space = _SPACE[a]
        after = np.empty(len(a), bool)  # the byte that ends a word
        after[0] = False
        after[1:] = space[1:] & ~space[:-1]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        ends = np.flatnonzero(after)
        flat = a[~space | after].copy()
        flat[_SPACE[flat]] = 0x20
        self.flat = flat
        self.off = np.concatenate(([0], np.flatnonzero(flat == 0x20) + 1))
        self.doc = np.searchsorted(begins, ends, side="right") - 1
        self.n = len(ends)


def super_kmers(w: Words, window: int, gram: int, hot: np.ndarray = NO_HOT):
    """(first word, last word + 1, minimiser) of every run of windows; a window of
    a hot minimiser is a run of its own, named by its own hash."""
    n = w.n - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = prefix_sums(w.flat)
    g = span_hash(sums, w.off[:w.n - gram + 1], w.off[gram:])
    low = sliding_min(g, window - gram + 1)
    ok = w.doc[:n] == w.doc[window - 1:]
    new = np.ones(n, bool)
    # also where the next window no longer holds this place of the minimiser, so
    # that runs are short in repetitive text too
    new[1:] = (low[1:] != low[:-1]) | (g[:n - 1] == low[:-1]) | ~ok[:-1] | (w.doc[1:n] != w.doc[:n - 1])
    alone = np.zeros(n, bool)
    if len(hot):  # sorted
        alone = (hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low) & ok
    new |= alone
    first = np.flatnonzero(new & ok)
    stop = np.flatnonzero(np.append(new | ~ok, True))
    last = stop[np.searchsorted(stop, first, side="right")]
    names, own = low[first], alone[first]
    names[own] = span_hash(sums, w.off[first[own]], w.off[first[own] + window])
    return first, last - 1 + window, names


class Strings:
    """Distinct packed strings of a batch and where each occurs."""

    def __init__(self, texts: list[bytes], window: int, gram: int, hot: np.ndarray = NO_HOT):
        groups, size, group = [], 0, []
        for i, t in enumerate(texts):  # texts in turn, about a piece at a time
            group.append(i)
            size += len(t)
            if size >= PIECE_BYTES:
                groups.append(group)
                group, size = [], 0
        if group:
            groups.append(group)
        strings, first, mini, counts = [], [], [], np.zeros(len(texts), np.int64)
        windows = []
        doc, at = [], 0
        for group in groups:
            w = Words([texts[i] for i in group])
            a, b, m = super_kmers(w, window, gram, hot)
            flat = w.flat.tobytes()
            strings += [flat[x:y] for x, y in zip(w.off[a].tolist(), w.off[b].tolist())]
            counts[group] = np.bincount(w.doc, minlength=len(group))
            first.append(a + at)
            doc.append(np.array(group)[w.doc[a]] if len(a) else np.empty(0, np.int64))
            mini.append(m)
            windows.append(b - a - window + 1)
            at += w.n
        self.words = counts  # words of each text
        self.first = np.concatenate(first) if first else np.empty(0, np.int64)
        self.doc = np.concatenate(doc) if doc else np.empty(0, np.int64)
        coded = pa.array(strings, pa.large_binary()).dictionary_encode()
        self.entry = coded.indices.to_numpy().astype(np.int64)
        self.texts = coded.dictionary
        self.mini = np.zeros(len(self.texts), np.uint64)
        self.windows = np.zeros(len(self.texts), np.int64)  # of each distinct string
        if len(self.entry):
            self.mini[self.entry] = np.concatenate(mini)
            self.windows[self.entry] = np.concatenate(windows)


def _reports(window: int, gram: int, per_byte: float):
    """Minimisers of a piece of the input with over ``per_byte`` windows a byte of the piece."""
    def report(texts):
        s = Strings(texts, window, gram)
        mini, inv = np.unique(s.mini, return_inverse=True)
        n = np.bincount(inv, weights=s.windows, minlength=len(mini))
        many = n > per_byte * sum(map(len, texts))
        return pa.RecordBatch.from_arrays([pa.array(mini[many].view(np.int64)), pa.array(n[many].astype(np.int64))],
                                          names=["mini", "n"])

    def run(batches):
        own, size = [], 0
        for b in batches:
            for x in b.column("text"):
                own.append((x.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(own[-1])
                if size >= BATCH_BYTES:
                    yield report(own)
                    own, size = [], 0
        if own:
            yield report(own)
    return run


def hot_minimisers(docs: DataFrame, doc_id: str, text: str, window: int, gram: int, total: int,
                   hot_windows: int) -> np.ndarray:
    """At most ``2 * windows / hot_windows`` minimisers, sorted, among them every one with
    more than ``hot_windows`` windows."""
    if not total:
        return NO_HOT
    half = hot_windows / 2
    found = (docs.filter(F.col(doc_id).isNotNull()).select(F.col(text).alias("text"))
             .mapInArrow(_reports(window, gram, half / total), "mini long, n long")
             .groupBy("mini").agg(F.sum("n").alias("n")).filter(F.col("n") > half).select("mini").toArrow())
    return np.sort(found.column("mini").to_numpy().astype(np.int64).view(np.uint64))


def _send(window: int, gram: int, n_buckets: int, hot=NO_HOT):
    """``hot``: sorted minimisers, or a broadcast of them."""
    def run(key, t):
        ids, texts, _ = sorted_rows(t)
        known = [i for i, x in enumerate(ids) if x is not None]
        ids = np.array([ids[i] for i in known], np.int64)
        s = Strings([texts[i] for i in known], window, gram, getattr(hot, "value", hot))
        low = np.zeros(len(s.texts), np.int64)
        high = np.zeros(len(s.texts), np.int64)
        if len(s.entry):
            low[s.entry[::-1]] = ids[s.doc[::-1]]  # rows stand in id order: the first wins
            high[s.entry] = ids[s.doc]
        bucket = (mix(s.mini) % np.uint64(n_buckets)).astype(np.int64)
        out_b, out = [], []
        for b, rows in by_bucket(bucket):
            text = b"\n".join(s.texts.take(pa.array(rows)).to_pylist())
            out_b.append(b)
            out.append(pack(rows.astype(np.int32), low[rows], high[rows], text))
        pa.default_memory_pool().release_unused()
        return blob_table(bucket=(out_b, pa.int64()), batch=([key[0].as_py()] * len(out), pa.int64()),
                          strings=(out, pa.binary()))
    return run


def same_windows(word: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts windows so that equal ones are neighbours: (order, first of group).

    ``word``: exact word numbers; ``start``: first word of each window."""
    sums = prefix_sums_of(word)
    h = span_hash(sums, start, start + window)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    same_hash = hs[1:] == hs[:-1]
    near = np.flatnonzero(same_hash)
    equal = np.zeros(len(order), bool)  # to the one before
    same = np.ones(len(near), bool)
    for k in range(window):
        same &= word[start[order[near + 1]] + k] == word[start[order[near]] + k]
    equal[near + 1] = same
    if not same.all():  # different windows with one hash: sort those groups by their words
        group = np.cumsum(np.concatenate(([True], ~same_hash))) - 1
        bad = np.isin(group, group[near[~same] + 1])
        rows = np.flatnonzero(bad)
        part = order[rows]
        cols = [word[start[part] + k] for k in range(window - 1, -1, -1)]
        again = np.lexsort(cols + [group[rows]])
        order[rows] = part[again]
        g = group[rows]
        eq = np.concatenate(([False], g[1:] == g[:-1]))
        for k in range(window):
            c = word[start[order[rows]] + k]
            eq[1:] &= c[1:] == c[:-1]
        equal[rows] = eq
    return order, ~equal


def prefix_sums_of(word: np.ndarray) -> np.ndarray:
    from flowforge.llm.batches import _powers
    out = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(mix(word.astype(np.uint64) + np.uint64(1)) * _powers(len(word) + 1)[0][:len(word)], out=out[1:])
    return out


def _answer(window: int):
    def run(key, t):
        batches = t.column("batch").to_pylist()
        parts = [unpack(b, np.int32, np.int64, np.int64, None) for b in t.column("strings").to_pylist()]
        text = b"\n".join(p[3] for p in parts) + b"\n"
        sizes = np.array([len(p[0]) for p in parts])
        entry = np.concatenate([p[0] for p in parts])
        low = np.concatenate([p[1] for p in parts])
        high = np.concatenate([p[2] for p in parts])
        sender = np.repeat(np.arange(len(parts)), sizes)
        # every word ends with a space, every string besides with a line feed
        a = np.frombuffer(text, np.uint8)
        flat = a[a != 0x0A]
        line_ends = np.flatnonzero(a == 0x0A) - np.arange(int((a == 0x0A).sum()))
        off = np.concatenate(([0], np.flatnonzero(flat == 0x20) + 1))
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(flat)])
        word = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        ends = np.searchsorted(off, line_ends)  # words up to the end of each string
        begins = np.concatenate(([0], ends[:-1]))
        n = ends - begins - window + 1
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        order, first = same_windows(word, begins[owner] + at, window)
        group = np.cumsum(first) - 1
        least = np.minimum.reduceat(low[owner[order]], np.flatnonzero(first)) if len(order) else low
        m = np.empty(len(order), np.int64)
        m[order] = least[group]
        use = np.flatnonzero(m < high[owner])
        del words, flat, a, off, word, order, first, group
        out_b, out = [], []
        for k, rows in by_bucket(sender[owner[use]]):
            r = use[rows]
            out_b.append(batches[k])
            out.append(pack(entry[owner[r]], at[r].astype(np.int32), m[r]))
        pa.default_memory_pool().release_unused()
        return blob_table(batch=(out_b, pa.int64()), answer=(out, pa.binary()))
    return run


def _remove(window: int, gram: int, hot=NO_HOT):
    def run(key, docs, answers):
        ids, texts, order = sorted_rows(docs)
        n_known = sum(x is not None for x in ids)  # rows without an id stand last
        s = Strings(texts[:n_known], window, gram, getattr(hot, "value", hot))
        base = np.concatenate(([0], np.cumsum(s.words)))
        parts = [unpack(b, np.int32, np.int32, np.int64) for b in answers.column("answer").to_pylist()]
        cover = np.zeros(base[-1] + 1, np.int32)
        if parts:
            entry, at, least = (np.concatenate([p[k] for p in parts]) for k in range(3))
            by = np.argsort(s.entry, kind="stable")
            lo = np.searchsorted(s.entry[by], entry)
            n = np.searchsorted(s.entry[by], entry, side="right") - lo
            r = np.repeat(np.arange(len(entry)), n)
            occ = by[lo[r] + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)]
            own = np.array(ids[:n_known], np.int64)[s.doc[occ]]
            hit = least[r] < own
            start = s.first[occ[hit]] + at[r[hit]]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        n_words, n_removed, kept = [], [], []
        for i, t in enumerate(texts):
            words = t.split()
            n_words.append(len(words))
            if i < n_known and (cut := gone[base[i]:base[i + 1]]).any():
                n_removed.append(int(cut.sum()))
                words = [w for w, c in zip(words, cut.tolist()) if not c]
            else:
                n_removed.append(0)
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        out = blob_table(id=(ids, pa.int64()), n_words=(n_words, pa.int64()),
                         n_removed=(n_removed, pa.int64()), kept_text=(kept, pa.string()))
        if "carried" in docs.column_names:
            out = out.append_column("carried", docs.column("carried").take(pa.array(order, pa.int64())))
        return out
    return run


def remove_repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                            window: int = 13, gram: int = 3, carry: list[str] | None = None,
                            hot_windows: int = HOT_WINDOWS) -> DataFrame:
    """One row per input row: (doc_id, n_words, n_removed, kept_text), and with
    ``carry`` a struct ``carried`` of those columns, as they are."""
    batched, total = in_batches(docs, doc_id, text, carry=carry)
    hot = docs.sparkSession.sparkContext.broadcast(hot_minimisers(
        docs, doc_id, text, window, gram, total, max(hot_windows, math.ceil(total / HOT_LIST))))
    spark_buckets = max(1, math.ceil(total * 3 / BUCKET_BYTES))
    sent = batched.groupBy("batch").applyInArrow(
        _send(window, gram, spark_buckets, hot), "bucket long, batch long, strings binary")
    answers = dealt(sent, "bucket", 3 * total).groupBy("bucket").applyInArrow(_answer(window), "batch long, answer binary")
    out = batched.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        _remove(window, gram, hot), T.StructType(
            [T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()),
             T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
            + ([T.StructField("carried", T.StructType([docs.schema[c] for c in carry]))] if carry else [])))
    return out.withColumnRenamed("id", doc_id)
