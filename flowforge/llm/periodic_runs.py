"""Periodic runs of words by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``max(min_words, 2 * q)`` long, that no neighbouring word
extends keeping period q.

Method
------
1. A run of period q holds each of its words ``max(min_words, 2 * q) // q`` times or
   more, which is never less than twice.  So a word that stands once in a segment is
   in no run inside it: it splits the segment.  Pieces shorter than ``min_words`` go.
   In a piece other words may have become rare, so it is split again, until no piece
   changes.  No run crosses a split, and none is extended by a word beyond it.
   "Once in its segment" is read off the places of the same word before and after,
   which never change: a round is one comparison per word left.  Where rounds take off
   little, the pieces are searched from both ends at once, which costs the smaller part
   of every split: n log n at most.
2. Lag scan of the surviving segments: the words that equal the word q further on form
   stretches, a run is such a stretch of ``max(min_words - q, q)`` words or more.  A
   stretch of q words holds a multiple of q, so only these places are looked at (n log n
   over all lags); from there the stretch is measured both ways by binary search on
   prefix hashes, and then compared word by word.  One stretch found under several lags
   is one run; its least lag is its period.

Texts are worked on where they are read, some documents at a time: nothing is
shuffled, and a long text costs memory in proportion to itself.

Defined results: a null, empty or blank text has no words, no runs and an empty
collapsed text; fewer than ``min_words`` words have no runs; repeated rows and equal or
null ids are answered row by row; an empty table gives no rows; extra columns are left
out (``runs`` or ``id`` among them do no harm).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.batches import mix, powers_of_base, prefix_sums

MIN_WORDS = 12
#: Words, and places looked at, that one step holds at most (beyond a single text).
STEP = 1 << 20
#: A round of splitting that takes off less than this share is the last over all words.
SLOW_ROUND = 1 / 16


# ----------------------------------------------------------------- splitting

def same_word(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the same word of the same document before and after each word
    (-1 and the number of words where there is none)."""
    n = len(code)
    order = np.lexsort((code, doc))
    same = (code[order][1:] == code[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _pieces(at: np.ndarray, owner: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the stretches of neighbouring places with one owner."""
    if not len(at):
        return at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 0)) + 1
    first, end = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]] + 1
    long = end - first >= min_words
    return first[long], end[long]


def _split_from_both_ends(first: int, end: int, before: np.ndarray, after: np.ndarray,
                          min_words: int) -> list[tuple[int, int]]:
    """Stable pieces of one segment."""
    stable, todo = [], [(first, end)]
    while todo:
        a, b = todo.pop()
        if b - a < min_words:
            continue
        done, width, cut = 0, 64, -1
        while cut < 0 and 2 * done < b - a:
            for x, y in ((a + done, min(a + done + width, b)), (max(b - done - width, a), b - done)):
                rare = np.flatnonzero((before[x:y] < a) & (after[x:y] >= b))
                if len(rare):
                    cut = x + int(rare[0])
                    break
            done, width = done + width, width * 2
        if cut < 0:
            stable.append((a, b))
        else:
            todo += [(a, cut), (cut + 1, b)]
    return stable


def stable_segments(code: np.ndarray, doc: np.ndarray, min_words: int = MIN_WORDS) \
        -> tuple[np.ndarray, np.ndarray]:
    """First and end of every piece in which each word stands twice or more."""
    before, after = same_word(code, doc)
    first, end = _pieces(np.arange(len(code)), doc, min_words)
    while len(first):
        size = end - first
        total = int(size.sum())
        owner = np.repeat(np.arange(len(first)), size)
        at = np.arange(total) + np.repeat(first - (np.cumsum(size) - size), size)
        often = (before[at] >= first[owner]) | (after[at] < end[owner])
        if often.all():
            return first, end
        first, end = _pieces(at[often], owner[often], min_words)
        if total - int((end - first).sum()) < total * SLOW_ROUND:
            found = sorted(p for a, b in zip(first.tolist(), end.tolist())
                           for p in _split_from_both_ends(a, b, before, after, min_words))
            found = np.array(found, np.int64).reshape(-1, 2)
            return found[:, 0], found[:, 1]
    return first, end


# ------------------------------------------------------------------ lag scan

def _equal_ahead(sums, powers, x, lag, limit):
    """Most words r <= limit with words x .. x+r-1 equal to those lag further on."""
    low, high = np.zeros(len(x), np.int64), limit.copy()
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high + 1) // 2, low)
        same = (sums[x + mid] - sums[x]) * powers[lag] == sums[x + lag + mid] - sums[x + lag]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def _equal_behind(sums, powers, x, lag, limit):
    """Most words l <= limit with words x-l .. x-1 equal to those lag further on."""
    low, high = np.zeros(len(x), np.int64), limit.copy()
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high + 1) // 2, low)
        same = (sums[x] - sums[x - mid]) * powers[lag] == sums[x + lag] - sums[x + lag - mid]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def _confirmed(code, start, stop, lag, first, end):
    """The stretch if its words are equal; else (a collision of hashes) every stretch of
    the segment at this lag, found word by word."""
    if (code[start:stop] == code[start + lag:stop + lag]).all():
        return [(start, stop)]
    differ = np.flatnonzero(code[first:end - lag] != code[first + lag:end]) + first
    return zip(np.r_[first, differ + 1].tolist(), np.r_[differ, end - lag].tolist())


def runs_in_segments(code: np.ndarray, first: np.ndarray, end: np.ndarray, min_words: int = MIN_WORDS,
                     sums: np.ndarray | None = None) -> np.ndarray:
    """Rows (start, length, period) of the runs inside the segments, by start and period."""
    if not len(first):
        return np.empty((0, 3), np.int64)
    if sums is None:
        sums = prefix_sums(mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    powers = powers_of_base(int((end - first).max()) + 1)
    lags = (end - first) // 2
    found: dict[tuple[int, int], int] = {}
    ends = np.cumsum(lags)
    for p0 in range(0, int(ends[-1]), STEP):  # pairs of a segment and a lag
        pair = np.arange(p0, min(p0 + STEP, int(ends[-1])))
        seg = np.searchsorted(ends, pair, side="right")
        lag = pair - (ends[seg] - lags[seg]) + 1
        places = (end[seg] - first[seg] - 1) // lag  # multiples j * lag, one lag before the end at most
        total = np.cumsum(places)
        done = 0
        while done < len(pair):  # as many pairs as a step holds
            base = int(total[done - 1]) if done else 0
            upto = max(done + 1, int(np.searchsorted(total, base + STEP, side="right")))
            n = places[done:upto]
            of = np.repeat(np.arange(done, upto), n)
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            x = first[seg[of]] + j * lag[of]
            keep = np.flatnonzero(code[x] == code[x + lag[of]])
            x, of = x[keep], of[keep]
            q, a, b = lag[of], first[seg[of]], end[seg[of]]
            right = _equal_ahead(sums, powers, x, q, b - q - x)
            left = _equal_behind(sums, powers, x, q, x - a)
            ok = np.flatnonzero(right + left >= np.maximum(min_words - q, q))
            s, e, q, a, b = (v[ok] for v in (x - left, x + right, q, a, b))
            once = np.unique(np.stack([s, e, q], axis=1), axis=0, return_index=True)[1]
            for i in np.sort(once).tolist():  # lags of a segment in rising order
                lag_i = int(q[i])
                if lag_i % found.get((int(s[i]), int(e[i]) + lag_i), lag_i + 1) == 0:
                    continue  # a multiple of the period of a run that is confirmed
                for start, stop in _confirmed(code, int(s[i]), int(e[i]), lag_i, int(a[i]), int(b[i])):
                    if stop - start >= max(min_words - lag_i, lag_i):
                        key = (start, stop + lag_i)
                        found[key] = min(found.get(key, lag_i), lag_i)
            done = upto
    out = np.array([(s, e - s, q) for (s, e), q in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """False for words that some run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


# ----------------------------------------------------------------- operator

RUNS = "array<struct<start:long,length:long,period:long>>"


def _answer(texts: list[bytes | None], min_words: int) -> tuple[list, list, list]:
    """(number of words, runs, collapsed text) of each text."""
    words = [(t or b"").split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    at = np.concatenate(([0], np.cumsum(n)))
    flat = pa.array([w for own in words for w in own], pa.binary())
    code = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    first, end = stable_segments(code, np.repeat(np.arange(len(n)), n), min_words)
    runs = runs_in_segments(code, first, end, min_words)
    cut = np.searchsorted(runs[:, 0], at)
    out_runs, out_text = [], []
    for k, own in enumerate(words):
        if cut[k] == cut[k + 1]:
            out_runs.append([])
            out_text.append(b" ".join(own))
            continue
        r = runs[cut[k]:cut[k + 1]].copy()
        r[:, 0] -= at[k]
        out_runs.append([{"start": s, "length": m, "period": q} for s, m, q in r.tolist()])
        out_text.append(b" ".join(w for w, keep in zip(own, kept_words(len(own), r).tolist()) if keep))
    return n.tolist(), out_runs, out_text


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  min_words: int = MIN_WORDS, step_bytes: int = 4 << 20) -> DataFrame:
    """Per row: doc_id, n_words, runs (array of start, length, period, in this order) and
    the collapsed text: the words outside the repeated part of every run, joined by one
    space."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            size = np.cumsum(np.fromiter((len(t.as_py() or b"") for t in texts), np.int64, len(texts)))
            a = 0
            while a < len(texts):  # some texts of step_bytes in all, or one longer one
                before = size[a - 1] if a else 0
                e = max(a + 1, int(np.searchsorted(size, before + step_bytes, side="right")))
                n, runs, left = _answer(texts.slice(a, e - a).to_pylist(), min_words)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, e - a), pa.array(n, pa.int64()), pa.array(runs, run_type),
                     pa.array(left, pa.string())], names=["id", "n_words", "runs", "collapsed"])
                a = e

    out = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {id_type}, n_words long, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("id", doc_id)


# ------------------------------------------------- texts with planted periods

def with_planted_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): a tenth of the texts, chosen by the CRC-32 h of the decimal id, repeat
    the p words from word a on up to their end, with g = h div 10, a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8).  A null id chooses no text."""
    h = F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8"))
    own = docs.select(F.col(doc_id), F.col(text).alias("text"), h.alias("_h"),
                      F.floor(h / 10).cast("long").alias("_g"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.when(F.size("_w") > 0, F.size("_w"))
    a = F.pmod("_g", n)
    p = F.floor((n - a) / (F.pmod("_g", F.lit(8)) + 3)).cast("int") + 1
    planted = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 1),
        lambda i: F.element_at("_w", (F.when(i < F.col("_a"), i).otherwise(
            F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p"))) + 1).cast("int")))
    chosen = (F.pmod("_h", F.lit(10)) == 0) & F.col("text").isNotNull()
    return (own.withColumn("_w", F.when(chosen, words))
            .withColumn("_a", a).withColumn("_p", p)
            .select(F.col(doc_id), F.when(F.size("_w") > 0, F.array_join(planted, " "))
                    .otherwise(F.col("text")).alias("text")))


def run_digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Number, greatest run and digests of the answer of ``periodic_runs``."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("m"), r["start"].alias("s"), r["period"].alias("q")))), 1)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"], r["length"], r["period"]).cast("string")), "\n")
    some = F.size("runs") > 0
    return (found.withColumn("_b", F.when(some, best))
            .select(F.col(doc_id), F.size("runs").cast("long").alias("n_runs"), F.col("_b.s").alias("start"),
                    (-F.col("_b.m")).alias("length"), F.col("_b.q").alias("period"),
                    F.floor(F.lit(1000) * -F.col("_b.m") / F.col("_b.q")).cast("long").alias("exponent_milli"),
                    F.sha2(F.when(some, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256)
                    .alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))
