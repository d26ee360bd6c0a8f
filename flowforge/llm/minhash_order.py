"""Order MinHash: document fingerprints that follow edit distance.

Method
------
The k-mers of a text are its runs of ``k`` code points, each with the number of
its occurrence so far, so repeats count.  A numbered k-mer has one well-mixed
64-bit value x, and hash function i is x * a_i modulo 2^64 with a random odd a_i,
so every function has an order of its own.  The products are taken in blocks of
``BLOCK`` k-mers with the least so far carried on.  For each of ``sketches`` functions, the ``picks`` numbered
k-mers of smallest hash are chosen, put back into text order, and their k-mers
(without the number) hashed as a tuple.  Two
texts agree in a sketch only when they share the chosen k-mers in the same
order, so the share of equal entries falls with edits *and* with reordering.

A text of fewer k-mers than ``picks`` uses all it has; one shorter than ``k`` is
one k-mer; the empty text has a fixed fingerprint of its own.  Numbering sorts
the k-mer hashes of a text; a text of more than ``pass_kmers`` k-mers is done in
several passes, each over one residue class of the hashes, so memory stays bounded
beside the text itself.

Defined results: a null text is the empty text; equal texts have equal
fingerprints; likeness is the share of equal entries (0 to 1).  Every row has one
row of output, repeated ones too; rows are in the order of id (null first), then of
a hash of the text, then of the text, and the one after the last is the first, so a
single row is its own next.  An empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowforge.llm.batches import mix
from flowforge.llm.common import deal_width, materialize, text_bytes

K, PICKS, SKETCHES = 8, 2, 64
BLOCK = 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _factors(n: int) -> np.ndarray:
    """a_i of the hash functions."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def _kmer_hashes(code: np.ndarray, k: int) -> np.ndarray:
    n = len(code) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + code[j:j + n]
    return mix(h)


def _numbered(h: np.ndarray) -> np.ndarray:
    """Value of (k-mer, occurrence number), for k-mers in text order."""
    bits = np.uint64(int(len(h)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))  # equal k-mers in text order
    pos = (order & low).astype(np.int64)
    head = order >> bits
    new = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
    number = np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))
    out = np.empty(len(h), np.uint64)
    out[pos] = number
    return mix(h + out * _BASE)


def _least(value: np.ndarray, picks: int) -> np.ndarray:
    """Places of the ``picks`` smallest entries of each row, the smallest first (of
    equal ones, the one on the left); ``value`` is overwritten."""
    rows, out = np.arange(len(value)), []
    for _ in range(min(picks, value.shape[1])):
        out.append(value.argmin(axis=1))
        value[rows, out[-1]] = _MOST
    return np.stack(out, axis=1)


def _chosen(x: np.ndarray, a: np.ndarray, picks: int) -> tuple[np.ndarray, np.ndarray]:
    """(x * a_i, position) of its ``picks`` smallest, a row for each a_i."""
    value, place = np.empty((len(a), 0), np.uint64), np.empty((len(a), 0), np.int64)
    for at in range(0, len(x), BLOCK):
        part = x[at:at + BLOCK]
        s = _least(part * a[:, None], picks)
        value = np.concatenate([value, part[s] * a[:, None]], axis=1)
        place = np.concatenate([place, s + at], axis=1)
        if value.shape[1] > picks:
            best = _least(value.copy(), picks)
            value, place = np.take_along_axis(value, best, 1), np.take_along_axis(place, best, 1)
    return value, place


def order_min_hash(text: str, k: int = K, picks: int = PICKS, sketches: int = SKETCHES,
                   pass_kmers: int = 1 << 22) -> np.ndarray:
    """``sketches`` 32-bit entries."""
    if not text:
        return np.zeros(sketches, np.uint32)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) < k:
        code = np.concatenate([code, np.full(k - len(code), 0x110000, np.uint32)])
    a = _factors(sketches)
    passes = -(-(len(code) - k + 1) // pass_kmers)
    values, places, kmers = [], [], []
    for p in range(passes):
        if passes == 1:
            h = _kmer_hashes(code, k)
            at = np.arange(len(h))
        else:
            hs, ats = [], []
            for start in range(0, len(code) - k + 1, pass_kmers):
                part = _kmer_hashes(code[start:start + pass_kmers + k - 1], k)
                use = np.flatnonzero(part % np.uint64(passes) == p)
                hs.append(part[use])
                ats.append(use + start)
            h, at = np.concatenate(hs), np.concatenate(ats)
            if not len(h):
                continue
        v, s = _chosen(_numbered(h), a, picks)
        values.append(v)
        places.append(at[s])
        kmers.append(h[s])
    value, place, kmer = (np.concatenate(c, axis=1) for c in (values, places, kmers))
    if passes > 1:
        best = np.argsort(value, axis=1, kind="stable")[:, :picks]
        place, kmer = np.take_along_axis(place, best, 1), np.take_along_axis(kmer, best, 1)
    kmer = np.take_along_axis(kmer, np.argsort(place, axis=1, kind="stable"), 1)  # text order
    out = a
    for j in range(kmer.shape[1]):
        out = mix(out * _BASE + kmer[:, j])
    return (out >> np.uint64(32)).astype(np.uint32)


def as_bytes(entries: np.ndarray) -> bytes:
    return entries.astype(">u4").tobytes()


def as_hex(entries: np.ndarray) -> str:
    return as_bytes(entries).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def likeness_column(a: Column, b: Column, sketches: int = SKETCHES) -> Column:
    """Likeness of two fingerprint strings, as an expression."""
    same = sum((F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8)).cast("double")
               for i in range(sketches))
    return same / sketches


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", **params) -> DataFrame:
    """``docs`` with the column ``out`` (hex string): the operator by itself."""
    @pandas_udf("string")
    def fp(s: pd.Series) -> pd.Series:
        return s.map(lambda t: as_hex(order_min_hash(t or "", **params)))

    return docs.withColumn(out, fp(F.col(text)))


def with_edited(text: str, after: str) -> str:
    """``text`` whose last floor(n/2) code points give way to the first as many
    (or all) of ``after``."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


def fingerprint_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """Each document's fingerprint beside that of its edited text (the head of the
    next document, by id, put over its second half) and that of the next document.

    The texts are dealt by ranges of ids and sorted, so the next document is the
    next row of the task.  Only the first and last row of each range
    leave it with their text; these few rows (two per partition) are matched by
    the number of their range and done in a second step."""
    spark = docs.sparkSession
    ident = docs.schema[doc_id].dataType.simpleString()
    schema = (f"kind string, part int, id {ident}, n_chars long, edited_sha256 string, fingerprint binary,"
              " edited_fingerprint binary, near_edited double, near_next double, body string")

    def done(i, t, fp, after, after_fp):
        import hashlib
        e = with_edited(t, after)
        efp = order_min_hash(e, **params)
        return ("row", None, i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(),
                as_bytes(fp), as_bytes(efp), likeness(fp, efp), likeness(fp, after_fp), None)

    def batch(rows, kinds):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          names=["kind", "part", "id", "n_chars", "edited_sha256", "fingerprint",
                                                 "edited_fingerprint", "near_edited", "near_next", "body"])

    def column_types(id_type):
        return [pa.string(), pa.int32(), id_type, pa.int64(), pa.string(), pa.binary(), pa.binary(),
                pa.float64(), pa.float64(), pa.string()]

    def run(batches):
        last, kinds, part = None, None, None
        for b in batches:
            kinds = column_types(b.column("id").type)
            got = []
            for part, i, t in zip(*(b.column(c).to_pylist() for c in ("part", "id", "text"))):
                t = t or ""
                fp = order_min_hash(t, **params)
                if last is None:
                    got.append(("first", part, i, None, None, None, None, None, None, t))
                else:
                    got.append(done(*last, t, fp))
                last = (i, t, fp)
                if len(got) >= 500:
                    yield batch(got, kinds)
                    got = []
            if got:
                yield batch(got, kinds)
        if last is not None:
            yield batch([("last", part, last[0], None, None, None, None, None, None, last[1])], kinds)

    def close(batches):
        for b in batches:
            kinds = column_types(b.column("id").type)
            got = [done(i, t, order_min_hash(t, **params), x, order_min_hash(x, **params))
                   for i, t, x in zip(*(b.column(c).to_pylist() for c in ("id", "body", "after")))]
            if got:
                yield batch(got, kinds)

    dealt = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
             .repartitionByRange(deal_width(spark, text_bytes(docs, text)), F.col("id").asc_nulls_first(), F.xxhash64("text"))
             .sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
             .select(F.spark_partition_id().alias("part"), "id", "text"))
    rows = materialize(dealt.mapInArrow(run, schema))
    # ranges in order, empty ones left out: a row of two numbers for each partition
    parts = sorted(r["part"] for r in rows.filter("kind = 'first'").select("part").collect())
    follow = [(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)]
    follows = spark.createDataFrame(follow, "p int, q int")
    ends = (rows.filter("kind = 'last'").select("part", "id", "body").join(follows, F.col("part") == F.col("p"))
            .join(rows.filter("kind = 'first'").select(F.col("part").alias("qp"), F.col("body").alias("after")),
                  F.col("q") == F.col("qp"))
            .select("id", "body", "after"))
    return (rows.filter("kind = 'row'").unionByName(ends.mapInArrow(close, schema))
            .withColumn("fingerprint", F.lower(F.hex("fingerprint")))
            .withColumn("edited_fingerprint", F.lower(F.hex("edited_fingerprint")))
            .withColumnRenamed("id", doc_id).drop("kind", "part", "body"))
