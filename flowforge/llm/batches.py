"""Batches of documents, and arrays packed for the shuffle.

Both substring operators work in rounds: every batch of documents sends its
strings, already distinct within the batch, to the buckets that their
minimisers name, and each bucket answers the batches.  A batch is a fixed
function of the row (hash of id), so each round rebuilds the same strings from
the same shuffled documents, also after an executor was lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.common import deal_width, text_bytes

BATCH_BYTES = 4 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def in_batches(docs: DataFrame, doc_id: str, text: str, batch_bytes: int = BATCH_BYTES,
               carry: list[str] | None = None, deal: bool = True) -> tuple[DataFrame, int]:
    """((batch, id, text, carried columns) dealt by batch, bytes of all texts)."""
    total = text_bytes(docs, text)
    n = max(1, math.ceil(total / batch_bytes))
    ident = F.col(doc_id).cast("long")
    key = F.xxhash64(ident, F.when(ident.isNull(), F.col(text)))
    out = docs.select(F.pmod(key, F.lit(n)).cast("long").alias("batch"), ident.alias("id"),
                      F.col(text).alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    return (out.repartition(deal_width(docs.sparkSession, total), "batch") if deal else out), total


def sorted_rows(t: pa.Table) -> tuple[list, list[bytes], list[int]]:
    """Ids and UTF-8 texts of a batch in a fixed order (by id, then text; rows
    without an id last), and the rows in that order."""
    ids = t.column("id").to_pylist()
    texts = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in t.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], order


def in_packed_batches(docs: DataFrame, doc_id: str, text: str,
                      batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """((batch, rows binary) dealt by batch, bytes of all texts): the documents of
    one task and batch travel in one compressed string."""
    plain, total = in_batches(docs, doc_id, text, batch_bytes, deal=False)

    def run(batches):
        for b in batches:
            names = b.column("batch").to_numpy()
            ids = b.column("id").fill_null(0).to_numpy()
            known = b.column("id").is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            texts = b.column("text").cast(pa.large_binary())
            out_b, out = [], []
            for name, rows in by_bucket(names):
                own = [x or b"" for x in texts.take(pa.array(rows)).to_pylist()]
                out_b.append(name)
                out.append(pack(ids[rows], known[rows], np.fromiter(map(len, own), np.int64, len(own)),
                                b"".join(own)))
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out, pa.binary())],
                                             names=["batch", "rows"])

    packed = plain.mapInArrow(run, "batch long, rows binary")
    return packed.repartition(deal_width(docs.sparkSession, total), "batch"), total


def opened_rows(t: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a packed batch, in the order of ``sorted_rows``."""
    ids, texts = [], []
    for blob in t.column("rows").to_pylist():
        i, known, n, text = unpack(blob, np.int64, np.uint8, np.int64, None)
        ends = np.cumsum(n).tolist()
        ids += [x if k else None for x, k in zip(i.tolist(), known.tolist())]
        texts += [text[a:e] for a, e in zip([0] + ends[:-1], ends)]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


# ------------------------------------------------------------------- hashes

def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for k, base in enumerate((_MULT, inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


def powers_of_base(n: int) -> np.ndarray:
    """The first ``n`` powers of the base of ``prefix_sums``."""
    return _powers(n)[0]


def prefix_sums(a: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes (modulo 2^64)."""
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + _ONE) * _powers(len(a) + 1)[0][:len(a)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start])


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = g, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


# ------------------------------------------------------------------ packing

def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed string; bytes of equal significance together."""
    import zstandard
    head, body = [len(arrays)], []
    for a in arrays:
        if isinstance(a, bytes):
            head += [len(a), 0]
            body.append(a)
        else:
            head += [len(a), a.dtype.itemsize]
            body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(
        np.array(head, np.int64).tobytes() + b"".join(body))


def unpack(blob: bytes, *types) -> list:
    """Inverse of ``pack``; a type of None gives bytes."""
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).tolist()
    at, out = 8 + 16 * n, []
    for k, kind in enumerate(types):
        count, size = head[2 * k:2 * k + 2]
        if size == 0:
            out.append(raw[at:at + count])
            at += count
        else:
            flat = np.frombuffer(raw, np.uint8, count * size, at).reshape(size, count)
            out.append(np.ascontiguousarray(flat.T).view(kind).reshape(-1) if count else np.empty(0, kind))
            at += count * size
    return out


def blob_table(**columns) -> pa.Table:
    """``name=(values, arrow type)`` columns."""
    return pa.table({k: pa.array(v, type=t) for k, (v, t) in columns.items()})


def by_bucket(bucket: np.ndarray):
    """(bucket, positions) for every bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part
