"""Best-fit packing planned on a length histogram.

Method
------
1. Every document is encoded (plus a closing id) and cut into pieces of at most
   ``capacity`` tokens; only its first piece may be shorter.  One slim row per
   piece goes on, checkpointed, so that the encoding is done once.
2. The histogram of piece lengths (at most ``capacity`` rows) comes to the
   driver.  Best-fit decreasing runs over counts: lengths from the longest down,
   each length fills equal bins in runs, tightest bins first.  The plan is a
   list of runs ``(length, first rank, count, first sequence, offset)``; its size
   depends on the number of lengths, not on the number of documents.
3. A piece takes the planned slot of its rank within its length.  Ranks are
   counted within (length, salt) and shifted by the counts of smaller salts, so
   a length that a third of all pieces share is many groups.

Defined results: a null or empty text is the closing id alone; rows with equal
ids and texts are packed each; a null id is packed too; no rows, no pieces; a very
long text, of blanks or line feeds or one word too, is cut like any other; extra
columns are left out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowforge.llm.common import materialize, tokenizer_path

CAPACITY = 2048
LONG_BLANK = 256


# ----------------------------------------------------------------- encoding

class ByteBpeEncoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file.

    Texts of code points below U+0250 without a special string go through the
    same vocabulary in rank form, several times faster (the two agree on every
    class of character there; tests hold them against each other); any other text
    goes through the tokenizers library itself, and so does a text with a run of
    ``LONG_BLANK`` or more blanks, on which the faster splitter's stack grows with
    the run."""

    def __init__(self, name: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken"):
        import base64
        import json
        import re

        self.name, self.full, self.fast = name, None, None
        if ranks:
            import public_tokenizers
            import tiktoken
            with open(tokenizer_path(ranks), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=table, special_tokens={})
        with open(tokenizer_path(name), encoding="utf-8") as f:
            added = re.search(r'"added_tokens"\s*:\s*', text := f.read())
        special = [t["content"] for t in json.JSONDecoder().raw_decode(text, added.end())[0]] if added else []
        self.other = re.compile("|".join(["[^\\x00-\\u024f]", "\\s{%d}" % LONG_BLANK]
                                         + [re.escape(s) for s in special]))

    def _library(self):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        full = Tokenizer.from_file(tokenizer_path(self.name))
        full.no_truncation()
        full.no_padding()
        return full

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not self.other.search(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        if self.full is None:
            self.full = self._library()
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(maxsize=2)
def encoder(name: str, ranks: str | None) -> ByteBpeEncoder:
    """One encoder for all tasks of a Python worker."""
    return ByteBpeEncoder(name, ranks)


def pieces(docs: DataFrame, doc_id: str, text: str, capacity: int, end_id: int, tokenizer: str,
           ranks: str | None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) per piece."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer, ranks)
        for b in batches:
            src, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(enc.ids(t or ""), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, e) in enumerate(zip(cuts, cuts[1:])):
                    src.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(e - a)
                    crc.append(zlib.crc32(ids[a:e].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(src, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        run, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


# ----------------------------------------------------------------- planning

@dataclass(frozen=True)
class Run:
    """``count`` pieces of ``length`` from ``rank`` on: piece i goes to sequence
    ``sequence + i // per`` at ``offset + (i % per) * length``."""
    length: int
    rank: int
    count: int
    sequence: int
    per: int
    offset: int


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts.  Bins with equal room are a list of runs
    of sequence numbers; a length takes the tightest bins it fits, whole runs at
    a time, and opens new bins with as many pieces as fit in one."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first sequence, bins)]
    plan, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens")
        for r in range(length, capacity):
            while left and room.get(r):
                first, bins = room[r].pop()
                # a bin takes pieces until it has room for none
                per = r // length
                full = min(bins, left // per)
                if full:
                    plan.append(Run(length, rank, full * per, first, per, capacity - r))
                    if r - per * length:
                        room[r - per * length].append((first, full))
                    rank, left = rank + full * per, left - full * per
                if bins > full and left:  # fewer pieces than one bin holds
                    plan.append(Run(length, rank, left, first + full, per, capacity - r))
                    if r - left * length:
                        room[r - left * length].append((first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if bins > full:
                    room[r].append((first + full, bins - full))
        if left:
            per = capacity // length
            full, rest = divmod(left, per)
            plan.append(Run(length, rank, left, opened, per, 0))
            if full and capacity - per * length:
                room[capacity - per * length].append((opened, full))
            if rest:
                room[capacity - rest * length].append((opened + full, 1))
            opened += full + bool(rest)
    return plan


def plan_arrays(plan: list[Run]) -> dict[int, np.ndarray]:
    """Per length, rows (rank, sequence, per, offset) in rank order."""
    by = defaultdict(list)
    for r in plan:
        by[r.length].append((r.rank, r.sequence, r.per, r.offset))
    return {k: np.array(sorted(v), np.int64) for k, v in by.items()}


# ------------------------------------------------------------------ packing

def best_fit_packing(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                     end_id: int = 0, tokenizer: str = "byte_bpe_50k.json",
                     ranks: str | None = "byte_bpe_50k.tiktoken", salts: int = 1024) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, doc_id, text, capacity, end_id, tokenizer, ranks))
    id_type = cut.schema["id"].dataType.simpleString()
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))  # <= capacity * salts rows
    histogram = {r["length"]: r["n"] for r in
                 counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = spark.sparkContext.broadcast(plan_arrays(plan_best_fit(histogram, capacity)))
    before = counts.select(F.col("length").alias("bl"), F.col("salt").alias("bs"), (
        F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32"))
    ranked = (salted.withColumn("r", rank - 1)
              .join(before, (F.col("length") == F.col("bl")) & (F.col("salt") == F.col("bs")))
              .select("id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("before")).alias("rank")))

    def place(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                runs = plan.value[n]
                run = runs[np.searchsorted(runs[:, 0], rank[at], side="right") - 1]
                i = rank[at] - run[:, 0]
                seq[at] = run[:, 1] + i // run[:, 2]
                off[at] = run[:, 3] + i % run[:, 2] * n
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in range(5)), pa.array(seq), pa.array(off)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = ranked.mapInArrow(place, f"id {id_type}, piece int, start long, length long, ids_crc32 long,"
                                   " sequence_id long, offset long")
    return out.withColumnRenamed("id", doc_id)
