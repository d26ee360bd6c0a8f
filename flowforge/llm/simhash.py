"""SimHash near-duplicates with Golay-code fuzzy keys.

Method
------
1. Fingerprint: every shingle of ``shingle`` words votes with its 64-bit XXH64;
   a bit is set when more than half of the shingles set it.
2. Distinct fingerprints only from here on: copies of one text, however many,
   are one row.
3. The 64 bits are three segments of 23, 23 and 18 bits.  Every 23-bit word lies
   within distance 3 of exactly one codeword of the perfect binary Golay code;
   a word gets the indices of *all* codewords within distance 4 (one, or six
   when it lies at distance 3).  Two words at distance 2 or less always share
   such a codeword: a word half way between them has its codeword within 3, so
   both have it within 4.
4. Pigeonhole: of four differing bits, some two segments together hold at most
   two.  So the key of a pair of segments is one codeword index of each: two
   linked fingerprints share a key of at least one pair of segments.
5. Rows meet per key and are verified by the bit count of the difference.  A
   key emits a spanning forest of the links among its fingerprints, never all
   pairs.  Keys with more than ``block`` fingerprints are cut into blocks, and
   every pair of blocks is a task row group of its own.
6. Components by alternating large-star and small-star contraction, with a
   reliable checkpoint a round.

Defined results: null, empty and blank texts have fingerprint 0 and link to each
other; fewer words than a shingle make one shingle; rows with equal ids keep
their own fingerprints (and one component each id, the smallest reachable);
a null id takes part but never names a component unless all ids in it are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowforge.llm.common import materialize, shuffle_width

#: Generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
_GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
MAX_BITS = 4


# ------------------------------------------------------------- fingerprints

def _bit_votes(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes, in bounded slices."""
    votes = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a:a + (1 << 16)]
        votes += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1) \
            .sum(axis=0, dtype=np.int64)
    bits = votes * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    import xxhash
    h64 = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        return h64(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    hashes = np.fromiter((h64(flat[a:b], seed) for a, b in
                          zip(starts[:n].tolist(), ends[shingle - 1:].tolist())),
                         dtype=np.uint64, count=n)
    return _bit_votes(hashes)


def with_fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(id, fp, text_hash) rows, fp as a signed long."""
    id_type = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()),
                              dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)],
                                             names=["id", "fp", "text_hash"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")) \
        .mapInArrow(run, f"id {id_type.simpleString()}, fp long, text_hash long")


# -------------------------------------------------------------- Golay keys

@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(nearest, more): per 23-bit word the index of its codeword, and for words
    at distance 3 the row of their five further codewords within distance 4."""
    index = np.arange(1 << 12, dtype=np.uint32)
    code = np.zeros(1 << 12, dtype=np.uint32)
    for bit in range(12):
        code ^= np.where((index >> bit) & 1, np.uint32(_GENERATOR << bit), np.uint32(0))
    nearest = np.full(1 << 23, 0xFFFF, dtype=np.uint16)
    radius = np.zeros(1 << 23, dtype=np.uint8)
    one = [1 << i for i in range(23)]
    masks = [(0, 0)] + [(a, 1) for a in one] \
        + [(one[i] | one[j], 2) for i in range(23) for j in range(i)] \
        + [(one[i] | one[j] | one[k], 3) for i in range(23) for j in range(i) for k in range(j)]
    for m, r in masks:
        at = code ^ np.uint32(m)
        nearest[at] = index
        radius[at] = r
    return nearest, radius


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of all codewords within distance 4 of each word."""
    nearest, radius = golay_tables()
    rows = np.arange(len(words))
    out_r, out_c = [rows], [nearest[words].astype(np.int64)]
    edge = rows[radius[words] == 3]
    if len(edge):
        w = words[edge]
        own = nearest[w]
        for bit in range(23):  # a neighbour in another sphere: its codeword is at distance 4
            near = nearest[w ^ np.uint32(1 << bit)]
            other = near != own
            out_r.append(edge[other])
            out_c.append(near[other].astype(np.int64))
    r, c = np.concatenate(out_r), np.concatenate(out_c)
    both = np.unique((r << 12) | c)
    return both >> 12, both & 0xFFF


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every pair of segments; keys of the pairs are disjoint."""
    segs = []
    for at, width in SEGMENTS:
        w = ((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.uint32)
        r, c = golay_keys(w)
        segs.append((np.searchsorted(r, np.arange(len(fps) + 1)), c))
    rows, keys = [], []
    for p, (i, j) in enumerate(PAIRS):
        (si, ci), (sj, cj) = segs[i], segs[j]
        ni, nj = np.diff(si), np.diff(sj)
        n = ni * nj
        row = np.repeat(np.arange(len(fps)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a = ci[si[row] + k // nj[row]]
        b = cj[sj[row] + k % nj[row]]
        rows.append(row)
        keys.append((np.int64(p) << 24) | (a << 12) | b)
    return np.concatenate(rows), np.concatenate(keys)


# ------------------------------------------------------------ verification

def _forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what (src, dst) join, at most one for each node."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    keep = []
    for k, (s, d) in enumerate(zip(src.tolist(), dst.tolist())):
        a, b = root(s), root(d)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(k)
    return src[keep], dst[keep]


def links_in_groups(group: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows of equal group number (rows in group
    order): rows ``d`` apart are compared for every distance d in turn, so no
    pair is stored unless it links."""
    src, dst = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    n_links, at = 0, np.arange(len(group))
    ends = np.searchsorted(group, group, side="right")
    d = 1
    while True:
        at = at[at + d < ends[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= max_bits]
        src.append(fp[near])
        dst.append(fp[near + d])
        n_links += len(near)
        if n_links > 200_000:
            s, t = _forest(np.concatenate(src), np.concatenate(dst))
            src, dst, n_links = [s], [t], 0
        d += 1
    pairs = np.unique(np.stack([np.concatenate(src), np.concatenate(dst)], axis=1), axis=0)
    return _forest(pairs[:, 0], pairs[:, 1])


def links_across(a: np.ndarray, b: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two blocks of one group."""
    src, dst = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for x in a:
        near = b[np.bitwise_count(b ^ x) <= max_bits]
        src.append(np.full(len(near), x))
        dst.append(near)
        if sum(map(len, src)) > 200_000:
            s, t = _forest(np.concatenate(src), np.concatenate(dst))
            src, dst = [s], [t]
    return _forest(np.concatenate(src), np.concatenate(dst))


def candidate_links(fps: DataFrame, block: int = 2048, max_bits: int = MAX_BITS) -> DataFrame:
    """(src, dst) signed-long fingerprints: spanning links of every key group."""
    width = shuffle_width(fps.sparkSession)

    def keyed(batches):
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, len(v), 20_000):
                part = v[a:a + 20_000]
                r, k = fuzzy_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r])], names=["key", "fp"])

    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long").repartition(width, "key")

    def small_groups(batches):
        """Keys of at most ``block`` rows; the others go the other way."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        held_key, held_rows = None, 0

        def found(key, fp):
            size = np.searchsorted(key, key, side="right") - np.searchsorted(key, key)
            use = (size > 1) & (size <= block)
            return _link_batch(*links_in_groups(key[use], fp[use].view(np.uint64), max_bits))

        for t in batches:
            key = t.column(0).to_numpy(zero_copy_only=False)
            fp = t.column(1).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if key[-1] != held_key and held:
                yield found(np.concatenate([h[0] for h in held] + [key[:cut]]),
                            np.concatenate([h[1] for h in held] + [fp[:cut]]))
                held, held_rows = [], 0
            elif cut:
                yield found(key[:cut], fp[:cut])
            if held_rows <= block:  # of a larger key no more than that is kept
                held.append((key[cut:], fp[cut:]))
                held_rows += len(key) - cut
            held_key = key[-1]
        if held:
            yield found(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    few = keys.sortWithinPartitions("key", "fp").mapInArrow(small_groups, "src long, dst long")

    # a large key: each fingerprint has a block and goes to every pair with that block
    large = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block) \
        .select(F.col("key").alias("big"), F.ceil(F.col("size") * 2 / block).cast("int").alias("nb"))
    cut = (keys.join(large, F.col("key") == F.col("big"))
           .withColumn("b", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("nb")).cast("int"))
           .withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
           .select("key", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"),
                   (F.col("b") > F.col("o")).alias("second"), "fp"))

    def block_pair(name, t):
        fp = t.column("fp").to_numpy().view(np.uint64)
        second = t.column("second").to_numpy()
        if name[1].as_py() == name[2].as_py():
            got = links_in_groups(np.zeros(len(fp), np.int64), fp, max_bits)
        else:
            got = links_across(fp[~second], fp[second], max_bits)
        return pa.Table.from_batches([_link_batch(*got)])

    many = cut.groupBy("key", "x", "y").applyInArrow(block_pair, "src long, dst long")
    return few.union(many).distinct()


def _link_batch(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in (src, dst)],
                                      names=["src", "dst"])


# --------------------------------------------------------------- components

#: Links that one task is meant to get; tasks that any number of links is dealt to.
LINKS_PER_TASK, LEAST_TASKS = 50_000, 12


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component.

    Large-star then small-star until nothing changes; each round is a grouped
    minimum (combined map-side) and a join, checkpointed.  Few links run in few tasks,
    whatever the width of a shuffle: every task of a round leaves files of its own."""
    edges = materialize(links.filter(F.col("src") != F.col("dst"))
                        .select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u"))
                        .distinct())
    tasks = max(LEAST_TASKS, math.ceil(edges.count() / LINKS_PER_TASK))  # no round has more links
    edges = edges.coalesce(tasks)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")) \
            .select(F.col("v").alias("n"), F.least("m", "v").alias("m"))
        large = (both.join(low, F.col("v") == F.col("n")).filter(F.col("u") > F.col("v"))
                 .select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .coalesce(tasks).distinct().coalesce(tasks))
        low2 = large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "n")
        small = (large.join(low2, F.col("v") == F.col("n"))
                 .select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"),
                         F.col("m").alias("u"))
                 .filter(F.col("v") != F.col("u")).coalesce(tasks).distinct().coalesce(tasks))
        after = materialize(small)
        # stars: every node has one parent and no parent is a child
        changed = (after.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("v").limit(1)
                   .union(after.select("v").join(after.select(F.col("u").alias("v")), "v", "left_semi")
                          .limit(1)))
        edges = after
        if changed.isEmpty():
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")


def fingerprint_components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(nfp, component_id, root) of every distinct fingerprint in ``prints`` (id, fp):
    the smallest id among the rows of its component, and its root fingerprint."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the segment keys cover up to 4 differing bits")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("low"))
    roots = connected_components(candidate_links(nodes, max_bits=max_bits))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left") \
        .select(F.col("fp").alias("nfp"), F.coalesce("root", "fp").alias("root"), "low")
    least = placed.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r")
    return placed.join(least, F.col("root") == F.col("r")).select("nfp", "component_id", "root")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for every row of ``docs``."""
    prints = materialize(with_fingerprints(docs, doc_id, text, shingle))
    named = fingerprint_components(prints, max_bits)
    return (prints.join(named, F.col("fp") == F.col("nfp"))
            .select(F.col("id").alias(doc_id),
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     shingle: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id (of several
    texts with that id, the one of smallest hash; of equal rows, one)."""
    prints = materialize(with_fingerprints(docs, doc_id, text, shingle))
    named = fingerprint_components(prints, max_bits)
    keep = (prints.join(named, F.col("fp") == F.col("nfp"))
            .filter(F.col("id").eqNullSafe(F.col("component_id")))
            # components are told apart by their root: several can have one smallest id, or none
            .groupBy("root").agg(F.min("component_id").alias("_sh_ki"), F.min("text_hash").alias("_sh_kh"))
            .select("_sh_ki", "_sh_kh").distinct())
    own = docs.withColumn("_sh_h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    first = F.row_number().over(Window.partitionBy(doc_id, "_sh_h").orderBy(F.lit(1)))
    return (own.join(keep, F.col(doc_id).eqNullSafe(F.col("_sh_ki")) & (F.col("_sh_h") == F.col("_sh_kh")))
            .withColumn("_sh_n", first).filter("_sh_n = 1").select(*docs.columns))
