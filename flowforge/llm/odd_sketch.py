"""MinHash near-duplicates with odd sketches.

Method
------
1. A document's set of word shingles, as 64-bit hashes, gives ``rows * bands`` MinHash
   values: the least of ``a_i * h`` (modulo 2^64, a_i odd) over its hashes h.
2. Bands of ``rows`` values are hashed to keys.  Two sets of similarity J share one with
   probability 1 - (1 - J^rows)^bands; with 4 and 40 a pair at 0.8 is missed once in
   10^9.
3. Odd sketch: every (i, value) flips one bit of a bitmap of 1,024.  The samples in
   which two sets differ are all that is left in the XOR of their bitmaps, so its
   population count estimates the similarity, most precisely where that is high
   (``likeness``).  Candidates are let through to ``slack`` below the threshold, six
   standard deviations, so that the sketch loses no link.
4. Distinct sets only from here on: copies of one text, however many, are one node.
   First every node meets the least node of each of its keys; the least such neighbour
   that its sketch lets through is verified on full sets.  Components of the verified
   links hold nearly all of a group of near copies without listing its pairs.
5. Keys whose nodes are still in several components: every node outside the largest
   one meets all nodes of the key in other components, in blocks of bounded size,
   compared by sketch.  Of the pairs that pass only a spanning forest over the components
   is emitted; it joins them to zones, which hold every candidate pair that is left.
6. In a zone the full sets of all nodes outside its largest component meet those of all
   nodes of other components, in blocks of bounded bytes: sketch first, then common
   hashes are counted, best estimates first, until two components are joined.  So all
   links that a key holds are found or lie inside a component, and no list of pairs
   grows with the square of a group.
7. Sets are not stored: they are built again from the texts of the nodes in question,
   found through a bitmap of ``FILTER_BITS`` over hashes of their ids (a bounded
   broadcast, whatever the corpus; what it lets through in vain drops out in the join).
   Components by checkpointed star contraction.

Defined results: fewer words than a shingle make one shingle of the whole sequence;
null, empty and blank texts have no shingles and link with nothing; equal rows are
answered each.  A row without words is its own component whatever its id.  A null id
takes part but never names a component unless all ids in it are null; ``kept`` is
then true where the row's id is null too.  Rows with one id and different texts are
several nodes.  An empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowforge.llm.batches import mix
from flowforge.llm.common import materialize, scratch_path, shuffle_width
from flowforge.llm.simhash import _forest, connected_components

ROWS, BANDS = 4, 40
SKETCH_BITS = 1024
#: Standard deviations of the estimate that a candidate may lie below the threshold.
SIGMAS = 6.0
#: Shingles worked on at a time; nodes of a key compared in one block.
STEP = 1 << 14
BLOCK = 2048
#: Bytes of full sets in one block of a zone.
BLOCK_BYTES = 8 << 20


# ------------------------------------------------------------------- sketches

@lru_cache(maxsize=4)
def multipliers(n: int, seed: int = 42) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def min_hashes(sets: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """MinHash values (sets x n) of hash sets that stand one after another, none empty."""
    out = np.empty((len(starts), n), np.uint64)
    ends = np.r_[starts[1:], len(sets)]
    a = 0
    while a < len(starts):  # as many sets as a step holds, or one longer one
        e = max(a + 1, int(np.searchsorted(ends, starts[a] + STEP, side="right")))
        part, at = sets[starts[a]:ends[e - 1]], starts[a:e] - starts[a]
        for i, m in enumerate(multipliers(n)):
            out[a:e, i] = np.minimum.reduceat(part * m, at)
        a = e
    return out


def odd_sketches(values: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Bitmaps (sets x bits / 64) in which every (i, value) has flipped one bit."""
    n, k = values.shape
    place = mix(values ^ multipliers(k, 7)) % np.uint64(bits)
    out = np.zeros((n, bits // 64), np.uint64)
    row = np.arange(n)
    for i in range(k):  # one bit a row at a time
        out[row, (place[:, i] >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (place[:, i] & np.uint64(63))
    return out


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Keys (sets x bands); keys of different bands differ."""
    n, k = values.shape
    key = np.broadcast_to(multipliers(k // rows, 11), (n, k // rows))
    for r in range(rows):
        key = mix(key ^ values[:, r::rows][:, :k // rows])
    return key


def likeness(differing: np.ndarray, samples: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarity estimated from the population count of an XOR."""
    free = np.maximum(1 - 2 * np.asarray(differing, np.float64) / bits, 1e-12)
    return 1 + bits / (4 * samples) * np.log(free)


def most_differing(threshold: float, samples: int, bits: int = SKETCH_BITS, sigmas: float = SIGMAS) -> int:
    """Largest population count at which a pair may still have the threshold: ``sigmas``
    standard deviations (of the samples that differ, and of the bits they meet on)
    above the expected count at the threshold."""
    d = samples * (1 - threshold)
    upper = d + sigmas * np.sqrt(samples * threshold * (1 - threshold))
    decay = np.exp(-4 * upper / bits)
    spread = np.sqrt(bits / 4 * (1 - decay * decay))
    return int(bits / 2 * (1 - decay) + sigmas * spread)


# ---------------------------------------------------------------- shingle sets

def shingle_sets(texts: list[bytes | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct shingle hashes of each text, rising, one text after
    another.  A-Z are lower-cased; words are parted by ASCII white space."""
    import xxhash
    words = [(t or b"").lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    if not n.sum():
        return np.empty(0, np.uint64), np.zeros(len(n), np.int64)
    coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    h64 = xxhash.xxh64_intdigest
    of_word = np.fromiter((h64(w, 42) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = np.r_[of_word[coded.indices.to_numpy()], np.zeros(shingle - 1, np.uint64)]
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), count)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    wide = np.minimum(n, shingle)[doc]  # words of the shingle
    key = mix(wide.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    for j in range(shingle):
        key = np.where(j < wide, mix(key * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + j, len(h) - 1)]), key)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
    return key[new], np.bincount(doc[new], minlength=len(n))


PRINTS = "n_shingles long, node long, sketch binary, bands array<long>"


def _in_steps(docs: DataFrame, doc_id: str, text: str, answer, schema: str, step_bytes: int = 2 << 20) -> DataFrame:
    """``answer(ids, texts)`` for some texts of ``step_bytes`` in all at a time, or one
    longer one."""
    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            size = np.cumsum(np.fromiter((len(t.as_py() or b"") for t in texts), np.int64, len(texts)))
            a = 0
            while a < len(texts):
                e = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + step_bytes, side="right")))
                yield answer(b.column(0).slice(a, e - a), texts.slice(a, e - a).to_pylist())
                a = e

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def node_names(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash per set that is not empty, the same for equal sets."""
    n = sizes[sizes > 0]
    return mix(np.add.reduceat(mix(sets), np.cumsum(n) - n) + mix(n.astype(np.uint64))).view(np.int64)


def with_sketches(docs: DataFrame, doc_id: str, text: str, shingle: int, rows: int, bands: int,
                  bits: int) -> DataFrame:
    """(id, n_shingles, node, sketch, bands) per row; node (a hash of the whole set) and
    what follows it are null for a row without words."""
    def answer(ids, texts):
        sets, n = shingle_sets(texts, shingle)
        some = n > 0
        place = pa.array(np.cumsum(some) - 1, mask=~some)  # a null for a row without words
        node, sketch, keys = np.empty(0, np.int64), [], np.empty((0, bands), np.int64)
        if some.any():
            values = min_hashes(sets, (np.cumsum(n) - n)[some], rows * bands)
            sketch = [r.tobytes() for r in odd_sketches(values, bits)]
            keys = band_keys(values, rows).view(np.int64)
            node = node_names(sets, n)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n), pa.array(node).take(place), pa.array(sketch, pa.binary()).take(place),
             lists.take(place)], names=["id", "n_shingles", "node", "sketch", "bands"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return _in_steps(docs, doc_id, text, answer, f"id {id_type}, {PRINTS}")


#: Bits of the bitmap that finds the rows of wanted nodes; a power of two.
FILTER_BITS = 1 << 26


def sets_of(wanted: DataFrame, docs: DataFrame, doc_id: str, text: str, lows: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, each once (and of a few others)."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = (lows.join(wanted, "node", "left_semi").select(F.col("low").alias("id")).select(place.alias("p"))
             .groupBy(F.shiftright("p", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")))  # FILTER_BITS / 64 rows at most
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.pmod(
        F.xxhash64(doc_id), F.lit(FILTER_BITS)).alias("p"))
    near = rows.join(F.broadcast(words), (F.shiftright("p", 6) == F.col("w"))
                     & F.expr("(shiftright(b, cast(p & 63 as int)) & 1) = 1"))

    def answer(ids, texts):
        sets, n = shingle_sets(texts, shingle)
        ends = np.cumsum(n)
        own = [sets[a:e].tobytes() for a, e in zip((ends - n).tolist(), ends.tolist()) if e > a]
        return pa.RecordBatch.from_arrays([pa.array(node_names(sets, n) if len(own) else np.empty(0, np.int64)),
                                           pa.array(own, pa.binary())], names=["node", "shingles"])

    return _in_steps(near, "id", "text", answer, "node long, shingles binary").dropDuplicates(["node"])


# ---------------------------------------------------------------- verification

#: Keys (nodes, components) above one part in so many of the rows are joined by broadcast
#: or salted: there are no more than that many of them.
HOT_PARTS = 10_000
#: Pairs that one salt of a node stands for, at least.
PAIRS_PER_SALT = 1000


def attach(pairs: DataFrame, side: str, nodes: DataFrame, columns: list[str], base: DataFrame, total: int) -> DataFrame:
    """``pairs`` with columns of the node on one side (as ``side_column``).  ``base`` are
    the ``total`` pairs themselves.  A node of many pairs, of which there are at most
    ``HOT_PARTS``, stands under several salts, among which its pairs are dealt."""
    limit = max(PAIRS_PER_SALT, total // HOT_PARTS)
    many = F.broadcast(base.groupBy(F.col(side).alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
                       .filter(F.col("_c") > limit).select("_n", F.ceil(F.col("_c") / limit).cast("int").alias("_s")))
    plain = nodes.select(F.col("node").alias("_node"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    cold = pairs.join(many, F.col(side) == F.col("_n"), "left_anti") \
        .join(plain.hint("shuffle_merge"), F.col(side) == F.col("_node"))
    other = F.xxhash64("v" if side == "u" else "u")
    dealt = pairs.join(many, F.col(side) == F.col("_n")) \
        .withColumn("_deal", F.pmod(other, F.col("_s")).cast("int")).drop("_n", "_s")
    salted = plain.join(many, F.col("_node") == F.col("_n")) \
        .withColumn("_key", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_n", "_s")
    hot = dealt.join(salted.hint("shuffle_merge"), (F.col(side) == F.col("_node")) & (F.col("_deal") == F.col("_key")))
    return cold.drop("_node").unionByName(hot.drop("_node", "_key", "_deal"))


def both_sides(pairs: DataFrame, nodes: DataFrame, columns: list[str], total: int) -> DataFrame:
    return attach(attach(pairs, "v", nodes, columns, pairs, total), "u", nodes, columns, pairs, total)


def _differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) for c in (a, b))
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def pass_sketch(pairs: DataFrame, nodes: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (u, v) whose set sizes allow the threshold and whose sketches do."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                keep = _differing(b.column(2), b.column(3)) <= most
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep))

    both = both_sides(pairs, nodes, ["n", "sketch"], pairs.count())
    sizes = F.least("u_n", "v_n") * 100 >= F.greatest("u_n", "v_n") * percent
    return both.filter(sizes).select("u", "v", "u_sketch", "v_sketch").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, sets, percent: int) -> DataFrame:
    """(src, dst) of the (checkpointed) pairs (u, v) with 100 * intersection >=
    percent * union of their full sets; ``sets`` gives those of some nodes."""
    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array(keep))

    total = pairs.count()
    if not total:
        return pairs.select(F.col("u").alias("src"), F.col("v").alias("dst"))
    own = sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    return both_sides(pairs, own, ["shingles"], total) \
        .select("u", "v", "u_shingles", "v_shingles").mapInArrow(run, "src long, dst long")


# ------------------------------------------------------------------ candidates

def join_hot(rows: DataFrame, key: str, other: DataFrame, other_key: str, size: str, total: int) -> DataFrame:
    """Inner join on a key that ``other`` holds once, with its number of ``rows`` in
    ``size``.  Keys of over ``total / HOT_PARTS`` rows, at most ``HOT_PARTS`` of them, are
    broadcast, so that no task gets all rows of one."""
    limit = max(total // HOT_PARTS, 1)
    hot, cold = other.filter(F.col(size) > limit), other.filter(F.col(size) <= limit)
    on = F.col(key) == F.col(other_key)
    return rows.join(F.broadcast(hot), on).unionByName(
        rows.join(cold.hint("shuffle_merge"), on))


def shared_keys(keys: DataFrame, total: int) -> DataFrame:
    """(key, node, u) of the keys that several nodes have; u is the least of them."""
    least = keys.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("size")) \
        .filter("size > 1")
    return join_hot(keys, "key", least, "k", "size", total).select("key", "node", "u")


def in_blocks(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``rows`` (group, comp, main, sb, nb, columns) dealt to blocks (x, y) of their group:
    every row stands as one of all in a block y beside each block x of strays, and a row
    outside the main component as a stray in a block x beside each y."""
    dealt = F.xxhash64("node", F.lit(5))
    as_any = rows.select(group, "comp", *columns, F.lit(False).alias("stray"),
                         F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("x"),
                         F.pmod(dealt, F.col("nb")).cast("int").alias("y"))
    as_stray = rows.filter("comp <> main").select(
        group, "comp", *columns, F.lit(True).alias("stray"), F.pmod(dealt, F.col("sb")).cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y"))
    return as_any.unionByName(as_stray)


def block_groups(placed: DataFrame, group: str, found, schema: str, width: int) -> DataFrame:
    """``found(table)`` for tables of whole blocks (group, x, y), all rows before strays."""
    full = placed.repartition(width, group, "x", "y").sortWithinPartitions(group, "x", "y", "stray", "node")

    def run(batches):
        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            if not len(t):
                continue
            g, x, y = (t.column(c).to_numpy() for c in (group, "x", "y"))
            cut = int(np.argmax((g == g[-1]) & (x == x[-1]) & (y == y[-1])))  # the last block may go on
            if held and not cut and all(held[0].column(c)[-1].as_py() == t.column(c)[0].as_py()
                                        for c in (group, "x", "y")):
                held.append(t)
                continue
            whole = pa.concat_tables([*held, t.slice(0, cut)])
            if len(whole):
                yield found(whole)
            held = [t.slice(cut)]
        if held:
            yield found(pa.concat_tables(held))

    return full.mapInArrow(run, schema)


def _meetings(t: pa.Table, group: str, percent: int, most: int):
    """(a, b, differing bits) positions of strays and nodes of other components of their
    block that sizes and sketches let through, a bounded number at a time."""
    g, x, y, comp, n = (t.column(c).to_numpy() for c in (group, "x", "y", "comp", "n"))
    stray = t.column("stray").to_numpy()
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(g), -1)
    start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    block = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(g)]))
    others = np.bincount(block, ~stray, len(start)).astype(np.int64)  # rows before the strays
    strays = np.flatnonzero(stray)
    ends = np.cumsum(others[block[strays]])
    done = 0
    while done < len(strays):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 18), side="right")))
        w = others[block[strays[done:upto]]]
        a = np.repeat(strays[done:upto], w)
        b = start[block[a]] + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
        ok = (comp[a] != comp[b]) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent)
        a, b = a[ok], b[ok]
        bits = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
        near = bits <= most
        yield a[near], b[near], bits[near]
        done = upto


def cross_edges(keys: DataFrame, nodes: DataFrame, percent: int, most: int, total: int,
                block: int = BLOCK) -> DataFrame:
    """(src, dst): links between components that join whatever components have candidate
    pairs.  ``keys`` holds (key, node, comp)."""
    parts = keys.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = (parts.groupBy(F.col("key").alias("k")).agg(
        F.sum("m").alias("size"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("m", "comp")).alias("most"))
        .filter("comps > 1")
        .select("k", "size", F.col("most.comp").alias("main"),
                F.ceil((F.col("size") - F.col("most.m")) / block).cast("int").alias("sb"),
                F.ceil(F.col("size") / block).cast("int").alias("nb")))
    rows = join_hot(keys, "key", mixed, "k", "size", total).join(nodes, "node")

    def found(t):
        comp = t.column("comp").to_numpy()
        src, dst = np.empty(0, np.int64), np.empty(0, np.int64)
        for a, b, _ in _meetings(t, "key", percent, most):
            both = np.unique(np.stack([comp[a], comp[b]], axis=1), axis=0)
            src, dst = _forest(np.r_[src, both[:, 0]], np.r_[dst, both[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return block_groups(in_blocks(rows, "key", ["node", "n", "sketch"]), "key", found, "src long, dst long",
                        shuffle_width(keys.sparkSession)).distinct()


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Number of hashes that each of the others shares with one rising set."""
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    size = np.fromiter(map(len, others), np.int64, len(others))
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)


def zone_links(members: DataFrame, sets, percent: int, most: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(src, dst): verified links between components, joining all that the links of a
    zone join.  ``members`` are (zone, comp, node, n, sketch)."""
    size = F.sum(F.col("n") * 8)
    parts = members.groupBy("zone", "comp").agg(size.alias("m"))
    zones = parts.groupBy(F.col("zone").alias("z")).agg(
        F.sum("m").alias("size"), F.max(F.struct("m", "comp")).alias("most")) \
        .select("z", F.col("most.comp").alias("main"),
                F.greatest(F.ceil((F.col("size") - F.col("most.m")) / block_bytes), F.lit(1)).cast("int").alias("sb"),
                F.ceil(F.col("size") / block_bytes).cast("int").alias("nb"))
    own = sets(members.select("node").distinct())
    rows = members.join(zones, F.col("zone") == F.col("z")).join(own, "node")

    def found(t):
        comp, node, n = (t.column(c).to_numpy() for c in ("comp", "node", "n"))
        blobs = t.column("shingles")
        known: dict[int, np.ndarray] = {}
        top: dict[int, int] = {}

        def hashes(i):
            if i not in known:
                known[i] = np.frombuffer(blobs[i].as_py(), np.uint64)
            return known[i]

        def root(c):
            while (up := top.get(c, c)) != c:
                top[c] = top.get(up, up)
                c = up
            return c

        src, dst = [], []
        for a, b, bits in _meetings(t, "zone", percent, most):
            order = np.lexsort((bits, a))
            a, b = a[order], b[order]
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
                if not len(part):
                    continue
                one, at = int(a[part[0]]), 0
                while at < len(part):  # the likeliest few first, then as many as there are
                    some = [int(w) for w in b[part[at:at + max(8, at)]] if root(int(comp[w])) != root(int(comp[one]))]
                    at += max(8, at)
                    if not some:
                        continue
                    common = _common(hashes(one), [hashes(w) for w in some])
                    for w, k in zip(some, common.tolist()):
                        p, q = root(int(comp[w])), root(int(comp[one]))
                        if p != q and 100 * k >= percent * (int(n[w]) + int(n[one]) - k):
                            top[max(p, q)] = min(p, q)
                            src.append(int(node[one]))
                            dst.append(int(node[w]))
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return block_groups(in_blocks(rows, "zone", ["node", "n", "sketch", "shingles"]), "zone", found,
                        "src long, dst long", shuffle_width(members.sparkSession))


# -------------------------------------------------------------------- operator

def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                    percent: int = 80, rows: int = ROWS, bands: int = BANDS, bits: int = SKETCH_BITS,
                    block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable) and kept."""
    spark = docs.sparkSession
    path = scratch_path(spark, "odd-sketches")
    with_sketches(docs, doc_id, text, shingle, rows, bands, bits).write.parquet(path)
    prints = spark.read.parquet(path)
    most = most_differing(percent / 100, rows * bands, bits)
    worded = prints.filter("node is not null")
    lows = worded.groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    once = materialize(worded.select("node", F.col("n_shingles").alias("n"), "sketch", "bands")
                       .dropDuplicates(["node"]))
    nodes = once.select("node", "n", "sketch")
    total = once.count()
    shared = materialize(shared_keys(once.select(F.explode("bands").alias("key"), "node"), total * bands))

    def sets(wanted):
        return sets_of(wanted, docs, doc_id, text, lows, shingle)

    # the least neighbour that its sketch lets through, one a node
    star = materialize(shared.filter("u <> node").select("u", F.col("node").alias("v")).distinct())
    first = pass_sketch(star, nodes, percent, most).groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    links = materialize(verified(materialize(first), sets, percent))
    roots = connected_components(links).withColumnRenamed("node", "rn")
    member = shared.join(roots, F.col("node") == F.col("rn"), "left") \
        .select("key", "node", F.coalesce("root", "node").alias("comp"))
    edges = materialize(cross_edges(member, nodes, percent, most, total * bands, block))
    if not edges.isEmpty():
        zones = connected_components(edges)
        zones = zones.unionByName(zones.select(F.col("root").alias("node"), "root").distinct()) \
            .select(F.col("node").alias("c"), F.col("root").alias("zone"))
        members = member.select("node", "comp").distinct().join(zones, F.col("comp") == F.col("c")) \
            .select("zone", "comp", "node").join(nodes, "node")
        links = links.unionByName(zone_links(materialize(members), sets, percent, most, block_bytes))
        roots = connected_components(links).withColumnRenamed("node", "rn")

    # the smallest id of a component; large components are met by broadcast
    placed = lows.join(roots, F.col("node") == F.col("rn"), "left") \
        .select("node", F.coalesce("root", "node").alias("root"), "low", "copies")
    least = placed.groupBy(F.col("root").alias("r")).agg(
        F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = join_hot(placed, "root", least, "r", "size", total) \
        .select(F.col("node").alias("nn"), "component_id", "copies")
    answered = join_hot(worded.select("id", "n_shingles", "node"), "node", named, "nn", "copies", total)
    blank = prints.filter("node is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return answered.select("id", "n_shingles", "component_id").unionByName(blank) \
        .select(F.col("id").alias(doc_id), "n_shingles", "component_id",
                F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
