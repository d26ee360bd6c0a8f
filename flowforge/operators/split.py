"""Ordering, exact stratified splits, head and subsamples, append.

Random permutations are replaced by an order on ``md5(key | seed)``: the same
rows for the same data and seed whatever the partitioning or input order, and
the same order in Spark and in SQL.

Scale: a plain ``row_number() OVER (PARTITION BY label ...)`` sends a whole
class to one task, and one class may hold most rows.  Splits, heads and subsamples
need no ranks but only the order keys at a few cuts: those are searched by counting
slim keys, and each row is then compared with them in place.  Where every row needs
its rank (``hash_rank``), rows are bucketed by a prefix of their order key, counts
per (class, bucket) give each bucket's offset, and ``row_number`` runs inside
(class, bucket) only, equal to the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowforge.functions.exprs import hash_key

#: Largest (class x bucket) offset table that is broadcast; above it the
#: offsets are joined with a shuffle join.
BROADCAST_MAX_OFFSET_ROWS = 2_000_000


def sort_flows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ascending sort, missing values last (range-partitioned, distributed)."""
    return df.orderBy(*[F.asc_nulls_last(k) for k in keys])


def append_by_name(*dfs: DataFrame) -> DataFrame:
    """Append by column name, keeping duplicates and the first frame's order."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _prefix_len(max_group_rows: int, target_rows_per_bucket: int, max_prefix: int) -> int:
    if max_group_rows <= target_rows_per_bucket:
        return 1
    p = math.ceil(math.log(max_group_rows / target_rows_per_bucket, 16))
    return max(1, min(max_prefix, p))


def _offsets(counts: DataFrame, group_cols: list[str], bucket_col: str) -> DataFrame:
    """Rows before each bucket inside its group (running sum over buckets)."""
    w = (Window.partitionBy(*group_cols).orderBy(bucket_col)
         .rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def _join_small(df: DataFrame, small: DataFrame, on: list[str], n_rows: int | None) -> DataFrame:
    """Null-safe join, so that a NULL group keeps its rows; broadcast only when the
    number of rows is known and small."""
    right = small.select(*[F.col(c).alias(f"_on_{c}") for c in on],
                         *[c for c in small.columns if c not in on])
    if n_rows is not None and n_rows <= BROADCAST_MAX_OFFSET_ROWS:
        right = F.broadcast(right)
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(right[f"_on_{c}"]) for c in on])
    return df.join(right, same, "inner").drop(*[f"_on_{c}" for c in on])


def hash_rank(df: DataFrame, group_cols: Sequence[str], key_cols: Sequence[str],
              seed: int | str, *extra, target_rows_per_bucket: int = 2_000_000,
              max_prefix: int = 32, group_counts: Mapping | None = None) -> DataFrame:
    """Add ``_h`` (order key) and ``_rank`` (1-based, per group, ordered by
    ``_h`` then the key columns).  Two-level, see module doc.

    ``group_counts`` (group tuple -> rows), when the caller has it, sets the
    bucket count without another pass.
    """
    group_cols = list(group_cols)
    key_cols = list(key_cols)
    hd = df.withColumn("_h", hash_key(key_cols, seed, *extra))
    if group_counts is None:
        max_rows = df.count()
        n_groups = None
    else:
        max_rows = max(group_counts.values(), default=0)
        n_groups = len(group_counts)
    p = _prefix_len(max_rows, target_rows_per_bucket, max_prefix)
    hd = hd.withColumn("_b", F.substring("_h", 1, p))
    counts = hd.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, group_cols, "_b").drop("_n")
    n_off = None if n_groups is None else n_groups * (16 ** p)
    ranked = _join_small(hd, offsets, group_cols + ["_b"], n_off)
    w = Window.partitionBy(*group_cols, "_b").orderBy("_h", *key_cols)
    return ranked.withColumn("_rank", F.col("_off") + F.row_number().over(w)).drop("_b", "_off")


def _pct_triplets(percentages: Mapping) -> dict:
    out = {}
    for label, v in percentages.items():
        if isinstance(v, (tuple, list)):
            tr, cv, te = (float(x) for x in v)
        else:
            tr = float(v)
            cv = te = tr / 2
        if tr + cv + te > 100:
            raise ValueError(f"percentages of {label!r} add up to more than 100")
        out[label] = (tr, cv, te)
    return out


def split_cut_points(class_sizes: Mapping, percentages: Mapping) -> dict:
    """Per class: (n_train, n_crossval, n_test) = int(n * pct / 100) each."""
    pct = _pct_triplets(percentages)
    cuts = {}
    for label, n in class_sizes.items():
        if label not in pct:
            continue
        tr, cv, te = pct[label]
        cuts[label] = (int(n * tr / 100), int(n * cv / 100), int(n * te / 100))
    return cuts


#: Digits of an order string: an md5 and a 64-bit hash.
ORDER_DIGITS = 48


def _whole(columns: Sequence[str]) -> Column:
    """Hash of a whole row, 16 hexadecimal digits."""
    return F.lpad(F.hex(F.xxhash64(*columns)), 16, "0")


def row_order(df: DataFrame, key_cols: Sequence[str], seed, *extra) -> Column:
    """Order string of a row: ``md5(key|seed)``, then a hash of the whole row, so
    that only rows alike in every column share one (but for hash collisions, which
    the tie step handles)."""
    return F.concat(hash_key(list(key_cols), seed, *extra), _whole(df.columns))


#: Digits by which an order string is read on in a round of counting: the driver gets
#: at most 16 ** 3 counts per class (or per wanted rank, after the first round).
ROUND_DIGITS = 3


def _counts(slim: DataFrame, digits: int, within: Mapping) -> dict:
    """Rows per group and prefix of ``digits`` digits: ``group -> {prefix: rows}``,
    inside the prefixes ``within`` (group -> prefixes) where it names any."""
    if within:
        near = [(F.col("_g") == F.lit(g)) & F.substring("_o", 1, len(ps[0])).isin(*ps)
                for g, ps in within.items()]
        slim = slim.filter(reduce(lambda x, y: x | y, near))
    out: dict = {}
    for g, q, n in (slim.groupBy("_g", F.substring("_o", 1, digits).alias("_q"))
                    .agg(F.count(F.lit(1)).alias("_n")).collect()):
        out.setdefault(g, {})[q] = n
    return out


def _holder(counts: Mapping, k: int, prefix: str, before: int) -> tuple:
    """Of the counted strings that start with ``prefix``, the one that holds rank
    ``k``: ``(string, rows before it, rows of it)``."""
    for q in sorted(q for q in counts if q.startswith(prefix)):
        if k <= before + counts[q]:
            return q, before, counts[q]
        before += counts[q]
    raise ValueError(f"rank {k} is past the last row")


def _cut_values(slim: DataFrame, first: Mapping, ranks: Sequence[tuple], rows_per_bucket: int) -> dict:
    """Order strings at given ranks: ``(group, rank) -> (value, rows before, rows equal)``.

    ``slim`` holds ``(_g, _o)`` (group, hexadecimal order string), ``first`` its counts
    by ``ROUND_DIGITS`` digits; ``ranks`` are as few as the caller's classes or
    subsets.  Every round is one aggregation with map-side combine that reads on by
    ``ROUND_DIGITS`` digits, inside the prefixes that hold a wanted rank, until those
    hold ``rows_per_bucket`` rows or fewer; these are then counted by whole order
    string.  A round divides the rows by about 4,096; rows alike in every column
    never part, so after ``ORDER_DIGITS`` digits their string is whole as well.
    """
    digits = ROUND_DIGITS
    state = {(g, k): _holder(first[g], k, "", 0) for g, k in ranks}
    while state and digits < ORDER_DIGITS:
        few = max(n for _, _, n in state.values()) <= rows_per_bucket
        digits = ORDER_DIGITS if few else digits + ROUND_DIGITS
        within: dict = {}
        for (g, _), (q, _, _) in state.items():
            if q not in within.setdefault(g, []):
                within[g].append(q)
        counts = _counts(slim, digits, within)
        state = {(g, k): _holder(counts[g], k, q, b) for (g, k), (q, b, _) in state.items()}
    return state


#: Copies of one repeated row that a task writes at a time.
COPIES_PER_TASK = 100_000


def _copies(tied: DataFrame, cols: Sequence[str], group: Sequence[str], order: Sequence[str],
            before: str) -> DataFrame:
    """Rows that share a cut value, with their rank ``_rank`` (1-based).

    They are alike in every column but for a hash collision, so they are counted
    rather than ranked, and written again from their count in pieces of
    ``COPIES_PER_TASK``: a hot row does not fill one task.
    """
    n = tied.groupBy(*dict.fromkeys([*group, *cols, *order, before])).agg(F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy(*group, *order).orderBy(*[F.asc_nulls_first(c) for c in cols])
         .rowsBetween(Window.unboundedPreceding, -1))
    pieces = (n.withColumn("_s", F.coalesce(F.sum("_n").over(w), F.lit(0)))
              .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1,
                                                     F.lit(COPIES_PER_TASK).cast("long")))))
    last = F.least(F.col("_n"), F.col("_i") + COPIES_PER_TASK) - 1
    return (pieces.repartition("_i", *group)
            .withColumn("_j", F.explode(F.sequence(F.col("_i"), last)))
            .withColumn("_rank", F.col(before) + F.col("_s") + F.col("_j") + 1))


def stratified_split(df: DataFrame, label_col: str, key_cols: Sequence[str],
                     percentages: Mapping, seed: int = 0,
                     rows_per_bucket: int = 4096, order: str | None = None) -> DataFrame:
    """Exact per-class train / crossval / test split.

    Per class of ``n`` rows (ordered by ``md5(key|seed)``): the first
    ``int(n*p_train/100)`` rows are train, the next ``int(n*p_cv/100)`` crossval,
    the next ``int(n*p_test/100)`` test; the rest, classes without a percentage and
    NULL labels are left out.  A float percentage means cv = test = half of it.
    Adds column ``split``.  ``order`` names a column that holds ``row_order`` of the rows,
    where the caller stored it; it is left out of the result.

    No full row is shuffled.  Slim (class, order string) pairs are counted to find
    the three cut values of each class; the split of a row then follows by comparing
    its order string with them, in a projection.  Only where a cut falls between
    rows alike in every column are those rows counted and written again.
    """
    pct = _pct_triplets(percentages)  # validates before any job runs
    spark = df.sparkSession
    stored = F.col(order) if order else row_order(df, key_cols, seed)
    ordered = df.withColumn("_o", stored)
    df = df.drop(order) if order else df
    if not pct:
        return df.limit(0).withColumn("split", F.lit(None).cast("string"))
    ordered = ordered.filter(F.col(label_col).isin(*pct)).select(*df.columns, "_o")
    slim = ordered.select(F.col(label_col).alias("_g"), "_o")
    first = _counts(slim, ROUND_DIGITS, {})  # class sizes and the first round in one job
    sizes = {g: sum(c.values()) for g, c in first.items()}
    cuts = {k: (v[0], v[0] + v[1], sum(v)) for k, v in split_cut_points(sizes, pct).items()}
    label_type = df.schema[label_col].dataType.simpleString()
    ranks = sorted({(g, k) for g, ks in cuts.items() for k in ks if k > 0}, key=str)
    found = _cut_values(slim, first, ranks, rows_per_bucket)
    # a cut after the last of its equal rows takes `<=`; one between them is a tie
    rows, ties = [], []
    for g, ks in cuts.items():
        values, split_values = [], set()
        for k in ks:
            v, b, n = found.get((g, k), ("", 0, 0))
            values.append(v)
            if k and k < b + n and v not in split_values:
                split_values.add(v)
                ties.append((g, v, b, *ks))
        rows.append((g, *values, sorted(split_values)))
    if not rows:
        return df.limit(0).withColumn("split", F.lit(None).cast("string"))
    marks = spark.createDataFrame(
        rows, f"_g {label_type}, _tr string, _cv string, _te string, _ties array<string>")

    def side(x, a, b, c):
        return F.when(x <= a, "train").when(x <= b, "crossval").when(x <= c, "test")

    marked = ordered.join(F.broadcast(marks), F.col(label_col) == F.col("_g"))
    plain = (marked.filter(~F.array_contains("_ties", F.col("_o")))
             .withColumn("split", side(F.col("_o"), F.col("_tr"), F.col("_cv"), F.col("_te")))
             .filter(F.col("split").isNotNull()).select(*df.columns, "split"))
    if not ties:
        return plain
    tie_df = spark.createDataFrame(
        ties, f"_g {label_type}, _v string, _before bigint, _k1 bigint, _k2 bigint, _k3 bigint")
    tied = ordered.join(F.broadcast(tie_df),
                        (F.col(label_col) == F.col("_g")) & (F.col("_o") == F.col("_v")))
    copies = _copies(tied.withColumn("_ks", F.struct("_k1", "_k2", "_k3")), df.columns,
                     ["_g"], ["_v", "_ks"], "_before")
    copies = (copies.withColumn("split", side(F.col("_rank"), F.col("_ks._k1"), F.col("_ks._k2"),
                                              F.col("_ks._k3")))
              .filter(F.col("split").isNotNull()).select(*df.columns, "split"))
    return plain.unionByName(copies)


def split_sizes(split_df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per (class, split)."""
    return split_df.groupBy(label_col, "split").agg(F.count(F.lit(1)).alias("count"))


#: Keys that one round of the head search compares every row with.
HEAD_PIVOTS = 64


def _head_cut(df: DataFrame, order: list[Column], k: int, n: int, rows_per_bucket: int):
    """The order key at rank ``k`` of ``n`` rows: ``(key literal, rows before, rows equal)``.

    Each round takes up to ``HEAD_PIVOTS`` random keys of the range that holds the
    rank and counts its rows between them; the range left holds none of them, so it
    shrinks every round, by about that factor.  The result does not depend on which
    keys were drawn.
    """
    names = [f"_{i}" for i in range(len(order))]
    key = F.struct(*[c.alias(a) for c, a in zip(order, names)])
    keys = df.select(key.alias("_o"))
    types = [f.dataType for f in keys.schema["_o"].dataType.fields]

    def literal(row):
        return F.struct(*[F.lit(row[a]).cast(t).alias(a) for a, t in zip(names, types)])

    before = 0
    while n > rows_per_bucket:
        drawn = keys.orderBy(F.rand()).limit(HEAD_PIVOTS).distinct().orderBy("_o").collect()
        pivots = [literal(r["_o"]) for r in drawn]
        o = F.col("_o")
        at = F.size(F.filter(F.array(*pivots), lambda p: p < o))
        hit = F.exists(F.array(*pivots), lambda p: p == o)
        counts = {(r["i"], r["e"]): r["n"] for r in
                  keys.groupBy(at.alias("i"), hit.alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for i in range(len(pivots) + 1):
            between, equal = counts.get((i, False), 0), counts.get((i, True), 0)
            if k <= before + between:  # inside the open range below pivot i
                if i:
                    keys = keys.filter(o > pivots[i - 1])
                if i < len(pivots):
                    keys = keys.filter(o < pivots[i])
                n = between
                break
            before += between
            if k <= before + equal:
                return pivots[i], before, equal
            before += equal
    w = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    row = (keys.groupBy("_o").agg(F.count(F.lit(1)).alias("_n"))
           .withColumn("_b", before + F.coalesce(F.sum("_n").over(w), F.lit(0)))
           .filter((F.col("_b") < k) & (F.col("_b") + F.col("_n") >= k)).first())
    return literal(row["_o"]), row["_b"], row["_n"]


def head_percent(df: DataFrame, pct: float, order_cols: Sequence[str],
                 rows_per_bucket: int = 1_000_000) -> DataFrame:
    """First ``int(n * pct / 100)`` rows in ``order_cols`` order (NULL last, NaN before
    it), for columns of any ordered type; equal keys are ordered by a hash of the
    whole row.

    The key at the cut is searched by counting slim keys; at most ``rows_per_bucket``
    of them are ranked in one task.  The result is then a filter on the key: no full
    row is shuffled, but for rows alike in every column that lie on the cut.
    """
    n = df.count()
    k = int(n * float(pct) / 100)
    if k <= 0:
        return df.limit(0)
    if k >= n:
        return df
    order = [x for c in order_cols for x in (F.col(c).isNull(), F.col(c))]
    order.append(F.xxhash64(*df.columns))
    cut, before, equal = _head_cut(df, order, k, n, rows_per_bucket)
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    if k == before + equal:
        return df.filter(key <= cut)
    tied = (df.filter(key == cut).withColumn("_one", F.lit(1))
            .withColumn("_before", F.lit(before).cast("long")))
    copies = _copies(tied, df.columns, ["_one"], [], "_before")
    return df.filter(key < cut).unionByName(
        copies.filter(F.col("_rank") <= F.lit(k)).select(*df.columns))


def subsamples(df: DataFrame, n_subset: int, key_cols: Sequence[str], seed: int = 0,
               rows_per_bucket: int = 4096) -> DataFrame:
    """``n_subset`` subsets of ``ceil(n / n_subset)`` rows, each the head of its
    own permutation (``md5(key|seed|subset)``).  A row appears at most once per
    subset; subsets overlap.  Adds ``subset_id`` (1-based).

    The cut value of each subset is searched by counting, then every row is listed
    for the subsets whose cut it does not exceed: no full row is shuffled.
    """
    orders = {i: row_order(df, key_cols, seed, F.lit(i)) for i in range(1, n_subset + 1)}
    slim = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("_g"), o.alias("_o")) for i, o in orders.items()])).alias("s")).select("s.*")
    first = _counts(slim, ROUND_DIGITS, {})
    if not first:
        return df.withColumn("subset_id", F.lit(0)).limit(0)
    size = math.ceil(sum(first[1].values()) / n_subset)
    found = _cut_values(slim, first, [(i, size) for i in orders], rows_per_bucket)
    cuts = {i: found[(i, size)] for i in orders}
    in_subset, out = [], None
    for i, (v, before, equal) in cuts.items():
        whole = size == before + equal
        in_subset.append(F.when(orders[i] <= v if whole else orders[i] < v, F.lit(i)))
        if not whole:
            tied = (df.filter(orders[i] == v).withColumn("_one", F.lit(i))
                    .withColumn("_before", F.lit(before).cast("long")))
            copies = (_copies(tied, df.columns, ["_one"], [], "_before")
                      .filter(F.col("_rank") <= F.lit(size))
                      .select(*df.columns, F.col("_one").alias("subset_id")))
            out = copies if out is None else out.unionByName(copies)
    plain = df.withColumn("subset_id", F.explode(F.array_compact(F.array(*in_subset))))
    return plain if out is None else plain.unionByName(out)


def shuffle_sets(df: DataFrame, set_cols: Sequence[str], key_cols: Sequence[str],
                 seed: int | str = "shuffle", order: str | None = None) -> DataFrame:
    """Finished sets, each in the order of ``md5(key|seed)``: one range-partitioned
    sort, so that a large set spreads over many tasks.  Rows are whole, so data and
    labels stay aligned (F5).

    The order string is a column before the sort: as an expression of the sort it would be
    worked out again in every comparison.  ``order`` names a column that holds
    ``hash_key(key_cols, seed)``, where the caller stored it; it is left out of the result."""
    rows = df.drop(order) if order else df
    key = F.col(order) if order else hash_key(list(key_cols), seed)
    return (df.withColumn("_o", F.concat(key, _whole(rows.columns)))
            .orderBy(*set_cols, "_o").select(*rows.columns))
