"""Profiling aggregates: class counts, missing values, constant features,
column statistics and histograms.  Each is one aggregation pass with partial
(map-side) aggregation; results are small (one row per class or column)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per label, most frequent first; missing labels are left out."""
    return (df.filter(F.col(label_col).isNotNull())
            .groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(label_col)))


def type_list(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Distinct labels by falling frequency, with their position (1 = most rows).

    The window runs over the per-label counts (one row per class), not over
    the flows.
    """
    counts = class_counts(df, label_col)
    w = Window.orderBy(F.desc("count"), F.asc(label_col))
    return counts.select(label_col, F.row_number().over(w).alias("position"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None,
                keep_zero: bool = False) -> DataFrame:
    """Missing values per column, as rows ``(column, n_missing)``."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "n_missing")
    return long if keep_zero else long.filter(F.col("n_missing") > 0)


def constant_features(df: DataFrame, split_col: str = "split",
                      cols: Sequence[str] | None = None,
                      splits: Sequence[str] = ("train", "crossval", "test")) -> DataFrame:
    """Columns with one value inside *every* split (each on its own); a column with no
    value in a split is not reported.  Returns rows ``(column)``.

    One grouped aggregation over all splits.  Min and max of a string would sort the
    whole input, so a column that is not a number is compared by the min and max of
    its 64-bit hash, and the few that pass are then compared exactly.
    """
    cols = [c for c in (cols or df.columns) if c != split_col]
    rows = df.filter(F.col(split_col).isin(*splits))
    hashed = {f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)}

    def constant_in_all(names, value):
        same = rows.groupBy(split_col).agg(*[
            F.coalesce(F.min(value(c)) == F.max(value(c)), F.lit(False)).alias(c) for c in names])
        return (same.unpivot([split_col], names, "column", "is_const").groupBy("column")
                .agg(F.bool_and("is_const").alias("all_const"),
                     F.countDistinct(split_col).alias("n_splits"))
                .filter(F.col("all_const") & (F.col("n_splits") == len(splits)))
                .select("column"))

    if not cols:
        return df.sparkSession.createDataFrame([], "column string")
    out = constant_in_all(cols, lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
                          if c in hashed else F.col(c))
    if hashed.isdisjoint(cols):
        return out
    # names only, at most one per column of the table
    passed = [r[0] for r in out.collect()]
    exact = [c for c in passed if c in hashed]
    if exact:
        kept = {r[0] for r in constant_in_all(exact, F.col).collect()}
        passed = [c for c in passed if c not in hashed or c in kept]
    return df.sparkSession.createDataFrame([(c,) for c in passed], "column string")


def _interp(lo_v, hi_v, frac):
    return lo_v + (hi_v - lo_v) * frac


def column_stats(df: DataFrame, cols: Sequence[str], exact: bool = True,
                 accuracy: int = 10_000, probs: Sequence[float] = (0.25, 0.75),
                 quantiles: bool = True, max_bracket: int = 2_000_000) -> DataFrame:
    """Per column: min, max, mean, population std, 25th/75th percentile with
    linear interpolation (position ``q*(n-1)``).  Rows ``(column, min, max,
    mean, std, q1, q3)``.

    Exact quartiles in bounded memory:

    1. one pass for min/max/mean/std/count and ``percentile_approx`` values
       bracketing every quantile (rank error <= n/accuracy);
    2. one aggregation counting the rows below, inside and on the ends of each
       bracket (plain sums, no row is copied);
    3. one pass over the values inside the brackets only (about ``6n/accuracy`` per
       quantile), grouped by value and ranked in Spark: the driver gets one row per
       wanted rank.

    A bracket counted above ``max_bracket`` rows is first narrowed by
    ``percentile_approx`` over its own rows, by a factor of about ``accuracy / 8``
    each time; ends that hold the rank themselves resolve it.

    Spark's exact ``percentile`` keeps a map of every distinct value and
    merges it in one task, which does not scale to continuous features.
    ``exact=False`` stops after pass 1 and uses ``percentile_approx``;
    ``quantiles=False`` skips the quartiles (one pass, q1/q3 NULL).
    """
    cols = list(cols)
    spark = df.sparkSession
    delta = 3.0 / accuracy
    brackets = []
    for q in probs:
        brackets += [max(0.0, q - delta), min(1.0, q + delta)]
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.avg(x).alias(f"mean{i}"),
                 F.stddev_pop(x).alias(f"sd{i}"), F.count(x).alias(f"n{i}")]
        if quantiles:
            aggs += [F.percentile_approx(x, list(probs), accuracy).alias(f"ap{i}"),
                     F.percentile_approx(x, brackets, accuracy).alias(f"br{i}")]
    first = df.agg(*aggs).first()

    quart = {}
    if not quantiles:
        quart = {c: [None] * len(probs) for c in cols}
    elif exact:
        # 0-based ranks wanted of each (column, quantile), and the bracket they lie in
        targets = []
        for i in range(len(cols)):
            n = first[f"n{i}"]
            for j, q in enumerate(probs if n else ()):
                pos = q * (n - 1)
                targets.append((i, sorted({int(pos // 1), int(-(-pos // 1))}),
                                first[f"br{i}"][2 * j], first[f"br{i}"][2 * j + 1]))
        resolved = _resolve_ranks(df, cols, targets, accuracy, delta, max_bracket)
        for i, c in enumerate(cols):
            n = first[f"n{i}"]
            vals = []
            for q in probs:
                if not n:
                    vals.append(None)
                    continue
                pos = q * (n - 1)
                lo_r, hi_r = int(pos // 1), int(-(-pos // 1))
                vals.append(_interp(resolved[(i, lo_r)], resolved[(i, hi_r)], pos - lo_r))
            quart[c] = vals
    else:
        for i, c in enumerate(cols):
            ap = first[f"ap{i}"]
            quart[c] = [float(v) if v is not None else None for v in ap] if ap else [None] * len(probs)

    rows = []
    for i, c in enumerate(cols):
        q = quart[c]
        rows.append((c, first[f"mn{i}"], first[f"mx{i}"], first[f"mean{i}"], first[f"sd{i}"],
                     q[0], q[1] if len(q) > 1 else None))
    return spark.createDataFrame(
        rows, "column string, min double, max double, mean double, std double, q1 double, q3 double")


def _resolve_ranks(df, cols, targets, accuracy, delta, max_bracket):
    """Exact order statistics ``(column index, rank) -> value``; ``targets`` are
    ``(column index, ranks, lo, hi)``, see ``column_stats``.

    Every round counts each bracket ``[lo, hi]`` exactly.  Ranks outside it (a sketch
    that missed) move to the side they lie on; ranks on an end are done; the others
    lie strictly between the ends.  Then a bracket of few rows is ranked, and a large
    one is narrowed to a sketch of its own inner rows, whose ends lie strictly inside
    the old ones: it loses rows every round, so the search ends.
    """
    resolved = {}
    inf = float("inf")
    while targets:
        aggs = []
        for t, (i, _ranks, lo, hi) in enumerate(targets):
            x = F.col(cols[i]).cast("double")
            aggs += [F.count_if(x < lo).alias(f"below{t}"), F.count_if(x == lo).alias(f"lo{t}"),
                     F.count_if((x > lo) & (x < hi)).alias(f"in{t}"),
                     F.count_if(x == hi).alias(f"hi{t}")]
        counts = df.agg(*aggs).first()
        small, large, moved = [], [], []
        for t, (i, ranks, lo, hi) in enumerate(targets):
            start = counts[f"below{t}"] + counts[f"lo{t}"]
            end = start + counts[f"in{t}"]
            top = counts[f"hi{t}"] if hi != lo else 0
            inner = []
            for r in ranks:
                if counts[f"below{t}"] <= r < start:
                    resolved[(i, r)] = lo
                elif end <= r < end + top:
                    resolved[(i, r)] = hi
                elif start <= r < end:
                    inner.append(r)
                else:
                    moved.append((i, [r], -inf, lo) if r < start else (i, [r], hi, inf))
            if inner:
                (small if end - start <= max_bracket else large).append(
                    (i, inner, lo, hi, start, end - start))
        if small:
            resolved.update(_rank_inside(df, cols, small))
        targets = moved
        if large:
            sketches = []
            for t, (i, ranks, lo, hi, start, n) in enumerate(large):
                x = F.col(cols[i]).cast("double")
                probs = [max(0.0, (ranks[0] - start) / n - delta), min(1.0, (ranks[-1] - start) / n + delta)]
                sketches.append(F.percentile_approx(F.when((x > lo) & (x < hi), x), probs, accuracy)
                                .alias(f"q{t}"))
            found = df.agg(*sketches).first()
            targets = moved + [(i, ranks, *(float(v) for v in found[f"q{t}"]))
                               for t, (i, ranks, *_rest) in enumerate(large)]
    return resolved


def _rank_inside(df, cols, brackets) -> dict:
    """Values at the wanted ranks strictly inside counted brackets ``(column index,
    ranks, lo, hi, rows before, rows inside)``.  Only values inside a bracket leave
    their row; equal ones are counted together."""
    tagged = []
    for t, (i, _ranks, lo, hi, _start, _n) in enumerate(brackets):
        x = F.col(cols[i]).cast("double")
        tagged.append(F.when((x > lo) & (x < hi), F.struct(F.lit(t).alias("t"), x.alias("v"))))
    values = (df.select(F.explode(F.array_compact(F.array(*tagged))).alias("s")).select("s.*")
              .groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("t").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    wanted = df.sparkSession.createDataFrame(
        [(t, r - b[4]) for t, b in enumerate(brackets) for r in b[1]], "t int, k bigint")
    hits = (values.withColumn("_s", F.coalesce(F.sum("n").over(w), F.lit(0)))
            .join(F.broadcast(wanted), "t")
            .filter((F.col("_s") <= F.col("k")) & (F.col("k") < F.col("_s") + F.col("n"))))
    return {(brackets[r["t"]][0], r["k"] + brackets[r["t"]][4]): r["v"]
            for r in hits.select("t", "k", "v").collect()}


def global_stats(df: DataFrame, cols: Sequence[str], exact: bool = True,
                 accuracy: int = 10_000, quantiles: bool = True) -> DataFrame:
    """The same statistics over all listed columns together (one scaler for all)."""
    long = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in cols])).alias("value"))
    return column_stats(long, ["value"], exact, accuracy, quantiles=quantiles) \
        .withColumn("column", F.lit("__all__"))


# Histogram bin edges per scaling method.
HISTOGRAM_BINS = {
    "min_max_scaling": [-1, -0.8, -0.6, -0.4, -0.2, 0, 0.2, 0.4, 0.6, 0.8, 1],
    "z_score_std": [-1000, -4, -3, -2, -1, 0, 1, 2, 3, 4, 1000],
}


def bin_index(c, edges: Sequence[float]):
    """Bin of ``c`` for edges e0<...<en: [e_i, e_{i+1}) and the last bin closed;
    NULL outside the range.  (``Bucketizer`` raises on out-of-range values.)"""
    expr = None
    n = len(edges) - 1
    for i in range(n):
        lo, hi = edges[i], edges[i + 1]
        cond = (c >= F.lit(lo)) & ((c <= F.lit(hi)) if i == n - 1 else (c < F.lit(hi)))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def histogram(df: DataFrame, cols: Sequence[str], method: str = "z_score_std") -> DataFrame:
    """Counts per (column, bin) with the method's fixed edges; values outside the
    edges are left out; empty bins are not listed."""
    if method not in HISTOGRAM_BINS:
        raise ValueError(f"no histogram bins for method {method!r}")
    edges = HISTOGRAM_BINS[method]
    bins = range(len(edges) - 1)
    # counted in place, one sum per (column, bin): no row is copied
    index = df.select(*[bin_index(F.col(c).cast("double"), edges).alias(f"b{i}")
                        for i, c in enumerate(cols)])
    counted = index.agg(*[F.array(*[F.count_if(F.col(f"b{i}") == b) for b in bins]).alias(f"n{i}")
                          for i in range(len(cols))])
    long = counted.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(cols)
    ])).alias("s")).select("s.column", F.posexplode("s.n").alias("bin", "count"))
    return long.filter(F.col("count") > 0)


def class_distribution(df: DataFrame, label_idx_col: str = "label_idx") -> DataFrame:
    """Rows per class id, in class-id order."""
    return (df.groupBy(label_idx_col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(label_idx_col))


def n_classes(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Number of distinct labels (one row)."""
    return df.agg(F.countDistinct(label_col).alias("n_classes"))
