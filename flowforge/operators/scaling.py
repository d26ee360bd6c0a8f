"""Feature transforms: label index, one-hot, scalers, clip, int8 quantisation.

Fitting is one aggregation over the training rows; the fitted statistics are
a few numbers per column, kept on the driver and applied as literals, so a
transform is a pure projection (whole-stage codegen, no join, no shuffle).

Spark's own scalers differ from the required semantics (``MinMaxScaler`` maps
constants to 0.5, ``StandardScaler`` uses the sample std, ``RobustScaler``
centres on the median), so the formulas are written as column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowforge.functions.exprs import clip_col
from flowforge.operators.profile import column_stats, global_stats, histogram

# The names of the scaling methods.
METHODS = ("min_max_scaling", "z_score_std", "robust_scaling")
ALL_COLUMNS = "__all__"
#: Quantised values run from -INT8_MAX to INT8_MAX.
INT8_MAX = 127


@dataclass(frozen=True)
class ColumnStats:
    min: float | None
    max: float | None
    mean: float | None
    std: float | None
    q1: float | None
    q3: float | None


def _scale_expr(c: Column, s: ColumnStats, method: str) -> Column:
    if method == "min_max_scaling":
        rng = (s.max - s.min) if s.max is not None and s.min is not None else None
        if rng == 0:
            rng = 1.0
        return (c - F.lit(s.min)) / F.lit(rng)
    if method == "z_score_std":
        # no guard for std = 0: the division yields NULL instead of NaN/inf
        return F.try_divide(c - F.lit(s.mean), F.lit(s.std))
    if method == "robust_scaling":
        iqr = (s.q3 - s.q1) if s.q3 is not None and s.q1 is not None else None
        if iqr == 0:
            iqr = 1.0
        return (c - F.lit(s.q1)) / F.lit(iqr)
    raise ValueError(f"unknown scaling method {method!r}")


class NormalizerModel:
    """Fitted scaler: statistics per column (or one set for all columns)."""

    def __init__(self, method: str, stats: dict[str, ColumnStats], cols: list[str]):
        self.method = method
        self.stats = stats
        self.cols = cols

    def _stats_for(self, c: str) -> ColumnStats:
        return self.stats[ALL_COLUMNS] if ALL_COLUMNS in self.stats else self.stats[c]

    def transform(self, df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
        cols = set(cols or self.cols)
        return df.select(*[
            _scale_expr(F.col(c).cast("double"), self._stats_for(c), self.method).alias(c)
            if c in cols else F.col(c) for c in df.columns])

    def histogram(self, df: DataFrame) -> DataFrame:
        """Fixed-bin counts of the (unscaled) input, per column."""
        return histogram(df, self.cols, self.method)


class Normalizer:
    """``Normalizer(method, per_column).fit(df, cols)`` -> ``NormalizerModel``.

    ``exact=False`` takes the quartiles from ``percentile_approx`` (bounded
    memory per task) for very large inputs.
    """

    def __init__(self, method: str = "min_max_scaling", per_column: bool = True,
                 exact: bool = True):
        if method not in METHODS:
            raise ValueError(f"unknown scaling method {method!r}")
        self.method = method
        self.per_column = per_column
        self.exact = exact
        self.model: NormalizerModel | None = None

    def fit(self, df: DataFrame, cols: Sequence[str]) -> NormalizerModel:
        cols = list(cols)
        need_q = self.method == "robust_scaling"  # only the robust scaler needs quartiles
        st = (column_stats(df, cols, self.exact, quantiles=need_q) if self.per_column
              else global_stats(df, cols, self.exact, quantiles=need_q))
        stats = {r["column"]: ColumnStats(r["min"], r["max"], r["mean"], r["std"], r["q1"], r["q3"])
                 for r in st.collect()}
        self.model = NormalizerModel(self.method, stats, cols)
        return self.model

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("transform called before fit")
        return self.model.transform(df)

    def fit_transform(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        return self.fit(df, cols).transform(df)


def clip(df: DataFrame, cols: Sequence[str], low: float, high: float) -> DataFrame:
    """Clip to [low, high]; missing stays missing."""
    cs = set(cols)
    return df.select(*[clip_col(F.col(c), low, high).alias(c) if c in cs else F.col(c)
                       for c in df.columns])


def quantize(df: DataFrame, cols: Sequence[str], model: NormalizerModel | None,
             per_column: bool = True) -> DataFrame:
    """int8 quantisation: ``scale=(max-min)/254``, ``zp=127-max/scale``,
    ``x/scale+zp`` truncated toward zero.  min/max come from ``df`` itself (one
    small aggregation); a fitted model is required first.  A constant column
    has scale 0 and yields NULL."""
    if model is None:
        raise RuntimeError("quantize called before the normalizer was fitted")
    cols = list(cols)
    if per_column:
        row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"mn_{i}") for i, c in enumerate(cols)],
                     *[F.max(F.col(c).cast("double")).alias(f"mx_{i}") for i, c in enumerate(cols)]).first()
        bounds = {c: (row[f"mn_{i}"], row[f"mx_{i}"]) for i, c in enumerate(cols)}
    else:
        long = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in cols])).alias("v"))
        row = long.agg(F.min("v").alias("mn"), F.max("v").alias("mx")).first()
        bounds = {c: (row["mn"], row["mx"]) for c in cols}

    def q(c):
        mn, mx = bounds[c]
        scale = F.lit((mx - mn) / (2 * INT8_MAX))
        zp = F.lit(float(INT8_MAX)) - F.try_divide(F.lit(mx), scale)
        v = F.try_divide(F.col(c).cast("double"), scale) + zp
        return F.when(scale == 0, F.lit(None)).otherwise(v).cast("tinyint")

    cs = set(cols)
    return df.select(*[q(c).alias(c) if c in cs else F.col(c) for c in df.columns])


def normalize_splits(df: DataFrame, cols: Sequence[str], split_col: str = "split",
                     train_value: str = "train", method: str = "z_score_std",
                     clip_value: float = 0, dtype: str = "float64") -> DataFrame:
    """Scale all splits with statistics of the training rows: fit on train,
    transform the split-tagged frame in one projection, optional symmetric clip
    (when ``clip_value != 0``), then cast."""
    if dtype not in ("float64", "float32"):
        raise ValueError(f"unsupported type {dtype!r}")
    model = Normalizer(method).fit(df.filter(F.col(split_col) == train_value), cols)
    out = model.transform(df, cols)
    if clip_value != 0:
        out = clip(out, cols, -abs(clip_value), abs(clip_value))
    t = "double" if dtype == "float64" else "float"
    cs = set(cols)
    return out.select(*[F.col(c).cast(t).alias(c) if c in cs else F.col(c) for c in out.columns])


# ---------------------------------------------------------------------------
# Label index and one-hot.
# ---------------------------------------------------------------------------

def fit_label_index(train: DataFrame, label_col: str = "label"):
    """Sorted distinct labels -> 0, 1, 2 ... fitted on the training rows only.

    Returns a ``StringIndexerModel``; ``.labels`` is the inverse mapping.
    """
    from pyspark.ml.feature import StringIndexer
    return StringIndexer(inputCol=label_col, outputCol="_label_idx",
                         stringOrderType="alphabetAsc", handleInvalid="error").fit(train)


def apply_label_index(model, df: DataFrame, out_col: str = "label_idx") -> DataFrame:
    return (model.transform(df).withColumn(out_col, F.col("_label_idx").cast("int"))
            .drop("_label_idx"))


def index_to_label(model, df: DataFrame, idx_col: str, out_col: str) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in model.labels])
    return df.withColumn(out_col, F.element_at(labels, F.col(idx_col) + 1))


def one_hot(df: DataFrame, idx_col: str, n_classes: int, prefix: str = "class_") -> DataFrame:
    """One 0/1 column per class (all classes kept)."""
    return df.select("*", *[(F.col(idx_col) == i).cast("int").alias(f"{prefix}{i}")
                            for i in range(n_classes)])
