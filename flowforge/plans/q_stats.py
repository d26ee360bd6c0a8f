"""Statistics, scaling and label-encoding queries over ``lineitem``/``orders``.

Derived doubles are rounded to 6 digits on both sides: Spark and the oracle
sum in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.operators.profile import class_distribution as _class_distribution
from flowforge.operators.profile import column_stats as _column_stats
from flowforge.operators.profile import global_stats as _global_stats
from flowforge.operators.profile import histogram as _histogram
from flowforge.operators.profile import n_classes as _n_classes
from flowforge.operators.scaling import (Normalizer, apply_label_index, clip, fit_label_index,
                                         normalize_splits as _normalize_splits, one_hot, quantize)
from flowforge.plans.q_split import SPLIT_SQL, split_orders
from flowforge.plans.tables import table

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _r(df: DataFrame, cols) -> DataFrame:
    cs = set(cols)
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cs else F.col(c) for c in df.columns])


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE_COLS)


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_column_stats(_lineitem(spark, sf_dir), LINE_COLS), ["mean", "std", "q1", "q3"])


def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_global_stats(_lineitem(spark, sf_dir), LINE_COLS), ["mean", "std", "q1", "q3"])


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(_lineitem(spark, sf_dir), LINE_COLS, "z_score_std")


def _scaled(spark, sf_dir, method, per_column=True):
    li = _lineitem(spark, sf_dir)
    return _r(Normalizer(method, per_column).fit_transform(li, LINE_COLS), LINE_COLS)


def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "min_max_scaling")


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "z_score_std")


def robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "robust_scaling")


def minmax_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, "min_max_scaling", per_column=False)


def clip_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir)
    z = Normalizer("z_score_std").fit_transform(li, LINE_COLS)
    return _r(clip(z, LINE_COLS, -1.0, 1.0), LINE_COLS)


def quantize_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem(spark, sf_dir)
    model = Normalizer("min_max_scaling").fit(li, LINE_COLS)
    return quantize(li, LINE_COLS, model)


def normalize_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_orders(spark, sf_dir).select("o_orderkey", "split", "o_totalprice",
                                           F.col("o_custkey").cast("double").alias("o_custkey"))
    out = _normalize_splits(s, ["o_totalprice", "o_custkey"], "split", "train",
                            "z_score_std", clip_value=0, dtype="float64")
    return _r(out, ["o_totalprice", "o_custkey"])


def _status(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _status(spark, sf_dir)
    return apply_label_index(fit_label_index(o), o)


def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _status(spark, sf_dir)
    model = fit_label_index(o)
    return one_hot(apply_label_index(model, o), "label_idx", len(model.labels)).drop("label")


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _class_distribution(label_index(spark, sf_dir), "label_idx")


def n_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n_classes(_status(spark, sf_dir), "label")


QUERIES = {
    "column_stats": column_stats,
    "global_stats": global_stats,
    "histogram": histogram,
    "minmax": minmax,
    "minmax_global": minmax_global,
    "zscore": zscore,
    "robust": robust,
    "clip": clip_zscore,
    "quantize": quantize_int8,
    "normalize_splits": normalize_splits,
    "label_index": label_index,
    "onehot": onehot,
    "class_distribution": class_distribution,
    "n_classes": n_classes,
}


def _stats_sql(col: str) -> str:
    return (f"SELECT '{col}' AS \"column\", CAST(min({col}) AS DOUBLE) AS min, "
            f"CAST(max({col}) AS DOUBLE) AS max, round(avg({col}), 6) AS mean, "
            f"round(stddev_pop({col}), 6) AS std, "
            f"round(quantile_cont(CAST({col} AS DOUBLE), 0.25), 6) AS q1, "
            f"round(quantile_cont(CAST({col} AS DOUBLE), 0.75), 6) AS q3 FROM lineitem")


_STATS = " UNION ALL ".join(_stats_sql(c) for c in LINE_COLS)
_ST = ("st AS (SELECT " + ", ".join(
    f"min({c}) AS mn_{c}, max({c}) AS mx_{c}, avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}, "
    f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in LINE_COLS)
    + " FROM lineitem)")


def _per_col(expr_of) -> str:
    return f"WITH {_ST} SELECT " + ", ".join(
        f"round({expr_of(c)}, 6) AS {c}" for c in LINE_COLS) + " FROM lineitem, st"


def _hist_sql(col: str) -> str:
    edges = [-1000, -4, -3, -2, -1, 0, 1, 2, 3, 4, 1000]
    whens = " ".join(
        f"WHEN v >= {edges[i]} AND v {'<=' if i == len(edges) - 2 else '<'} {edges[i + 1]} THEN {i}"
        for i in range(len(edges) - 1))
    return f"SELECT '{col}' AS \"column\", CASE {whens} END AS bin FROM (SELECT CAST({col} AS DOUBLE) AS v FROM lineitem)"


_ALL = "all_v AS (" + " UNION ALL ".join(f"SELECT CAST({c} AS DOUBLE) AS v FROM lineitem" for c in LINE_COLS) + ")"

ORACLE = {
    "column_stats": _STATS,
    "global_stats": f"""
WITH {_ALL}
SELECT '__all__' AS "column", min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean,
       round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS q1,
       round(quantile_cont(v, 0.75), 6) AS q3
FROM all_v
""",
    "histogram": "SELECT \"column\", bin, count(*) AS count FROM (" + " UNION ALL ".join(
        _hist_sql(c) for c in LINE_COLS) + ") WHERE bin IS NOT NULL GROUP BY \"column\", bin",
    "minmax": _per_col(lambda c: f"({c} - mn_{c}) / CASE WHEN mx_{c} - mn_{c} = 0 THEN 1 ELSE mx_{c} - mn_{c} END"),
    "minmax_global": f"""
WITH {_ALL}, g AS (SELECT min(v) AS mn, max(v) AS mx FROM all_v)
SELECT """ + ", ".join(f"round(({c} - mn) / CASE WHEN mx - mn = 0 THEN 1 ELSE mx - mn END, 6) AS {c}"
                       for c in LINE_COLS) + " FROM lineitem, g",
    "zscore": _per_col(lambda c: f"({c} - mean_{c}) / NULLIF(sd_{c}, 0)"),
    "robust": _per_col(lambda c: f"({c} - q1_{c}) / CASE WHEN q3_{c} - q1_{c} = 0 THEN 1 ELSE q3_{c} - q1_{c} END"),
    "clip": _per_col(lambda c: f"CASE WHEN ({c} - mean_{c}) / NULLIF(sd_{c}, 0) < -1 THEN -1 "
                                f"WHEN ({c} - mean_{c}) / NULLIF(sd_{c}, 0) > 1 THEN 1 "
                                f"ELSE ({c} - mean_{c}) / NULLIF(sd_{c}, 0) END"),
    "quantize": f"WITH {_ST} SELECT " + ", ".join(
        f"CAST(trunc(CAST({c} AS DOUBLE) / ((mx_{c} - mn_{c}) / 254.0) + (127.0 - mx_{c} / ((mx_{c} - mn_{c}) / 254.0))) AS TINYINT) AS {c}"
        for c in LINE_COLS) + " FROM lineitem, st",
    "normalize_splits": f"""
WITH {SPLIT_SQL},
tr AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1,
              avg(CAST(o_custkey AS DOUBLE)) AS m2, stddev_pop(CAST(o_custkey AS DOUBLE)) AS s2
       FROM split WHERE split = 'train')
SELECT o_orderkey, split, round((o_totalprice - m1) / NULLIF(s1, 0), 6) AS o_totalprice,
       round((CAST(o_custkey AS DOUBLE) - m2) / NULLIF(s2, 0), 6) AS o_custkey
FROM split, tr
""",
    "label_index": """
SELECT o_orderkey, o_orderstatus AS label,
       CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS label_idx
FROM orders
""",
    "onehot": """
WITH ix AS (SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS label_idx FROM orders)
SELECT o_orderkey, label_idx,
       CAST(label_idx = 0 AS INTEGER) AS class_0, CAST(label_idx = 1 AS INTEGER) AS class_1,
       CAST(label_idx = 2 AS INTEGER) AS class_2
FROM ix
""",
    "class_distribution": """
SELECT CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS label_idx, count AS count
FROM (SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY o_orderstatus)
""",
    "n_classes": "SELECT count(DISTINCT o_orderstatus) AS n_classes FROM orders",
}
