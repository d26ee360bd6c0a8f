"""Split, head, subsample and constant-feature queries over ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.operators.profile import constant_features as _constant_features
from flowforge.operators.split import hash_rank
from flowforge.operators.split import head_percent as _head_percent
from flowforge.operators.split import split_sizes as _split_sizes
from flowforge.operators.split import stratified_split as _stratified_split
from flowforge.operators.split import subsamples as _subsamples
from flowforge.plans.tables import table

#: Training percentage per order status; crossval = test = half of it.
STATUS_TRAIN_PCT = {"F": 9.6941, "O": 37.3679, "P": 50.0}
SPLIT_SEED = 0


def split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderstatus").alias("label"))
    return _stratified_split(o, "label", ["o_orderkey"], STATUS_TRAIN_PCT, seed=SPLIT_SEED)


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_orders(spark, sf_dir).select("o_orderkey", "label", "split")


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_sizes(split_orders(spark, sf_dir), "label")


def head_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return _head_percent(o, 37.5, ["o_orderkey"])


def head_percent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head by a text column with missing values and many ties (priority), then the key."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("priority"))
    return _head_percent(o, 90.0, ["priority", "o_orderkey"], rows_per_bucket=1000)


def shuffle_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finished sets in shuffled order, the place in its set as a column."""
    s = split_orders(spark, sf_dir).select("o_orderkey", "label", "split")
    return hash_rank(s, ["split"], ["o_orderkey"], "shuffle") \
        .select("o_orderkey", "label", "split", F.col("_rank").alias("position"))


def subsamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return _subsamples(o, 3, ["o_orderkey"], seed=7)


def constant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_orders(spark, sf_dir)
    split = F.col("split")
    s = s.select(
        "split",
        F.lit(1.0).alias("const_all"),
        F.when(split == "train", F.lit(2.0)).when(split == "crossval", F.lit(0.0))
         .otherwise(F.lit(1.0)).alias("const_per_split"),
        F.when(split == "test", F.col("o_custkey").cast("double"))
         .otherwise(F.lit(5.0)).alias("const_two_splits"),
        F.lit(None).cast("double").alias("all_missing"),
        "o_totalprice", "label")
    return _constant_features(s, "split")


QUERIES = {
    "stratified_split": stratified_split,
    "split_sizes": split_sizes,
    "head_percent": head_percent,
    "head_percent_text": head_percent_text,
    "shuffle_sets": shuffle_sets,
    "subsamples": subsamples,
    "constant_features": constant_features,
}

SPLIT_SQL = """
ranked AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus AS label,
         row_number() OVER (PARTITION BY o_orderstatus
                            ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '0')), o_orderkey) AS rk,
         count(*) OVER (PARTITION BY o_orderstatus) AS n
  FROM orders WHERE o_orderstatus IS NOT NULL),
pct(label, p) AS (VALUES ('F', 9.6941::DOUBLE), ('O', 37.3679::DOUBLE), ('P', 50.0::DOUBLE)),
cuts AS (
  SELECT r.*, floor(n * p / 100) AS n_tr, floor(n * (p / 2) / 100) AS n_cv
  FROM ranked r JOIN pct USING (label)),
split AS (
  SELECT o_orderkey, o_custkey, o_totalprice, label,
         CASE WHEN rk <= n_tr THEN 'train' WHEN rk <= n_tr + n_cv THEN 'crossval'
              WHEN rk <= n_tr + 2 * n_cv THEN 'test' END AS split
  FROM cuts WHERE rk <= n_tr + 2 * n_cv)
"""

ORACLE = {
    "stratified_split": f"WITH {SPLIT_SQL} SELECT o_orderkey, label, split FROM split",
    "split_sizes": f"WITH {SPLIT_SQL} SELECT label, split, count(*) AS count FROM split GROUP BY label, split",
    "head_percent": """
SELECT o_orderkey, o_totalprice FROM (
  SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS rn,
         count(*) OVER () AS n FROM orders)
WHERE rn <= floor(n * 37.5::DOUBLE / 100)
""",
    "head_percent_text": """
SELECT o_orderkey, priority FROM (
  SELECT o_orderkey, priority, count(*) OVER () AS n,
         row_number() OVER (ORDER BY priority NULLS LAST, o_orderkey) AS rn
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS priority FROM orders))
WHERE rn <= floor(n * 90.0::DOUBLE / 100)
""",
    "shuffle_sets": f"""
WITH {SPLIT_SQL}
SELECT o_orderkey, label, split,
       row_number() OVER (PARTITION BY split
           ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), 'shuffle')), o_orderkey) AS position
FROM split
""",
    "subsamples": """
SELECT subset_id, o_orderkey FROM (
  SELECT t.subset_id, o.o_orderkey,
         row_number() OVER (PARTITION BY t.subset_id
             ORDER BY md5(concat_ws('|', CAST(o.o_orderkey AS VARCHAR), '7', CAST(t.subset_id AS VARCHAR))),
                      o.o_orderkey) AS rk,
         count(*) OVER (PARTITION BY t.subset_id) AS n
  FROM orders o, (SELECT range AS subset_id FROM range(1, 4)) t)
WHERE rk <= ceil(n / 3.0)
""",
    "constant_features": f"""
WITH {SPLIT_SQL},
s AS (
  SELECT split, 1.0::DOUBLE AS const_all,
         CASE WHEN split = 'train' THEN 2.0 WHEN split = 'crossval' THEN 0.0 ELSE 1.0 END AS const_per_split,
         CASE WHEN split = 'test' THEN CAST(o_custkey AS DOUBLE) ELSE 5.0 END AS const_two_splits,
         CAST(NULL AS DOUBLE) AS all_missing, o_totalprice, label
  FROM split),
per AS (
  SELECT split,
         coalesce(min(const_all) = max(const_all), false) AS const_all,
         coalesce(min(const_per_split) = max(const_per_split), false) AS const_per_split,
         coalesce(min(const_two_splits) = max(const_two_splits), false) AS const_two_splits,
         coalesce(min(all_missing) = max(all_missing), false) AS all_missing,
         coalesce(min(o_totalprice) = max(o_totalprice), false) AS o_totalprice,
         coalesce(min(label) = max(label), false) AS label
  FROM s GROUP BY split)
SELECT "column" FROM (
  SELECT 'const_all' AS "column", bool_and(const_all) AS c, count(*) AS k FROM per
  UNION ALL SELECT 'const_per_split', bool_and(const_per_split), count(*) FROM per
  UNION ALL SELECT 'const_two_splits', bool_and(const_two_splits), count(*) FROM per
  UNION ALL SELECT 'all_missing', bool_and(all_missing), count(*) FROM per
  UNION ALL SELECT 'o_totalprice', bool_and(o_totalprice), count(*) FROM per
  UNION ALL SELECT 'label', bool_and(label), count(*) FROM per)
WHERE c AND k = 3
""",
}
