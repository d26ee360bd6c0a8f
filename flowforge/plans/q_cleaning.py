"""Class counts, cleaning and projection queries over ``orders``.

The shared tables hold no blanks or missing values, so each query derives
them with a fixed expression (the same one in its SQL oracle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.operators.cleaning import (cast_rate_columns, class_rows, drop_outliers,
                                          infinity_tokens_to_null, remove_empty_lines,
                                          validate_labels)
from flowforge.operators.profile import class_counts as _class_counts
from flowforge.operators.profile import null_counts as _null_counts
from flowforge.operators.profile import type_list as _type_list
from flowforge.operators.projection import (canonical_labels, cast_all, drop_columns,
                                            rename_by_position, select_label)
from flowforge.operators.split import append_by_name as _append
from flowforge.plans.tables import table


def _orders(spark, sf_dir, *cols):
    return table(spark, sf_dir, "orders").select(*cols)


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir, F.col("o_orderstatus").alias("label"))
    return _class_counts(o, "label")


def type_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir, F.col("o_orderstatus").alias("label"))
    return _type_list(o, "label")


def _with_blanks(spark, sf_dir):
    return _orders(
        spark, sf_dir,
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), F.lit(""))
         .otherwise(F.col("o_orderkey").cast("string")).alias("flow_id"),
        F.col("o_orderstatus").alias("label"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(""))
         .otherwise(F.col("o_orderpriority")).alias("priority"),
        F.col("o_totalprice"))


def clean_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_empty_lines(_with_blanks(spark, sf_dir), "flow_id")


def _with_defects(spark, sf_dir):
    prio, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    rate = (F.when((prio == "1-URGENT") & (st == "F"), F.lit("Infinity"))
            .when((prio == "2-HIGH") & (st == "O"), F.lit("-Infinity"))
            .when((prio == "2-HIGH") & (st == "P"), F.lit("+Infinity"))
            .otherwise(F.col("o_totalprice").cast("string")))
    amount = (F.when((prio == "3-MEDIUM") & (st == "P"), F.lit(None).cast("double"))
              .when((prio == "4-NOT SPECIFIED") & (st == "F"), F.lit(float("inf")))
              .otherwise(F.col("o_totalprice")))
    return _orders(spark, sf_dir, F.col("o_orderkey").alias("flow_id"), st.alias("label"),
                   rate.alias("flow_byte_per_s"), amount.alias("amount"))


def clean_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cast_rate_columns(drop_outliers(_with_defects(spark, sf_dir)))


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _null_counts(infinity_tokens_to_null(_with_defects(spark, sf_dir)))


def rename_drop_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                "o_orderdate", "o_orderpriority")
    o = rename_by_position(o, ["key", "customer", "status", "price", "date", "priority"])
    o = drop_columns(o, ["status", "date", "priority"])
    return cast_all(o, "float32")


# Original priority names -> canonical names; 5-LOW has none and keeps its own.
PRIORITY_NAMES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium",
                  "4-NOT SPECIFIED": "unspecified"}


def canonical_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir, "o_orderkey", F.col("o_orderpriority").alias("label"))
    return canonical_labels(o, PRIORITY_NAMES)


def picked_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status picked as label in place of the priority, counted by priority name."""
    o = _orders(spark, sf_dir, F.col("o_orderpriority").alias("label"), "o_orderstatus", "o_orderkey")
    both = canonical_labels(o, PRIORITY_NAMES).withColumn("priority", F.col("label"))
    return select_label(both, "o_orderstatus").groupBy("priority", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


def class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir, "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("label"))
    return class_rows(o, "F")


def label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir, "o_orderkey",
                F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "O"),
                       F.lit(None)).otherwise(F.col("o_orderstatus")).alias("label"))
    return validate_labels(o, ["F", "O", "P"])


def append_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    first = o.filter(F.col("o_orderstatus") == "F")
    rest = o.filter(F.col("o_orderstatus") != "F").select(
        "o_totalprice", "o_orderstatus", "o_custkey", "o_orderkey")
    return _append(first, rest)


QUERIES = {
    "class_counts": class_counts,
    "type_list": type_list,
    "clean_empty": clean_empty,
    "clean_missing": clean_missing,
    "null_counts": null_counts,
    "rename_drop_cast": rename_drop_cast,
    "canonical_label": canonical_label,
    "picked_label": picked_label,
    "class_filter": class_filter,
    "label_check": label_check,
    "append_by_name": append_by_name,
}

_DEFECTS = """
defects AS (
  SELECT o_orderkey AS flow_id, o_orderstatus AS label,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'Infinity'
         WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'O' THEN '-Infinity'
         WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN '+Infinity'
         ELSE CAST(o_totalprice AS VARCHAR) END AS flow_byte_per_s,
    CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN NULL
         WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'inf'::DOUBLE
         ELSE o_totalprice END AS amount
  FROM orders),
nulled AS (
  SELECT flow_id, label,
         CASE WHEN flow_byte_per_s IN ('+Infinity', '-Infinity', 'Infinity') THEN NULL
              ELSE flow_byte_per_s END AS flow_byte_per_s,
         amount
  FROM defects)
"""

ORACLE = {
    "class_counts": """
SELECT o_orderstatus AS label, count(*) AS count FROM orders
WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus
""",
    "type_list": """
SELECT label, row_number() OVER (ORDER BY count DESC, label) AS position
FROM (SELECT o_orderstatus AS label, count(*) AS count FROM orders
      WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus)
""",
    "clean_empty": """
SELECT flow_id, label, NULLIF(priority, '') AS priority, o_totalprice
FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN ''
                  ELSE CAST(o_orderkey AS VARCHAR) END AS flow_id,
             o_orderstatus AS label,
             CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderpriority END AS priority,
             o_totalprice
      FROM orders)
WHERE NULLIF(flow_id, '') IS NOT NULL
""",
    "clean_missing": f"""
WITH {_DEFECTS}
SELECT flow_id, label, TRY_CAST(flow_byte_per_s AS DOUBLE) AS flow_byte_per_s, amount
FROM nulled
WHERE flow_id IS NOT NULL AND label IS NOT NULL AND flow_byte_per_s IS NOT NULL
  AND amount IS NOT NULL AND NOT isnan(amount)
""",
    "null_counts": f"""
WITH {_DEFECTS}
SELECT * FROM (
  SELECT 'flow_id' AS "column", count(*) FILTER (WHERE flow_id IS NULL) AS n_missing FROM nulled
  UNION ALL SELECT 'label', count(*) FILTER (WHERE label IS NULL) FROM nulled
  UNION ALL SELECT 'flow_byte_per_s', count(*) FILTER (WHERE flow_byte_per_s IS NULL) FROM nulled
  UNION ALL SELECT 'amount', count(*) FILTER (WHERE amount IS NULL) FROM nulled)
WHERE n_missing > 0
""",
    "rename_drop_cast": """
SELECT CAST(o_orderkey AS FLOAT) AS key, CAST(o_custkey AS FLOAT) AS customer,
       CAST(o_totalprice AS FLOAT) AS price
FROM orders
""",
    "canonical_label": """
SELECT o_orderkey,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
            WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'unspecified'
            ELSE o_orderpriority END AS label
FROM orders
""",
    "picked_label": """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high'
            WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'unspecified'
            ELSE o_orderpriority END AS priority, o_orderstatus AS label,
       count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders GROUP BY 1, 2
""",
    "class_filter": """
SELECT o_orderkey, o_totalprice, o_orderstatus AS label FROM orders WHERE o_orderstatus = 'F'
""",
    "label_check": """
SELECT o_orderkey, label FROM (
  SELECT o_orderkey,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN NULL
              ELSE o_orderstatus END AS label
  FROM orders)
WHERE label IS NOT NULL
""",
    "append_by_name": """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'
UNION ALL BY NAME
SELECT o_totalprice, o_orderstatus, o_custkey, o_orderkey FROM orders WHERE o_orderstatus != 'F'
""",
}
