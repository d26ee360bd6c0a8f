"""Evaluation queries.  Orders: truth = status index (F=0 benign, O=1, P=2),
prediction = a fixed function of the row.  Embeddings: class probabilities
from all squared components, normalised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.operators.metrics import (argmax_prediction,
                                         binary_metrics as _binary_metrics, confusion as _confusion,
                                         dense_confusion as _dense_confusion, metric_rows, metric_table,
                                         prob_metrics as _prob_metrics,
                                         simplified_confusion as _simplified_confusion,
                                         split_metrics as _split_metrics)
from flowforge.operators.scaling import apply_label_index, fit_label_index
from flowforge.plans.q_split import SPLIT_SQL, split_orders
from flowforge.plans.tables import table

METRIC_COLS = ["TNR", "FPR", "Recall", "Precision", "Accuracy", "F1_score", "MCC"]


def _predict(df: DataFrame) -> DataFrame:
    idx = F.col("label_idx")
    prio, st = F.col("o_orderpriority"), F.col("label")
    pred = (F.when(prio == "1-URGENT", (idx + 1) % 3)
            .when((prio == "5-LOW") & (st == "P"), F.lit(0))
            .otherwise(idx))
    pred2 = (F.when(prio == "2-HIGH", (idx + 2) % 3)
             .when((prio == "4-NOT SPECIFIED") & (st == "F"), F.lit(1))
             .otherwise(idx))
    return df.withColumn("prediction", pred.cast("int")).withColumn("prediction_b", pred2.cast("int"))


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("label"))
    return _predict(apply_label_index(fit_label_index(o), o))


def _round(df, cols):
    cs = set(cols)
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cs else F.col(c) for c in df.columns])


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(scored_orders(spark, sf_dir))


def dense_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense_confusion(scored_orders(spark, sf_dir), 3)


def simplified_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simplified_confusion(scored_orders(spark, sf_dir))


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_binary_metrics(scored_orders(spark, sf_dir)), METRIC_COLS)


def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_orders(spark, sf_dir)
    a = metric_rows("rule_a", _binary_metrics(s, pred="prediction"), 0.0, 0.0)
    b = metric_rows("rule_b", _binary_metrics(s, pred="prediction_b"), 0.0, 0.0)
    return _round(metric_table(a.unionByName(b), ["rule_a", "rule_b"]), ["rule_a", "rule_b"])


def split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_orders(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    s = s.join(o, "o_orderkey")
    scored = _predict(apply_label_index(fit_label_index(s.filter(F.col("split") == "train")), s))
    return _round(_split_metrics(scored), METRIC_COLS)


#: Class c of the probability queries owns the vector positions c, c + 10, ... (from 0).
_CLASS_POSITIONS = [range(c, 64, 10) for c in range(10)]


def _class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities from a whole vector: each class's share of its squared length."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("int").alias("label_idx"),
        F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("sq"))
    mass = F.array(*[reduce(lambda a, b: a + b, [F.col("sq")[i] for i in at]) for at in _CLASS_POSITIONS])
    e = e.withColumn("mass", mass)
    total = F.aggregate("mass", F.lit(0.0), lambda acc, x: acc + x)
    return e.withColumn("total", total).select(
        "vec_id", "label_idx", F.transform("mass", lambda x: x / F.col("total")).alias("probability"))


def prob_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_prob_metrics(_class_probabilities(spark, sf_dir), "probability", "label_idx"),
                  ["loss", "accuracy"])


def prob_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction of every row from its probabilities."""
    return _class_probabilities(spark, sf_dir).select(
        "vec_id", "label_idx", argmax_prediction("probability").alias("prediction"))


def prob_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix from probabilities, all cells."""
    return _dense_confusion(prob_predictions(spark, sf_dir), 10)


QUERIES = {
    "confusion": confusion,
    "dense_confusion": dense_confusion,
    "simplified_confusion": simplified_confusion,
    "binary_metrics": binary_metrics,
    "metric_pivot": metric_pivot,
    "split_metrics": split_metrics,
    "prob_metrics": prob_metrics,
    "prob_predictions": prob_predictions,
    "prob_confusion": prob_confusion,
}

_MASS_SQL = "[" + ", ".join("+".join(f"sq[{i + 1}]" for i in at) for at in _CLASS_POSITIONS) + "]"
_PROB_SQL = f"""
mass AS (
  SELECT vec_id, CAST(label AS INTEGER) AS label_idx, {_MASS_SQL} AS m
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS sq
        FROM embeddings)),
p AS (SELECT vec_id, label_idx, list_transform(m, lambda x: x / list_sum(m)) AS probability FROM mass),
pred AS (SELECT vec_id, label_idx,
                CAST(list_position(probability, list_max(probability)) - 1 AS INTEGER) AS prediction FROM p)
"""

_SCORED = """
scored AS (
  SELECT o_orderkey, label_idx,
    CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN (label_idx + 1) % 3
              WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 0
              ELSE label_idx END AS INTEGER) AS prediction,
    CAST(CASE WHEN o_orderpriority = '2-HIGH' THEN (label_idx + 2) % 3
              WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 1
              ELSE label_idx END AS INTEGER) AS prediction_b
  FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS label_idx FROM orders))
"""


def _bin_sql(pred: str, src: str = "scored", group: str | None = None) -> str:
    g_sel = f"{group}, " if group else ""
    g_by = f" GROUP BY {group}" if group else ""
    return f"""
SELECT {g_sel}TP, FP, FN, TN,
  round(TN::DOUBLE / (TN + FP), 6) AS TNR,
  round(1.0 - TN::DOUBLE / (TN + FP), 6) AS FPR,
  round(TP::DOUBLE / (TP + FN), 6) AS Recall,
  round(TP::DOUBLE / (TP + FP), 6) AS Precision,
  round((TP + TN)::DOUBLE / (TP + TN + FP + FN), 6) AS Accuracy,
  round(2.0 * (TP::DOUBLE / (TP + FP)) * (TP::DOUBLE / (TP + FN))
        / ((TP::DOUBLE / (TP + FP)) + (TP::DOUBLE / (TP + FN))), 6) AS F1_score,
  round(CASE WHEN TP + FP > 0 AND TP + FN > 0 AND TN + FP > 0 AND TN + FN > 0
        THEN (TP::DOUBLE * TN - FP::DOUBLE * FN) / sqrt(TP + FP) / sqrt(TP + FN)
             / sqrt(TN + FP) / sqrt(TN + FN) ELSE 0 END, 6) AS MCC
FROM (SELECT {g_sel}
        count(*) FILTER (WHERE label_idx <> 0 AND {pred} <> 0) AS TP,
        count(*) FILTER (WHERE label_idx = 0 AND {pred} <> 0) AS FP,
        count(*) FILTER (WHERE label_idx <> 0 AND {pred} = 0) AS FN,
        count(*) FILTER (WHERE label_idx = 0 AND {pred} = 0) AS TN
      FROM {src}{g_by})
"""


_METRIC_NAMES = ["TP", "FP", "FN", "TN", "TNR", "FPR", "Recall", "Precision", "Accuracy",
                 "F1_score", "MCC"]

ORACLE = {
    "confusion": f"WITH {_SCORED} SELECT label_idx, prediction, count(*) AS n FROM scored GROUP BY 1, 2",
    "dense_confusion": f"""
WITH {_SCORED}, grid AS (SELECT a.range::INTEGER AS label_idx, b.range::INTEGER AS prediction
                         FROM range(3) a, range(3) b),
c AS (SELECT label_idx, prediction, count(*) AS n FROM scored GROUP BY 1, 2)
SELECT g.label_idx, g.prediction, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN c ON c.label_idx = g.label_idx AND c.prediction = g.prediction
""",
    "simplified_confusion": f"""
WITH {_SCORED}
SELECT label_idx,
       count(*) FILTER (WHERE prediction = 0) AS pred_benign,
       count(*) FILTER (WHERE label_idx <> 0 AND prediction = label_idx) AS correct_attack,
       count(*) FILTER (WHERE prediction <> 0 AND prediction <> label_idx) AS other_attack
FROM scored GROUP BY label_idx
""",
    "binary_metrics": f"WITH {_SCORED} " + _bin_sql("prediction"),
    "metric_pivot": f"""
WITH {_SCORED}, a AS ({_bin_sql('prediction')}), b AS ({_bin_sql('prediction_b')}),
la AS (UNPIVOT (SELECT TP::DOUBLE AS TP, FP::DOUBLE AS FP, FN::DOUBLE AS FN, TN::DOUBLE AS TN,
                TNR, FPR, Recall, Precision, Accuracy, F1_score, MCC,
                0.0::DOUBLE AS "Training time", 0.0::DOUBLE AS "Prediction time" FROM a)
       ON COLUMNS(*) INTO NAME metric VALUE rule_a),
lb AS (UNPIVOT (SELECT TP::DOUBLE AS TP, FP::DOUBLE AS FP, FN::DOUBLE AS FN, TN::DOUBLE AS TN,
                TNR, FPR, Recall, Precision, Accuracy, F1_score, MCC,
                0.0::DOUBLE AS "Training time", 0.0::DOUBLE AS "Prediction time" FROM b)
       ON COLUMNS(*) INTO NAME metric VALUE rule_b)
SELECT la.metric, round(la.rule_a, 6) AS rule_a, round(lb.rule_b, 6) AS rule_b
FROM la JOIN lb USING (metric)
""",
    "split_metrics": f"""
WITH {SPLIT_SQL},
s2 AS (SELECT s.*, o.o_orderpriority, o.o_orderstatus,
              CAST(dense_rank() OVER (ORDER BY s.label) - 1 AS INTEGER) AS label_idx
       FROM split s JOIN orders o USING (o_orderkey)),
scored AS (
  SELECT split, label_idx,
    CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN (label_idx + 1) % 3
              WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 0
              ELSE label_idx END AS INTEGER) AS prediction
  FROM s2)
""" + _bin_sql("prediction", "scored", "split"),
    "prob_metrics": f"""
WITH {_PROB_SQL}
SELECT round(avg(-ln(greatest(probability[label_idx + 1], 1e-7))), 6) AS loss,
       round(avg(CAST(list_position(probability, list_max(probability)) - 1 = label_idx AS DOUBLE)), 6) AS accuracy,
       count(*) AS n
FROM p
""",
    "prob_predictions": f"WITH {_PROB_SQL} SELECT vec_id, label_idx, prediction FROM pred",
    "prob_confusion": f"""
WITH {_PROB_SQL}
SELECT CAST(t.range AS INTEGER) AS label_idx, CAST(q.range AS INTEGER) AS prediction,
       (SELECT count(*) FROM pred WHERE pred.label_idx = t.range AND pred.prediction = q.range) AS n
FROM range(10) t, range(10) q
""",
}
