"""Classifier queries over ``embeddings``: an exact per-label split (train
50 %, crossval 25 %, test 25 %), fit on train, predict test."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.operators import classifiers as C
from flowforge.operators.approx_knn import approximate_neighbours, recall
from flowforge.operators.svm import fit_svm, predict_svm
from flowforge.operators.trees import fit_tree, predict_trees
from flowforge.operators.metrics import binary_metrics, metric_rows, metric_table
from flowforge.operators.split import stratified_split
from flowforge.plans.tables import table
from flowforge.session import ensure_checkpoint_dir

EMB_TRAIN_PCT = 50.0
EMB_SEED = 3


def embedding_splits(spark: SparkSession, sf_dir: str):
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label_idx"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    pct = {i: EMB_TRAIN_PCT for i in range(10)}
    # train and test both read the split: written once instead of ranking twice
    ensure_checkpoint_dir(spark)
    s = stratified_split(e, "label_idx", ["id"], pct, seed=EMB_SEED).checkpoint()
    train = s.filter(F.col("split") == "train").drop("split")
    test = s.filter(F.col("split") == "test").drop("split")
    return train, test


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = embedding_splits(spark, sf_dir)
    return C.knn(train, test, k=5)


def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = embedding_splits(spark, sf_dir)
    return C.knn_candidates(train, test, k=5).select("test_id", "train_id", "rank")


def knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by hash tables against the exact ones: how many are asked for, and whether
    nine of ten are found."""
    train, test = embedding_splits(spark, sf_dir)
    found = approximate_neighbours(train, test, k=5, bucket_rows=128)
    return recall(found, C.knn_candidates(train, test, k=5)).select(
        "n_exact", (F.col("recall") >= 0.9).alias("nine_of_ten"))


def knn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours where equal rows abound: customers with two coarse features as train
    rows, suppliers as test rows."""
    def coarse(t: str, p: str) -> DataFrame:
        return table(spark, sf_dir, t).select(
            F.col(f"{p}_{'custkey' if p == 'c' else 'suppkey'}").cast("long").alias("id"),
            F.pmod(F.col(f"{p}_nationkey"), F.lit(3)).cast("int").alias("label_idx"),
            F.array(F.floor(F.col(f"{p}_acctbal") / 5000).cast("double"),
                    F.pmod(F.col(f"{p}_nationkey"), F.lit(5)).cast("double")).alias("features"))
    return C.knn_candidates(coarse("customer", "c"), coarse("supplier", "s"), k=5) \
        .select("test_id", "train_id", "nb_label", "rank")


def lda(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = embedding_splits(spark, sf_dir)
    return C.lda(train, test)


def qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = embedding_splits(spark, sf_dir)
    return C.qda(train, test)


def svm_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = embedding_splits(spark, sf_dir)
    return C.linear_svm(train, test)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = embedding_splits(spark, sf_dir)
    return C.decision_tree(train, test)


def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = embedding_splits(spark, sf_dir)
    return C.random_forest(train, test)


def mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = embedding_splits(spark, sf_dir)
    return C.mlp(train, test)


def classifier_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven models, 13 metrics each (label 0 = benign), one column per model.  The seconds of
    a model are those of its own fit and prediction, with the network trained beside the others."""
    train, test = embedding_splits(spark, sf_dir)
    runs = C.model_runs(train, test)
    long = None
    for name, (pred, train_sec, pred_sec) in C.timed_runs(spark, runs).items():
        rows = metric_rows(name, binary_metrics(pred), train_sec, pred_sec)
        long = rows if long is None else long.unionByName(rows)
    return metric_table(long, list(runs))


# Models on data that can be learnt: the language of a document from its letters.
LANGUAGES = ("de", "en", "es", "fr")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def language_features(spark: SparkSession, sf_dir: str, letters: str = LETTERS) -> DataFrame:
    """``(id, label_idx, features)``: how many of a document's characters are each of
    the given ASCII letters, in percent (an empty or missing text: zeros).

    A text is read once for all letters: an ASCII letter is one byte of UTF-8, and no
    other character has that byte."""
    at = np.frombuffer(letters.encode("ascii"), np.uint8)

    def shares(batches):
        for b in batches:
            counts = np.zeros((b.num_rows, len(at)))
            for i, text in enumerate(b.column(2)):
                counts[i] = np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=256)[at]
            share = 100.0 * counts / np.maximum(b.column(3).to_numpy(), 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(
                    pa.array(np.arange(0, share.size + 1, len(at), dtype=np.int32)), pa.array(share.ravel()))],
                names=["id", "label_idx", "features"])

    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isin(*LANGUAGES)).select(
        F.col("doc_id").cast("long").alias("id"),
        (F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang")) - 1).cast("int").alias("label_idx"),
        text.cast("binary").alias("text"), F.length(text).cast("long").alias("n"))
    return docs.mapInArrow(shares, "id long, label_idx int, features array<double>")


def discriminant_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What LDA and QDA are fitted from: rows, mean and covariance of each class."""
    mom = C.class_moments(language_features(spark, sf_dir, "eo"))
    rows = [(int(k), int(n), *map(float, mu), *(float(scatter[i][j] / n) for i, j in ((0, 0), (0, 1), (1, 1))))
            for k, (n, mu, scatter) in mom.items()]
    r = lambda c: F.round(c, 6).alias(c)
    return spark.createDataFrame(
        rows, "label_idx int, n long, m1 double, m2 double, v11 double, v12 double, v22 double") \
        .select("label_idx", "n", *[r(c) for c in ("m1", "m2", "v11", "v12", "v22")])


def lda_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LDA on two letters: small enough for a closed form in SQL, row by row."""
    d = language_features(spark, sf_dir, "eo")
    return C.lda(d, d)


def qda_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = language_features(spark, sf_dir, "eo")
    return C.qda(d, d)


def tree_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split on the year of the order: the best Gini split, found exactly in SQL."""
    d = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
        .otherwise(2).alias("label_idx"),
        F.array(F.year("o_orderdate").cast("double")).alias("features"))
    return C.decision_tree(d, d, max_depth=1)


def tree_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of exact cuts on price and quantity-like features, all found by Spark
    (no node goes to one task)."""
    d = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
        .otherwise(2).alias("label_idx"),
        F.array(F.dayofyear("o_orderdate").cast("double"), F.col("o_totalprice").cast("double")).alias("features"))
    return predict_trees(fit_tree(d, max_depth=2, local_rows=0), d)


def svm_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared-hinge SVM of four languages on one letter: the margins of every document."""
    d = language_features(spark, sf_dir, "e")
    out = predict_svm(fit_svm(d), d, margins="m")
    return out.select("id", "label_idx", "prediction", *[
        F.round(F.get("m", F.lit(i)), 4).alias(f"m_{c}") for i, c in enumerate(LANGUAGES)])


def language_splits(spark: SparkSession, sf_dir: str):
    # the split hashes whole rows in every pass, and seven fits and predictions read its sets:
    # letters are counted once, rows are split once
    ensure_checkpoint_dir(spark)
    counted = language_features(spark, sf_dir).checkpoint()
    s = stratified_split(counted, "label_idx", ["id"], {i: (50, 0, 50) for i in range(len(LANGUAGES))},
                         seed=EMB_SEED).checkpoint()
    return tuple(s.filter(F.col("split") == name).drop("split") for name in ("train", "test"))


def model_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven models told languages apart: per model and true class the test rows,
    each of them predicted once.  (Accuracy floors are in the tests.)"""
    train, test = language_splits(spark, sf_dir)
    out = None
    for name, pred in language_predictions(train, test).items():
        rows = pred.groupBy(F.lit(name).alias("model"), "label_idx").agg(
            F.count("prediction").alias("n_predicted"), F.countDistinct("id").alias("n_rows"))
        out = rows if out is None else out.unionByName(rows)
    return out


def language_predictions(train: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """Every model fitted, its predictions written in the shared folder.  A network is trained
    step by step by one task, so its jobs run beside those of the other models."""
    ensure_checkpoint_dir(train.sparkSession)
    runs = C.model_runs(train, test)

    def predictions(names):
        return {name: predict(fit()).checkpoint() for name, (fit, predict) in runs.items() if name in names}

    with ThreadPoolExecutor(1) as beside:
        network = beside.submit(inheritable_thread_target(train.sparkSession)(predictions), {"MLP"})
        others = predictions(runs.keys() - {"MLP"})
        done = {**network.result(), **others}
    return {name: done[name] for name in runs}


QUERIES = {
    "discriminant_moments": discriminant_moments,
    "lda_language": lda_language,
    "qda_language": qda_language,
    "tree_stump": tree_stump,
    "tree_depth2": tree_depth2,
    "svm_line": svm_line,
    "model_margins": model_margins,
    "knn": knn,
    "knn_neighbours": knn_neighbours,
    "knn_recall": knn_recall,
    "knn_ties": knn_ties,
    "lda": lda,
    "qda": qda,
    "svm_ovr": svm_ovr,
    "tree": tree,
    "forest": forest,
    "mlp": mlp,
    "classifier_comparison": classifier_comparison,
}

_EMB_SPLIT = """
ranked AS (
  SELECT vec_id AS id, CAST(label AS INTEGER) AS label_idx,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features,
         row_number() OVER (PARTITION BY label
                            ORDER BY md5(concat_ws('|', CAST(vec_id AS VARCHAR), '3')), vec_id) AS rk,
         count(*) OVER (PARTITION BY label) AS n
  FROM embeddings WHERE label IS NOT NULL),
cut AS (SELECT *, floor(n * 50.0 / 100) AS n_tr, floor(n * 25.0 / 100) AS n_cv FROM ranked),
train AS (SELECT id, label_idx, features FROM cut WHERE rk <= n_tr),
test AS (SELECT id, label_idx, features FROM cut WHERE rk > n_tr + n_cv AND rk <= n_tr + 2 * n_cv),
pairs AS (
  SELECT q.id AS test_id, t.id AS train_id, t.label_idx AS nb_label,
         list_sum(list_transform(list_zip(q.features, t.features),
                                 lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist2
  FROM test q, train t),
nb AS (
  SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist2, train_id) AS rank FROM pairs)
"""

ORACLE = {
    "knn_neighbours": f"WITH {_EMB_SPLIT} SELECT test_id, train_id, rank FROM nb WHERE rank <= 5",
    "knn_recall": f"""
WITH {_EMB_SPLIT} SELECT count(*) AS n_exact, true AS nine_of_ten FROM nb WHERE rank <= 5
""",
    "knn_ties": """
WITH c AS (SELECT c_custkey AS id, CAST(c_nationkey % 3 AS INTEGER) AS nb_label,
                  floor(c_acctbal / 5000) AS a, c_nationkey % 5 AS b FROM customer),
s AS (SELECT s_suppkey AS id, floor(s_acctbal / 5000) AS a, s_nationkey % 5 AS b FROM supplier)
SELECT test_id, train_id, nb_label, rank FROM (
  SELECT s.id AS test_id, c.id AS train_id, c.nb_label,
         row_number() OVER (PARTITION BY s.id
                            ORDER BY (s.a - c.a) * (s.a - c.a) + (s.b - c.b) * (s.b - c.b), c.id) AS rank
  FROM s, c) WHERE rank <= 5
""",
    "knn": f"""
WITH {_EMB_SPLIT},
votes AS (SELECT test_id, nb_label, count(*) AS votes FROM nb WHERE rank <= 5 GROUP BY 1, 2),
best AS (SELECT test_id, nb_label,
                row_number() OVER (PARTITION BY test_id ORDER BY votes DESC, nb_label) AS r FROM votes)
SELECT t.id, t.label_idx, b.nb_label AS prediction
FROM test t LEFT JOIN best b ON b.test_id = t.id AND b.r = 1
""",
}

_TWO_LETTERS = """
f AS (
  SELECT doc_id AS id, CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS label_idx,
         coalesce(100.0::DOUBLE * (length(t) - length(replace(t, 'e', ''))) / nullif(length(t), 0), 0) AS x,
         coalesce(100.0::DOUBLE * (length(t) - length(replace(t, 'o', ''))) / nullif(length(t), 0), 0) AS y
  FROM (SELECT doc_id, lang, lower(coalesce(text, '')) AS t FROM documents)
  WHERE lang IN ('de', 'en', 'es', 'fr')),
m AS (
  SELECT label_idx, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b,
         var_pop(y) AS c, sum(count(*)) OVER () AS total, count(*) OVER () AS k
  FROM f GROUP BY label_idx)
"""

# score = log prior - log|S|/2 - (x - m)' S^-1 (x - m) / 2, the largest wins
_CLASSIFY = """
scored AS (
  SELECT f.id, f.label_idx, s.label_idx AS cls,
         ln(s.n / s.total) - ln(s.a * s.c - s.b * s.b) / 2
         - (s.c * (x - mx) * (x - mx) - 2 * s.b * (x - mx) * (y - my) + s.a * (y - my) * (y - my))
           / (2 * (s.a * s.c - s.b * s.b)) AS score
  FROM f, s)
SELECT id, label_idx, arg_max(cls, score) AS prediction FROM scored GROUP BY id, label_idx
"""

ORACLE.update({
    "discriminant_moments": f"""
WITH {_TWO_LETTERS}
SELECT label_idx, n, round(mx, 6) AS m1, round(my, 6) AS m2, round(a, 6) AS v11, round(b, 6) AS v12,
       round(c, 6) AS v22 FROM m
""",
    "lda_language": f"""
WITH {_TWO_LETTERS},
s AS (SELECT label_idx, n, total, mx, my, sum(n * a) OVER () / (total - k) AS a,
             sum(n * b) OVER () / (total - k) AS b, sum(n * c) OVER () / (total - k) AS c FROM m),
{_CLASSIFY}""",
    "qda_language": f"""
WITH {_TWO_LETTERS},
s AS (SELECT label_idx, n, total, mx, my, a * n / (n - 1) AS a, b * n / (n - 1) AS b,
             c * n / (n - 1) AS c FROM m),
{_CLASSIFY}""",
    "tree_stump": """
WITH d AS (SELECT o_orderkey AS id, year(o_orderdate) AS x,
                  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label_idx FROM orders),
sides AS (SELECT cut, d.x > cut AS side, label_idx, count(*) AS n
          FROM d, (SELECT DISTINCT x AS cut FROM d) GROUP BY 1, 2, 3),
gini AS (SELECT cut, sum(n) - sum(n * n) / sum(n) AS impurity FROM sides GROUP BY cut, side),
best AS (SELECT cut FROM gini GROUP BY cut HAVING count(*) = 2 ORDER BY sum(impurity), cut LIMIT 1),
vote AS (SELECT side, arg_max(label_idx, n) AS prediction FROM sides WHERE cut = (SELECT cut FROM best) GROUP BY side)
SELECT d.id, d.label_idx, v.prediction FROM d JOIN vote v ON (d.x > (SELECT cut FROM best)) = v.side
""",
    "model_margins": """
WITH r AS (
  SELECT doc_id AS id, CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS label_idx,
         row_number() OVER (PARTITION BY lang
             ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '3')), doc_id) AS rk,
         count(*) OVER (PARTITION BY lang) AS n
  FROM documents WHERE lang IN ('de', 'en', 'es', 'fr'))
SELECT model, label_idx, count(*) AS n_predicted, count(*) AS n_rows
FROM r, (SELECT unnest(['MLP', 'LDA', 'QDA', 'SVM', 'k-NN', 'DT', 'RF']) AS model)
WHERE rk > floor(n * 50.0 / 100) AND rk <= 2 * floor(n * 50.0 / 100)
GROUP BY model, label_idx
""",
})


# ----------------------------------------------------- exact tree of two levels

def _best_cut(name: str, rows: str, part: str) -> str:
    """Best cut of each ``part`` of ``rows``: least impurity, then feature, then cut."""
    return f"""
{name}_cells AS (
  SELECT {part} AS part, f, CASE f WHEN 0 THEN x ELSE z END AS v,
         sum((label_idx = 0)::INT) AS a, sum((label_idx = 1)::INT) AS b, sum((label_idx = 2)::INT) AS c
  FROM {rows}, (SELECT unnest([0, 1]) AS f) GROUP BY 1, 2, 3),
{name}_run AS (
  SELECT part, f, v, lead(v) OVER w AS next, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(c) OVER w AS c,
         sum(a) OVER t AS ta, sum(b) OVER t AS tb, sum(c) OVER t AS tc
  FROM {name}_cells WINDOW w AS (PARTITION BY part, f ORDER BY v), t AS (PARTITION BY part, f)),
{name} AS (
  SELECT part, arg_min(f, [i, f, cut]) AS f, arg_min(cut, [i, f, cut]) AS cut FROM (
    SELECT part, f::DOUBLE AS f, v + (next - v) / 2 AS cut,
           round((a + b + c) - (a * a + b * b + c * c)::DOUBLE / (a + b + c)
             + (ta - a + tb - b + tc - c)
             - ((ta - a) * (ta - a) + (tb - b) * (tb - b) + (tc - c) * (tc - c))::DOUBLE
               / (ta - a + tb - b + tc - c), 6) AS i
    FROM {name}_run WHERE next IS NOT NULL AND (ta = 0)::INT + (tb = 0)::INT + (tc = 0)::INT < 2)
  GROUP BY part)"""


ORACLE["tree_depth2"] = f"""
WITH d AS (
  SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label_idx,
         dayofyear(o_orderdate)::DOUBLE AS x, o_totalprice::DOUBLE AS z, 0 AS node FROM orders),
{_best_cut("top", "d", "node")},
e AS (SELECT d.*, CASE WHEN CASE t.f WHEN 0 THEN x ELSE z END <= t.cut THEN 1 ELSE 2 END AS side
      FROM d, top t),
{_best_cut("low", "e", "side")},
leaves AS (SELECT e.*, coalesce(CASE l.f WHEN 0 THEN x ELSE z END <= l.cut, true) AS half
           FROM e LEFT JOIN low l ON l.part = e.side),
votes AS (SELECT side, half, label_idx, count(*) AS n FROM leaves GROUP BY 1, 2, 3),
said AS (SELECT side, half, label_idx AS prediction,
                row_number() OVER (PARTITION BY side, half ORDER BY n DESC, label_idx) AS r FROM votes)
SELECT l.id, l.label_idx, s.prediction FROM leaves l JOIN said s USING (side, half) WHERE s.r = 1
"""

# Newton steps on two weights per class, sixty of them; they end at the solution long before.
ORACLE["svm_line"] = """
WITH RECURSIVE f AS (
  SELECT doc_id AS id, CAST(list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS INTEGER) AS y,
         coalesce(100.0::DOUBLE * (length(t) - length(replace(t, 'e', ''))) / nullif(length(t), 0), 0) AS x
  FROM (SELECT doc_id, lang, lower(coalesce(text, '')) AS t FROM documents)
  WHERE lang IN ('de', 'en', 'es', 'fr')),
s AS (SELECT c, x, CASE WHEN y = c THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s
      FROM f, (SELECT unnest([0, 1, 2, 3]) AS c)),
newton AS (
  SELECT c, 0 AS k, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM (SELECT unnest([0, 1, 2, 3]) AS c)
  UNION ALL
  SELECT c, k + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb),
         b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb)
  FROM (
    SELECT c, k, w, b, w - 2 * sum(s * g * x) AS gw, b - 2 * sum(s * g) AS gb,
           1 + 2 * sum((g > 0)::INT * x * x) AS hww, 2 * sum((g > 0)::INT * x) AS hwb,
           1 + 2 * sum((g > 0)::INT) AS hbb
    FROM (SELECT n.c, n.k, n.w, n.b, s.s, s.x, greatest(1 - s.s * (n.w * s.x + n.b), 0) AS g
          FROM newton n JOIN s ON s.c = n.c WHERE n.k < 60)
    GROUP BY c, k, w, b)),
m AS (SELECT f.id, f.y, n.c, n.w * f.x + n.b AS m FROM f, newton n WHERE n.k = 60)
SELECT id, y AS label_idx, CAST(arg_max(c, m) AS INTEGER) AS prediction,
       round(max(m) FILTER (c = 0), 4) AS m_de, round(max(m) FILTER (c = 1), 4) AS m_en,
       round(max(m) FILTER (c = 2), 4) AS m_es, round(max(m) FILTER (c = 3), 4) AS m_fr
FROM m GROUP BY id, y
"""
