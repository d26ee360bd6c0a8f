"""Approximate nearest neighbours by random-projection hash tables.

Each of ``tables`` hash tables parts the space by ``bits`` hyperplanes through the mean of
the training rows; a row's bucket is the side it is on of each.  A test row also looks into
the ``probes`` buckets beyond the hyperplanes nearest to it.  Rows that meet in a bucket
are compared exactly, and the best ``k`` of all tables are kept.  ``bits`` follows the
number of training rows, so that a bucket holds about ``bucket_rows`` of them; larger
buckets (a hot vector, say) are cut into pieces that every visiting test row is copied to,
so nothing is left out and no task gets more than a piece.  Work per test row is
``tables * (1 + probes)`` buckets, whatever the size of the training table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 512
#: Rows whose copies a task holds at a time.
PLACED_ROWS = 256


def _sides(x: np.ndarray, planes: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Signed distances (rows x tables x bits), summed one dimension at a time so that a
    row gets the same ones in whatever batch it stands."""
    out = np.zeros((len(x), planes.shape[1]))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - centre[j]) * planes[j]
    return out


def approximate_neighbours(train: DataFrame, test: DataFrame, k: int = 5, label: str = "label_idx",
                           features: str = "features", id_col: str = "id", tables: int = 12, probes: int = 3,
                           bucket_rows: int = BUCKET_ROWS, seed: int = 0) -> DataFrame:
    """``(test_id, train_id, dist2, nb_label, rank)`` as ``knn_candidates`` gives them, of the
    rows that share a bucket."""
    spark = train.sparkSession
    schema = "test_id long, train_id long, dist2 double, nb_label int"
    shape = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("d")).first()
    n, dim = shape["n"], shape["d"]
    if not n:
        return spark.createDataFrame([], schema + ", rank int")
    centre = np.array([v or 0.0 for v in train.agg(*[F.avg(F.get(features, F.lit(j))) for j in range(dim)]).first()])
    bits = max(0, math.ceil(math.log2(n / bucket_rows)))
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    sent = spark.sparkContext.broadcast((planes, centre))

    def buckets(x, probe):
        """(row, table, bucket) of every bucket of every row."""
        side = _sides(x, *sent.value).reshape(len(x), tables, bits)
        code = ((side > 0).astype(np.int64) << np.arange(bits)).sum(axis=2)
        found = [code]
        if probe and bits:
            near = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, :min(probe, bits)]
            found += [code ^ (np.int64(1) << near[:, :, i]) for i in range(near.shape[2])]
        every = np.stack(found, axis=2)  # rows x tables x looks
        row, table, _ = np.indices(every.shape)
        return row.ravel(), table.ravel().astype(np.int32), every.ravel()

    def placed(probe, columns):
        def run(it):
            for whole in it:
                # a few rows at a time: each is copied to all of its buckets
                for a in range(0, len(whole), PLACED_ROWS):
                    pdf = whole.iloc[a:a + PLACED_ROWS]
                    row, table, code = buckets(np.stack(pdf["x"].to_numpy()).astype(np.float64), probe)
                    yield pdf.iloc[row].assign(t=table, b=code)[[*columns, "t", "b"]]
        return run

    tr = train.select(F.col(id_col).cast("long").alias("train_id"), F.col(label).cast("int").alias("nb_label"),
                      F.col(features).cast("array<double>").alias("x")).mapInPandas(
        placed(0, ["train_id", "nb_label", "x"]), "train_id long, nb_label int, x array<double>, t int, b long")
    te = test.select(F.col(id_col).cast("long").alias("test_id"), F.col(features).cast("array<double>").alias("x")) \
        .mapInPandas(placed(probes, ["test_id", "x"]), "test_id long, x array<double>, t int, b long")
    # buckets of more than twice the wanted size are cut; there are at most n / bucket_rows a table
    large = tr.groupBy(F.col("t").alias("lt"), F.col("b").alias("lb")).agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") > 2 * bucket_rows).select("lt", "lb", F.ceil(F.col("n") / bucket_rows).cast("int").alias("pieces"))

    def with_pieces(df, piece):
        return (df.join(large, (F.col("t") == F.col("lt")) & (F.col("b") == F.col("lb")), "left")
                .withColumn("piece", piece(F.coalesce("pieces", F.lit(1)))).drop("lt", "lb", "pieces"))

    tr = with_pieces(tr, lambda m: F.pmod(F.xxhash64("train_id"), m).cast("int"))
    te = with_pieces(te, lambda m: F.explode(F.sequence(F.lit(0), m - 1)))

    def local_topk(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"test_id": [], "train_id": [], "dist2": [], "nb_label": []})
        x, ids, lab = np.stack(t["x"].to_numpy()), t["train_id"].to_numpy(), t["nb_label"].to_numpy()
        out = []
        for a in range(0, len(q), 256):
            own = np.stack(q["x"].iloc[a:a + 256].to_numpy())
            d = np.zeros((len(own), len(x)))
            for j in range(x.shape[1]):
                diff = own[:, j, None] - x[None, :, j]
                d += diff * diff
            order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
            row = np.repeat(np.arange(len(own)), order.shape[1])
            out.append(pd.DataFrame({"test_id": q["test_id"].to_numpy()[a + row], "train_id": ids[order.ravel()],
                                     "dist2": d[row, order.ravel()], "nb_label": lab[order.ravel()]}))
        return pd.concat(out, ignore_index=True)

    met = te.groupBy("t", "b", "piece").cogroup(tr.groupBy("t", "b", "piece")).applyInPandas(local_topk, schema)
    w = Window.partitionBy("test_id").orderBy("dist2", "train_id")
    return met.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, recall): the part of the exact neighbours that were found."""
    hit = exact.select("test_id", "train_id").join(
        found.select("test_id", "train_id", F.lit(1).alias("hit")), ["test_id", "train_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_exact"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
