"""Classifiers: fit on the training rows, predict the test rows.

* decision tree and random forest (``trees``), linear SVM (``svm``) and the neural
  network (``network``) are fitted over training blocks dealt by row id;
* linear and quadratic discriminants are fitted from per-class sufficient
  statistics (count, sum, Gram matrix) summed with a grouped aggregation; only
  the ``k x d x d`` statistics reach the driver, and scoring is a vectorised
  ``mapInPandas`` with the fitted parameters in a broadcast variable;
* k-nearest neighbours is an exact blocked search: training rows are grouped round
  pivots, a test row visits only the groups that the triangle inequality cannot
  rule out, test and train blocks meet in a co-grouped pandas function that emits
  only its local top-k per test row, and a final per-row top-k and majority vote
  run as DataFrame operations.  Blocks grow with the rows, so that a row has a bounded number
  of copies up to the rows that a task holds.

Input frames carry a feature array column (``array<double>``), an integer
label column and an id column.
"""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowforge.operators.network import fit_network, predict_network
from flowforge.operators.svm import fit_svm, predict_svm
from flowforge.operators.trees import fit_forest, fit_tree, predict_trees
from flowforge.session import ensure_checkpoint_dir

MODELS = ["MLP", "LDA", "QDA", "SVM", "k-NN", "DT", "RF"]


def features_array(cols, fill_null: float | None = None) -> F.Column:
    """Pack feature columns into one ``array<double>`` column.

    ``fill_null`` replaces missing values (after z-scoring, a zero-variance
    feature is NULL; 0 is its centred value and carries no information)."""
    if fill_null is None:
        return F.array(*[F.col(c).cast("double") for c in cols])
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float(fill_null))) for c in cols])


# ---------------------------------------------------------------------------
# Iterative models (see svm.py, trees.py and network.py)
# ---------------------------------------------------------------------------

def decision_tree(train, test, label="label_idx", features="features", id_col="id", **settings):
    return predict_trees(fit_tree(train, label, features, id_col, **settings), test, label, features, id_col)


def random_forest(train, test, label="label_idx", features="features", id_col="id", **settings):
    return predict_trees(fit_forest(train, label, features, id_col, **settings), test, label, features, id_col)


def linear_svm(train, test, label="label_idx", features="features", id_col="id", **settings):
    return predict_svm(fit_svm(train, label, features, id_col, **settings), test, label, features, id_col)


def mlp(train, test, label="label_idx", features="features", id_col="id", **settings):
    return predict_network(fit_network(train, label, features, id_col, **settings), test, label, features, id_col)


# ---------------------------------------------------------------------------
# Discriminant analysis from sufficient statistics
# ---------------------------------------------------------------------------

#: Groups in which the partial moments of a class are added up first.
MERGE_GROUPS = 256


def class_moments(train: DataFrame, label="label_idx", features="features", d=None) -> dict:
    """Per class: n, mean (d), centred scatter (d x d), summed over partitions.

    All sums are taken about one training row, so a common offset of the features
    does not cancel the digits of the scatter.  Each partition reduces its rows to one
    array of ``1+d+d*d`` numbers per class; these are added up in two levels
    (``MERGE_GROUPS`` groups per class, then one), no training row is shuffled and
    one array per class reaches the driver.
    """
    first = train.select(features).first()
    if first is None:
        return {}
    origin = np.asarray(first[0], dtype=np.float64)

    def partials(it):
        acc = {}
        for pdf in it:
            if pdf.empty:
                continue
            x_all = np.stack(pdf[features].to_numpy()).astype(np.float64) - origin
            y_all = pdf[label].to_numpy()
            for cls in np.unique(y_all):
                x = x_all[y_all == cls]
                n, s, g = acc.get(cls, (0, 0.0, 0.0))
                acc[cls] = (n + len(x), s + x.sum(axis=0), g + x.T @ x)
        cls = sorted(acc)
        if cls:
            yield pd.DataFrame({"cls": np.array(cls, dtype=np.int64), "vals": [
                np.concatenate([[float(acc[c][0])], np.ravel(acc[c][1]), np.ravel(acc[c][2])]) for c in cls]})

    def add_up(pdf):
        total = np.sum(np.stack(pdf.sort_values("part")["vals"].to_numpy()), axis=0)
        return pd.DataFrame({"cls": pdf["cls"].iloc[:1], "part": pdf["part"].min(), "vals": [total]})

    schema = "cls long, part int, vals array<double>"
    sums = (train.select(label, features).mapInPandas(partials, "cls long, vals array<double>")
            .select("cls", F.spark_partition_id().alias("part"), "vals")
            .groupBy("cls", (F.col("part") % MERGE_GROUPS).alias("g")).applyInPandas(add_up, schema)
            .groupBy("cls").applyInPandas(add_up, schema))
    out = {}
    for r in sums.collect():
        cls, arr = int(r["cls"]), np.array(r["vals"])
        dd = int(round((-1 + math.sqrt(1 + 4 * (len(arr) - 1))) / 2))
        n, total, gram = arr[0], arr[1:1 + dd], arr[1 + dd:].reshape(dd, dd)
        out[cls] = (n, origin + total / n, gram - np.outer(total, total) / n)
    return out


@dataclass
class DiscriminantModel:
    classes: np.ndarray
    kind: str
    params: dict


def fit_lda(train, label="label_idx", features="features") -> DiscriminantModel:
    mom = class_moments(train, label, features)
    classes = np.array(sorted(mom))
    n_tot = sum(mom[c][0] for c in classes)
    mus = np.array([mom[c][1] for c in classes])
    cov = sum(mom[c][2] for c in classes) / max(n_tot - len(classes), 1)
    inv = np.linalg.pinv(cov)
    priors = np.array([mom[c][0] / n_tot for c in classes])
    center = priors @ mus  # scores are taken about it, so that large offsets keep their digits
    mus = mus - center
    w = inv @ mus.T
    b = -0.5 * np.einsum("ij,jk,ik->i", mus, inv, mus) + np.log(priors)
    return DiscriminantModel(classes, "lda", {"center": center, "w": w, "b": b})


#: Eigenvalues of a class covariance are at least this share of the mean
#: eigenvalue of the pooled covariance.
QDA_FLOOR = 1e-6


def fit_qda(train, label="label_idx", features="features", reg_param=0.0) -> DiscriminantModel:
    """Per-class covariance, always of full rank.

    A class of fewer rows than it takes for full rank (``n <= d``) is shrunk to the
    pooled covariance with weight ``d / (d + n)``; then eigenvalues are floored
    at ``QDA_FLOOR``.  The same matrix gives the inverse and the determinant, so
    a tiny class is neither infinitely likely nor left out."""
    mom = class_moments(train, label, features)
    classes = np.array(sorted(mom))
    n_tot = sum(mom[c][0] for c in classes)
    d = len(mom[classes[0]][1])
    pooled = sum(mom[c][2] for c in classes) / max(n_tot - len(classes), 1)
    floor = max(QDA_FLOOR * float(np.trace(pooled)) / d, np.finfo(float).tiny)
    mus, invs, consts = [], [], []
    for c in classes:
        n, mu, scatter = mom[c]
        cov = scatter / max(n - 1, 1)
        if n <= d:
            weight = d / (d + n)
            cov = (1 - weight) * cov + weight * pooled
        if reg_param:
            cov = (1 - reg_param) * cov + reg_param * np.eye(d)
        ev, vec = np.linalg.eigh(cov)
        ev = np.maximum(ev, floor)
        mus.append(mu)
        invs.append((vec / ev) @ vec.T)
        consts.append(-0.5 * float(np.sum(np.log(ev))) + math.log(n / n_tot))
    return DiscriminantModel(classes, "qda", {"mu": np.array(mus), "inv": np.array(invs),
                                              "const": np.array(consts)})


def predict_discriminant(model: DiscriminantModel, test: DataFrame, label="label_idx",
                         features="features", id_col="id") -> DataFrame:
    spark = test.sparkSession
    # plain arrays and a local function: executors need no module of this package
    bc = spark.sparkContext.broadcast((model.kind, model.classes, model.params))

    def score(it):
        kind, classes, p = bc.value
        for pdf in it:
            if pdf.empty:
                continue
            x = np.stack(pdf[features].to_numpy()).astype(np.float64)
            if kind == "lda":
                scores = (x - p["center"]) @ p["w"] + p["b"]
            else:
                scores = np.stack([p["const"][j] - 0.5 * np.einsum("ij,jk,ik->i", x - p["mu"][j], p["inv"][j],
                                                                   x - p["mu"][j]) for j in range(len(classes))],
                                  axis=1)
            pred = classes[np.argmax(scores, axis=1)]
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), label: pdf[label].to_numpy(),
                                "prediction": pred.astype(np.int32)})

    schema = f"{id_col} long, {label} int, prediction int"
    return test.select(id_col, F.col(label).cast("int").alias(label), features) \
               .mapInPandas(score, schema)


def lda(train, test, label="label_idx", features="features", id_col="id"):
    return predict_discriminant(fit_lda(train, label, features), test, label, features, id_col)


def qda(train, test, label="label_idx", features="features", id_col="id", reg_param=0.0):
    return predict_discriminant(fit_qda(train, label, features, reg_param), test, label,
                                features, id_col)


# ---------------------------------------------------------------------------
# Exact k-nearest neighbours, blocked
# ---------------------------------------------------------------------------

#: Most pivot rows of the k-NN search; they and the numbers of a pair of cells (at most
#: 256 x 256) are all that the driver and every task hold.
MAX_PIVOTS = 256
#: Blocks over which the rows of a side are dealt, about: blocks grow with the rows, so that a row
#: that meets all of the other side has so many copies, up to the rows and bytes of a task.
COPIES = 16
MOST_BLOCK_ROWS, MOST_BLOCK_BYTES = 131_072, 64 << 20
#: Pivots whose bisecting planes with every other pivot bound the distance to its cell.
PLANES = 16


def _near_groups(points: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Group number of every point: near points together, at most ``most`` rows a group
    unless one point alone has more.  Halved by rows along the widest dimension."""
    out = np.zeros(len(points), dtype=np.int64)
    todo, done = [np.arange(len(points))], 0
    while todo:
        own = todo.pop()
        if len(own) > 1 and sizes[own].sum() > most:
            own = own[points[own][:, np.ptp(points[own], axis=0).argmax()].argsort(kind="stable")]
            half = np.searchsorted(np.cumsum(sizes[own]), sizes[own].sum() / 2)
            half = min(max(int(half), 1), len(own) - 1)
            todo += [own[:half], own[half:]]
        else:
            out[own] = done
            done += 1
    return out


def _knn_blocks(train: DataFrame, test: DataFrame, k: int, label, features, id_col,
                block_rows: int, vote: bool = False):
    """Test and train rows dealt to the blocks in which they can meet as neighbours:
    two frames with the block columns ``home, qp, cell, tp``, or None without rows.

    With ``vote`` a third frame ``(id, prediction)`` has the test rows whose neighbours
    all are of one class, since every cell that may hold one is: these meet no block.

    A training row belongs to the cell of its nearest pivot; near cells, and near home cells
    of test rows, share a block up to ``block_rows`` rows, or a ``COPIES``-th of all, so that rows are
    copied to few blocks where all cells are visited.  Of training rows alike in all features
    only the ``k`` least ids can be neighbours; one with a missing number is near to none.

    A test row has ``k`` neighbours within the distance of its k-th nearest pivot, within reach
    of the nearest cells that hold ``k`` rows, and within that of the k-th row of the block that
    holds its nearest cell, where it is looked for first; a cell whose radii, or whose bisecting
    planes with the pivots near the row, keep farther off than that bound holds none of its
    neighbours.
    """
    train = train.filter(F.col(features).isNull() | F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v)))
    n_train, distinct = train.select(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(features))).first()
    if n_train > 2 * k * distinct:
        ensure_checkpoint_dir(train.sparkSession)
        alike = Window.partitionBy(features).orderBy(F.asc_nulls_last(id_col))
        train = (train.select(id_col, label, features).withColumn("_alike", F.row_number().over(alike))
                 .filter(F.col("_alike") <= k).drop("_alike").checkpoint())
        n_train = train.count()
    n_pivots = min(MAX_PIVOTS, math.ceil(4 * n_train / block_rows))
    drawn = train.orderBy(F.xxhash64(id_col), id_col).limit(n_pivots).select(features).collect()
    if not drawn:
        return None
    rows = np.array([r[0] for r in drawn], dtype=np.float64)
    rows = rows[np.isfinite(rows).all(axis=1)]
    pivots = np.unique(rows, axis=0) if len(rows) else np.zeros((1, len(drawn[0][0])))
    spark = train.sparkSession

    def distances(x, to):
        """Euclidean, rows by pivots.  Summed one dimension at a time, so that a row gets
        the same number whatever batch it is in: a task that is run again deals its
        rows to the same cells."""
        out = np.empty((len(x), len(to)))
        for s in range(0, len(x), 1024):
            acc = np.zeros((len(x[s:s + 1024]), len(to)))
            for j in range(x.shape[1]):
                diff = x[s:s + 1024, j, None] - to[None, :, j]
                acc += diff * diff
            out[s:s + 1024] = np.sqrt(acc)
        return out

    width = max(1, pivots.shape[1])

    def rows_of_block(n):
        return max(block_rows, min(math.ceil(n / COPIES), MOST_BLOCK_ROWS, MOST_BLOCK_BYTES // (8 * width)))


    at_pivots = spark.sparkContext.broadcast(pivots)

    def cells_of(it):
        for pdf in it:
            if len(pdf):
                d = distances(np.stack(pdf[features].to_numpy()).astype(np.float64), at_pivots.value)
                cell = d.argmin(axis=1)
                yield pdf.drop(columns=features).assign(
                    x=pdf[features], cell=cell.astype(np.int32), radius=d[np.arange(len(d)), cell])

    in_cells = (train.select(F.col(id_col).alias("train_id").cast("long"),
                             F.col(label).cast("int").alias("nb_label"), features)
                .mapInPandas(cells_of, "train_id long, nb_label int, x array<double>, cell int, radius double"))
    stats = {r["cell"]: r for r in in_cells.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi"),
        F.count("nb_label").alias("told"), F.min("nb_label").alias("least"), F.max("nb_label").alias("most")).collect()}
    ids = np.array(sorted(stats), dtype=np.int64)
    n = np.array([stats[c]["n"] for c in ids])
    lo, hi = (np.array([stats[c][f] for c in ids]) for f in ("lo", "hi"))
    # least and largest label of a cell; one with a row of no label is of no single class
    told = np.array([(stats[c]["least"], stats[c]["most"]) if stats[c]["told"] == stats[c]["n"]
                     else (-1 << 40, 1 << 40) for c in ids], dtype=np.int64)
    most = rows_of_block(n_train)
    group = _near_groups(pivots[ids], n, most)
    n_groups = int(group.max(initial=-1)) + 1
    near = spark.sparkContext.broadcast((rows, pivots, distances(pivots, pivots)[:, ids]))
    cells = spark.sparkContext.broadcast((ids, n, lo, hi, told, np.eye(n_groups, dtype=np.float32)[group]))

    def visits(x, bound=None):
        """Home cell, and a flag per cell that may hold a neighbour, of every row."""
        home, seen = np.empty(len(x), dtype=np.int64), np.empty((len(x), len(cells.value[0])), dtype=bool)
        for s in range(0, len(x), 512):  # tables that stay in the cache
            home[s:s + 512], seen[s:s + 512] = visits_of_few(x[s:s + 512], None if bound is None else bound[s:s + 512])
        return home, seen

    def visits_of_few(x, bound):
        rows, pivots, between = near.value
        ids, n, lo, hi = cells.value[:4]
        every = distances(x, pivots)
        d = every[:, ids]
        at = np.arange(len(x))
        if bound is None:
            reach = d + hi
            order = reach.argsort(axis=1)
            enough = (np.cumsum(n[order], axis=1) >= k).argmax(axis=1)
            bound = reach[at, order[at, enough]] if n.sum() >= k else np.full(len(x), np.inf)
            if len(rows) >= k:
                bound = np.fmin(bound, np.partition(distances(x, rows), k - 1, axis=1)[:, k - 1])
        # far more than the rounding of the distances; NaN rules nothing out
        limit = bound[:, None] + 1e-9 * (d + hi + bound[:, None])
        seen = ~(np.maximum(d - hi, lo - d) > limit)
        # a row of cell j is no nearer to pivot i than to pivot j: it lies on this side of their bisecting plane
        with np.errstate(invalid="ignore"):
            square = d * d * (1 - 1e-12) - 2e-12 * hi * hi
            limit *= 2
            for i in every.argpartition(min(PLANES, len(pivots)) - 1, axis=1)[:, :PLANES].T:
                own = every[at, i] ** 2 * (1 + 1e-12)
                seen &= ~(square - own[:, None] > limit * between[i])
        return every.argmin(axis=1), seen

    def groups_seen(pdf):
        """Home cell, and a flag per group of cells that may hold a neighbour, of every row."""
        home, seen = visits(np.stack(pdf["q"].to_numpy()).astype(np.float64), pdf["bound"].to_numpy())
        return home, seen.astype(np.float32) @ cells.value[5] > 0

    def visits_of(it):
        for pdf in it:
            if len(pdf):
                home, seen = groups_seen(pdf)
                yield pd.DataFrame({"test_id": pdf["test_id"].to_numpy(), "q": pdf["q"], "bound": pdf["bound"],
                                    "home": home_group.value[home].astype(np.int32),
                                    "cells": [np.flatnonzero(s).astype(np.int32) for s in seen]})

    def totals_of(it):  # rows of a home cell that visit a group; group -1: all its rows
        total = np.zeros((len(near.value[1]), cells.value[5].shape[1] + 1), dtype=np.int64)
        for pdf in it:
            if len(pdf):
                home, seen = groups_seen(pdf)
                np.add.at(total, home, np.hstack([seen, np.ones((len(seen), 1), dtype=bool)]))
        home, col = np.nonzero(total)
        yield pd.DataFrame({"home": home.astype(np.int32),
                            "cell": np.where(col == total.shape[1] - 1, -1, col).astype(np.int32),
                            "n": total[home, col]})

    def nearest_of(it):  # group of the nearest cell that holds a row
        for pdf in it:
            if len(pdf):
                d = distances(np.stack(pdf["q"].to_numpy()).astype(np.float64), near.value[1])
                yield pdf.assign(cell=cells.value[5].argmax(axis=1)[d[:, cells.value[0]].argmin(axis=1)].astype(np.int32))

    def sure_of(it):  # the one class of all cells that a row visits, if there is one
        least, most = cells.value[4].T
        for pdf in it:
            if len(pdf):
                _, seen = visits(np.stack(pdf[features].to_numpy()).astype(np.float64))
                low = np.where(seen, least, 1 << 41).min(axis=1)
                one = low == np.where(seen, most, -1 << 41).max(axis=1)
                yield pd.DataFrame({id_col: pdf[id_col].to_numpy(),
                                    "prediction": pd.array([v if o else None for v, o in zip(low, one)], "Int32")})

    queries = test.select(F.col(id_col).cast("long").alias(id_col), features)
    sure = None
    if vote:
        # rows of one id count as one: all of them have to agree
        ensure_checkpoint_dir(spark)
        p = F.col("prediction")
        sure = (queries.mapInPandas(sure_of, f"{id_col} long, prediction int").groupBy(id_col)
                .agg(F.count(F.lit(1)).alias("n"), F.count(p).alias("m"), F.min(p).alias("prediction"), F.max(p).alias("hi"))
                .filter((F.col("n") == F.col("m")) & (F.col("hi") == p)).select(id_col, "prediction").checkpoint())
        queries = queries.join(sure.select(id_col), id_col, "left_anti")
    of_cell = np.zeros(len(pivots), dtype=np.int64)
    of_cell[ids] = group

    def pieces(groups, sizes, col, most):  # blocks that a group of so many rows is cut into
        rows = np.bincount(groups, sizes, minlength=1)
        return F.get(F.array(*[F.lit(max(1, math.ceil(r / most))) for r in rows.tolist()]), F.col(col))

    def all_pieces(count):
        return F.explode(F.sequence(F.lit(0).cast("long"), count - F.lit(1).cast("long")))

    cell_pieces = pieces(group, n, "cell", most)
    grouped = (in_cells.drop("radius")
               .withColumn("cell", F.get(F.array(*[F.lit(g) for g in of_cell.tolist()]), F.col("cell")).cast("int"))
               .withColumn("tp", F.pmod(F.xxhash64("train_id"), cell_pieces)))

    # every row first meets one block of its nearest cell: the k-th distance there is its bound
    begun = (queries.select(F.col(id_col).alias("test_id"), F.col(features).alias("q"))
             .mapInPandas(nearest_of, "test_id long, q array<double>, cell int")
             .withColumn("tp", F.pmod(F.xxhash64("test_id"), cell_pieces)))
    first = {r["cell"]: r["n"] for r in begun.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    query_rows = rows_of_block(sum(first.values()))
    parts = pieces(np.array(sorted(first), dtype=np.int64), [first[c] for c in sorted(first)], "cell", query_rows)
    ensure_checkpoint_dir(spark)
    own = ["cell", "tp", "qp"]
    bounded = (begun.withColumn("qp", F.pmod(F.xxhash64("test_id", F.lit(1)), parts)).groupBy(*own)
               .cogroup(grouped.withColumn("qp", all_pieces(parts)).groupBy(*own))
               .applyInArrow(_bounds(k), "test_id long, q array<double>, bound double").checkpoint())

    met = (bounded.mapInPandas(totals_of, "home int, cell int, n long")
           .groupBy("home", "cell").agg(F.sum("n").alias("n")).collect())
    homes = np.array(sorted((r["home"], r["n"]) for r in met if r["cell"] < 0), dtype=np.int64).reshape(-1, 2)
    of_home = np.zeros(len(pivots), dtype=np.int64)
    of_home[homes[:, 0]] = _near_groups(pivots[homes[:, 0]], homes[:, 1], query_rows)
    home_group = spark.sparkContext.broadcast(of_home)
    home_pieces = pieces(of_home[homes[:, 0]], homes[:, 1], "home", query_rows)
    te = (bounded.mapInPandas(visits_of, "test_id long, q array<double>, bound double, home int, cells array<int>")
          .withColumn("qp", F.pmod(F.xxhash64("test_id"), home_pieces))
          .withColumn("cell", F.explode("cells")).drop("cells")
          .withColumn("tp", all_pieces(cell_pieces)))
    pairs = spark.createDataFrame(sorted({(int(of_home[r["home"]]), r["cell"]) for r in met if r["cell"] >= 0}),
                                  "home int, cell int")
    tr = grouped.join(F.broadcast(pairs), "cell").withColumn("qp", all_pieces(home_pieces))
    return (te, tr, sure) if vote else (te, tr)


def knn_candidates(train: DataFrame, test: DataFrame, k: int = 5, label="label_idx",
                   features="features", id_col="id", block_rows: int = 4096) -> DataFrame:
    """Exact top-k train neighbours of every test row: ``(test_id, train_id,
    dist2, nb_label, rank)``, squared Euclidean distance, ties by train id.

    Rows meet in blocks of about ``block_rows``; a test row visits only the cells that
    the triangle inequality cannot rule out (``_knn_blocks``)."""
    blocks = _knn_blocks(train, test, k, label, features, id_col, block_rows)
    if blocks is None:
        return train.sparkSession.createDataFrame([], CANDIDATES + ", rank int")
    return _nearest(*blocks, k)


CANDIDATES = "test_id long, train_id long, dist2 double, nb_label int"
#: Rows of a tile of a block, and found rows that are held before they are ranked.
TILE, HELD = 256, 1 << 20


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tiles(x: np.ndarray) -> list[np.ndarray]:
    """Rows in tiles of at most ``TILE`` near ones: halved along the widest dimension."""
    todo, done = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) > TILE:
            # halves of whole tiles, so that all but one are full
            half = -(-len(own) // (2 * TILE)) * TILE
            own = own[np.argpartition(x[own, np.ptp(x[own], axis=0).argmax()], half)]
            todo += [own[:half], own[half:]]
        else:
            done.append(own)
    return done


def _ranked(row, col, q, x, tid, k):
    """The ``k`` best of the found pairs of every row by (exact distance, id): rows, columns, distances."""
    exact = np.empty(len(row))
    for p0 in range(0, len(row), 1 << 16):
        diff = q[row[p0:p0 + (1 << 16)]] - x[col[p0:p0 + (1 << 16)]]
        exact[p0:p0 + (1 << 16)] = np.einsum("ij,ij->i", diff, diff)
    there = np.flatnonzero(~np.isnan(exact))
    there = there[np.lexsort((tid[col[there]], exact[there], row[there]))]
    row, col, exact = row[there], col[there], exact[there]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], col[best], exact[best]


def _found(q, bound, x, tid, k):
    """Of every row of ``q`` the ``k`` nearest rows of ``x`` within ``bound``, by (distance, id):
    rows, columns and squared distances.

    Both sides are cut into tiles of near rows.  A row meets the tiles whose box is no farther
    than the k-th distance that it knows, nearest tiles first.  There a fast screen (Gram form)
    keeps every pair whose distance can be the k-th best or less, given the rounding of the
    screen; all ties stay in.  The kept are ranked by their exact distance."""
    plain_q, plain_x = np.isfinite(q).all(axis=1), np.isfinite(x).all(axis=1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    with np.errstate(invalid="ignore", over="ignore"):
        # infinite numbers: a finite row is nearer than a row with one
        odd = np.flatnonzero(~plain_q & ~np.isnan(q).any(axis=1))
        if len(x):
            out += [_ranked(np.full(len(x), i), np.arange(len(x)), q, x, tid, k) for i in odd]
    known = np.flatnonzero(plain_x)
    if len(known) < k:
        known = np.arange(len(x))
    asked = np.flatnonzero(plain_q)
    if not len(known) or not len(asked):
        return tuple(map(np.concatenate, zip(*out)))
    if not plain_x[known].all():
        out += [_ranked(np.repeat(asked[s:s + TILE], len(known)), np.tile(known, len(asked[s:s + TILE])), q, x, tid, k)
                for s in range(0, len(asked), TILE)]
        return tuple(map(np.concatenate, zip(*out)))

    centre = x[known].mean(axis=0)
    xs, d = x[known] - centre, x.shape[1]
    tiles = _tiles(xs)
    place = known[np.concatenate(tiles)]
    ends = np.cumsum([0, *map(len, tiles)])
    low, high = (np.array([f(xs[t], axis=0) for t in tiles]) for f in (np.min, np.max))
    xx = (xs * xs).sum(axis=1)
    # columns of a tile, and their squares beneath
    sides = [np.ascontiguousarray(np.vstack([-2.0 * xs[t].T, xx[t]])) for t in tiles]
    top = xx.max()
    qs = q[asked] - centre
    for rows in _tiles(qs):
        y = qs[rows]
        yy = (y * y).sum(axis=1)
        away = np.zeros((len(y), len(tiles)))
        for j in range(d):
            gap = np.maximum(low[None, :, j] - y[:, None, j], y[:, None, j] - high[None, :, j])
            np.maximum(gap, 0, out=gap)
            gap *= gap
            away += gap
        slack = 16 * (d + 4) * np.finfo(float).eps * (yy + top)
        b = bound[asked[rows]]
        limit = np.where(np.isfinite(b), b * b, np.inf) + slack
        ones = np.hstack([y, np.ones((len(y), 1))])
        best = np.full((len(y), k), np.inf)

        def ranked(held):
            r, c, screened = map(np.concatenate, zip(*held))
            kept = np.flatnonzero(screened <= limit[r])
            return _ranked(r[kept], c[kept], q[asked[rows]], x[place], tid[place], k)

        held, n_held = [], 0
        for t in away.min(axis=0).argsort(kind="stable"):
            near = np.flatnonzero(away[:, t] <= limit)
            if not len(near):
                continue
            screen = ones[near] @ sides[t]
            hit = screen <= (limit - yy)[near][:, None]
            some = np.flatnonzero(hit.any(axis=1))
            if not len(some):
                continue
            r, c = np.nonzero(hit[some])
            at = near[some]
            held.append((at[r], ends[t] + c, screen[some[r], c] + yy[at[r]]))
            n_held += len(r)
            # each of the k least screened distances is off by less than half of the slack
            least = np.where(hit[some], screen[some] + yy[at][:, None], np.inf)
            best[at] = np.partition(np.hstack([best[at], least]), k - 1, axis=1)[:, :k]
            limit[at] = np.minimum(limit[at], best[at, k - 1] + slack[at])
            if n_held > HELD:
                held = [ranked(held)]
                n_held = len(held[0][0])
        if held:
            r, c, exact = ranked(held)
            out.append((asked[rows][r], place[c], exact))
    return tuple(map(np.concatenate, zip(*out)))


def _bounds(k: int):
    """For a block: every test row with the distance of the k-th nearest training row in it."""
    def local(queries: pa.Table, known: pa.Table) -> pa.Table:
        bound = np.full(queries.num_rows, np.inf)
        if queries.num_rows and known.num_rows >= k:
            row, _, exact = _found(_matrix(queries.column("q")), bound, _matrix(known.column("x")),
                                   np.zeros(known.num_rows, np.int64), k)
            order = np.argsort(row, kind="stable")
            row, exact = row[order], exact[order]
            last = np.searchsorted(row, np.arange(len(bound)), side="right")
            full = np.bincount(row, minlength=len(bound)) == k
            bound[full] = np.sqrt(exact[last[full] - 1])
        return pa.table({"test_id": queries.column("test_id"), "q": queries.column("q"), "bound": bound})

    return local


def _nearest(te: DataFrame, tr: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of the training rows that a test row meets in its blocks."""
    def local_topk(queries: pa.Table, known: pa.Table) -> pa.Table:
        if not queries.num_rows or not known.num_rows:
            return found.empty_table()
        tid = known.column("train_id").to_numpy()
        row, col, exact = _found(_matrix(queries.column("q")), queries.column("bound").to_numpy(),
                                 _matrix(known.column("x")), tid, k)
        lab = known.column("nb_label").combine_chunks()
        return pa.table([queries.column("test_id").take(pa.array(row)), tid[col], exact, lab.take(pa.array(col))], schema=found)

    found = pa.schema([("test_id", pa.int64()), ("train_id", pa.int64()), ("dist2", pa.float64()),
                       ("nb_label", pa.int32())])

    block = ["home", "qp", "cell", "tp"]
    cands = te.groupBy(*block).cogroup(tr.groupBy(*block)).applyInArrow(local_topk, CANDIDATES)
    w = Window.partitionBy("test_id").orderBy("dist2", "train_id")
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn(train, test, k=5, label="label_idx", features="features", id_col="id",
        block_rows: int = 4096) -> DataFrame:
    """Majority vote of the k nearest training rows; ties -> smallest class.

    Neighbours are searched for the test rows whose class is open: where every cell that
    may hold a neighbour is of one class, so is the vote."""
    blocks = _knn_blocks(train, test, k, label, features, id_col, block_rows, vote=True)
    rows = test.select(id_col, F.col(label).cast("int").alias(label))
    if blocks is None:
        return rows.withColumn("prediction", F.lit(None).cast("int"))
    te, tr, sure = blocks
    nb = _nearest(te, tr, k)
    votes = nb.groupBy("test_id", "nb_label").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("test_id").orderBy(F.desc("votes"), F.asc("nb_label"))
    pred = (votes.withColumn("r", F.row_number().over(w)).filter(F.col("r") == 1)
            .select(F.col("test_id").alias(id_col), F.col("nb_label").alias("prediction")))
    return rows.join(pred.unionByName(sure), id_col, "left")


# ---------------------------------------------------------------------------
# Timing wrapper (J8)
# ---------------------------------------------------------------------------

def timed_fit_predict(fit, predict):
    """Time training and prediction separately (J8).

    ``fit()`` returns a fitted model (its action runs here); ``predict(model)``
    returns the prediction frame, written once as a checkpoint in the shared folder, so
    that no predictions stay in executor memory.  Returns
    ``(predictions, train_seconds, predict_seconds)``.
    """
    t0 = time.perf_counter()
    model = fit()
    t1 = time.perf_counter()
    pred = predict(model)
    ensure_checkpoint_dir(pred.sparkSession)
    pred = pred.checkpoint()
    return pred, t1 - t0, time.perf_counter() - t1


def timed_runs(spark: SparkSession, runs: dict, beside=frozenset({"MLP"})) -> dict:
    """``timed_fit_predict`` of every (fit, predict) pair, by name.  A network is trained step by
    step by one task, so the models ``beside`` run while the others do, one after the other."""
    def timed(names):
        return {name: timed_fit_predict(*runs[name]) for name in runs if name in names}

    with ThreadPoolExecutor(1) as pool:
        apart = pool.submit(inheritable_thread_target(spark)(timed), beside)
        done = {**timed(runs.keys() - beside), **apart.result()}
    return {name: done[name] for name in runs}


def model_runs(train: DataFrame, test: DataFrame, knn_block_rows: int = 4096, label="label_idx",
               features="features", id_col="id"):
    """(fit, predict) pairs of the seven models, in the comparison order."""
    names = (label, features, id_col)

    def pair(fit, predict):
        return lambda: fit(train, *names), lambda m: predict(m, test, *names)

    return {
        "MLP": pair(fit_network, predict_network),
        "LDA": (lambda: fit_lda(train, label, features), lambda m: predict_discriminant(m, test, *names)),
        "QDA": (lambda: fit_qda(train, label, features), lambda m: predict_discriminant(m, test, *names)),
        "SVM": pair(fit_svm, predict_svm),
        # k-NN has no training step: the training rows are the model
        "k-NN": (lambda: None, lambda _m: knn(train, test, 5, *names, knn_block_rows)),
        "DT": pair(fit_tree, predict_trees),
        "RF": pair(fit_forest, predict_trees),
    }
