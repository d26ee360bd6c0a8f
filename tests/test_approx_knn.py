"""Neighbours by hash tables: recall against the exact search, pieces, odd tables."""

import numpy as np

SCHEMA = "id long, label_idx int, features array<double>"


def test_recall_and_pieces(spark):
    from flowforge.operators.approx_knn import approximate_neighbours, recall
    from flowforge.operators.classifiers import knn_candidates
    r = np.random.default_rng(0)
    centres = r.normal(0, 4, (30, 16))
    rows = [(i, i % 3, (centres[i % 30] + r.normal(0, 1, 16)).tolist()) for i in range(2400)]
    rows += [(i, i % 3, centres[0].tolist()) for i in range(2400, 3000)]  # a hot vector
    train = spark.createDataFrame(rows, SCHEMA).repartition(4)
    test = spark.createDataFrame([(9000 + i, 0, (centres[i % 30] + r.normal(0, 1, 16)).tolist()) for i in range(150)], SCHEMA)
    found = approximate_neighbours(train, test, 5, bucket_rows=64).collect()
    assert max(q["rank"] for q in found) <= 5 and len({(q["test_id"], q["train_id"]) for q in found}) == len(found)
    exact = knn_candidates(train, test, 5)
    got = recall(spark.createDataFrame(found), exact).first()
    assert got["n_exact"] == 750 and got["recall"] >= 0.9
    fewer = recall(approximate_neighbours(train, test, 5, bucket_rows=64, tables=1, probes=0), exact).first()
    assert fewer["recall"] < got["recall"]


def test_few_rows_are_searched_whole(spark):
    from flowforge.operators.approx_knn import approximate_neighbours
    from flowforge.operators.classifiers import knn_candidates
    r = np.random.default_rng(1)
    train = spark.createDataFrame([(i, i % 2, r.normal(size=4).tolist()) for i in range(100)], SCHEMA)
    test = spark.createDataFrame([(500 + i, 0, r.normal(size=4).tolist()) for i in range(20)], SCHEMA)
    keys = ["test_id", "train_id", "rank"]
    assert sorted(approximate_neighbours(train, test, 5).select(keys).collect()) == \
        sorted(knn_candidates(train, test, 5).select(keys).collect())
    assert approximate_neighbours(train.limit(0), test).count() == 0
    assert approximate_neighbours(train, test.limit(0)).count() == 0
