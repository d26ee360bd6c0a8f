"""Classifiers: discriminants against NumPy, k-NN against brute force,
pyspark.ml models above an accuracy floor on separable data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowforge.operators import classifiers as C


def _blobs(spark, n_per=60, d=4, k=3, seed=0, spread=0.6):
    rnd = np.random.default_rng(seed)
    rows = []
    i = 0
    for c in range(k):
        centre = np.zeros(d)
        centre[c % d] = 4.0 * (1 + c // d)
        for _ in range(n_per):
            rows.append((i, c, [float(v) for v in centre + rnd.normal(0, spread, d)]))
            i += 1
    return spark.createDataFrame(rows, "id long, label_idx int, features array<double>")


@pytest.fixture(scope="module")
def data(spark):
    df = _blobs(spark)
    train = df.filter("id % 3 != 0").cache()
    test = df.filter("id % 3 = 0").cache()
    return train, test


def _acc(pred):
    rows = pred.collect()
    return sum(r["label_idx"] == r["prediction"] for r in rows) / len(rows)


def test_lda_matches_numpy(data):
    train, test = data
    tr = train.collect()
    x = np.array([r["features"] for r in tr])
    y = np.array([r["label_idx"] for r in tr])
    classes = np.unique(y)
    mus = np.array([x[y == c].mean(0) for c in classes])
    cov = sum(((x[y == c] - mus[i]).T @ (x[y == c] - mus[i])) for i, c in enumerate(classes)) / (len(x) - len(classes))
    inv = np.linalg.inv(cov)
    pri = np.array([(y == c).mean() for c in classes])
    te = test.collect()
    xt = np.array([r["features"] for r in te])
    sc = xt @ inv @ mus.T - 0.5 * np.sum(mus @ inv * mus, axis=1) + np.log(pri)
    want = {r["id"]: int(classes[j]) for r, j in zip(te, np.argmax(sc, 1))}
    got = {r["id"]: r["prediction"] for r in C.lda(train, test).collect()}
    assert got == want


def test_qda_small_class(spark):
    df = _blobs(spark, n_per=40, d=6, k=2, seed=1)
    tiny = _blobs(spark, n_per=3, d=6, k=3, seed=2).filter("label_idx = 2")
    train = df.unionByName(tiny)
    pred = C.qda(train, df.filter("id < 20"))
    assert _acc(pred) >= 0.9


def test_knn_matches_brute_force(spark):
    rnd = np.random.default_rng(4)
    tr = [(i, int(rnd.integers(0, 3)), [float(v) for v in rnd.normal(size=5)]) for i in range(300)]
    te = [(1000 + i, int(rnd.integers(0, 3)), [float(v) for v in rnd.normal(size=5)]) for i in range(70)]
    schema = "id long, label_idx int, features array<double>"
    train, test = spark.createDataFrame(tr, schema), spark.createDataFrame(te, schema)
    got = {r["id"]: r["prediction"] for r in C.knn(train, test, k=5, block_rows=40).collect()}
    xt = np.array([f for _, _, f in tr])
    lt = np.array([c for _, c, _ in tr])
    it = np.array([i for i, _, _ in tr])
    for qid, _, q in te:
        d2 = ((xt - np.array(q)) ** 2).sum(1)
        nb = np.lexsort((it, d2))[:5]
        counts = np.bincount(lt[nb], minlength=3)
        assert got[qid] == int(np.argmax(counts)), qid


def test_knn_visits_only_near_cells_and_stays_exact(spark):
    """Clusters, a hot vector, fewer rows than k in a cell, and NaN: as brute force, and
    clustered test rows meet a small part of the training blocks."""
    from flowforge.operators.classifiers import _knn_blocks, knn_candidates
    rnd = np.random.default_rng(6)
    centres = rnd.normal(0, 50, (12, 6))
    tr = [(i, i % 3, (centres[i % 12] + rnd.normal(0, 1, 6)).tolist()) for i in range(1500)]
    tr += [(i, i % 3, centres[0].tolist()) for i in range(1500, 2300)]
    te = [(9000 + i, 0, (centres[i % 12] + rnd.normal(0, 1, 6)).tolist()) for i in range(120)]
    te += [(9990, 0, rnd.normal(0, 50, 6).tolist()), (9991, 0, centres[0].tolist())]
    schema = "id long, label_idx int, features array<double>"
    train, test = spark.createDataFrame(tr, schema).repartition(3), spark.createDataFrame(te, schema)
    got = {}
    for r in knn_candidates(train, test, 5, block_rows=50).orderBy("rank").collect():
        got.setdefault(r["test_id"], []).append(r["train_id"])
    x, ids = np.array([r[2] for r in tr]), np.array([r[0] for r in tr])
    want = {t: ids[np.lexsort((ids, ((x - np.array(q)) ** 2).sum(1)))[:5]].tolist() for t, _, q in te}
    assert got == want
    te_blocks, tr_blocks = _knn_blocks(train, test, 5, "label_idx", "features", "id", 50)
    blocks = tr_blocks.select("cell", "tp").distinct().count()
    assert te_blocks.count() < 0.5 * len(te) * blocks
    odd = train.unionByName(spark.createDataFrame([(5000, 0, [float("nan")] * 6)], schema))
    few = {r["test_id"]: r["train_id"] for r in knn_candidates(odd, test, 1, block_rows=50).collect()}
    assert few == {t: w[0] for t, w in want.items()}
    assert knn_candidates(train.limit(0), test, 5).count() == 0
    assert knn_candidates(train, test.limit(0), 5).count() == 0
    assert knn_candidates(train.limit(3), test, 5).count() == 3 * len(te)


@pytest.mark.parametrize("fit", ["tree", "forest", "svm"])
def test_ml_models_accuracy(data, fit):
    train, test = data
    pred = {"tree": lambda: C.decision_tree(train, test),
            "forest": lambda: C.random_forest(train, test, num_trees=20),
            "svm": lambda: C.linear_svm(train, test)}[fit]()
    assert _acc(pred) >= 0.9


def test_mlp_accuracy(data):
    train, test = data
    pred = C.mlp(train, test, hidden=(16, 16), epochs=60)
    assert _acc(pred) >= 0.9


def test_qda_tiny_class_and_lda_offset(spark):
    """Classes of 3,000, 2,000 and 5 rows, 74 features: the tiny class is neither
    preferred nor ignored; a large common offset keeps the digits."""
    from flowforge.operators.classifiers import lda, qda
    r = np.random.default_rng(0)
    x = [r.normal(m, 1.0, (n, 74)) for n, m in ((3000, 0.0), (2000, 1.0), (5, -3.0))]
    rows = [(i, int(c), v.tolist()) for i, (c, v) in
            enumerate((c, v) for c, part in enumerate(x) for v in part)]
    df = spark.createDataFrame(rows, "id long, label_idx int, features array<double>").repartition(4)
    got = qda(df, df).toPandas()
    assert (got.label_idx == got.prediction).mean() >= 0.95
    assert (got.prediction == 2).sum() <= 10
    far = df.withColumn("features", F.expr("transform(features, v -> v + 1e8)"))
    for model in (lda, qda):
        got = model(far, far).toPandas()
        assert (got.label_idx == got.prediction).mean() >= 0.95


def test_knn_keeps_every_tie(spark):
    from flowforge.operators.classifiers import knn_candidates
    train = spark.createDataFrame([(i, int(i < 5), [1.0, 2.0]) for i in range(200)],
                                  "id long, label_idx int, features array<double>")
    test = spark.createDataFrame([(900, 0, [1.0, 2.5])], train.schema)
    for block in (4096, 16):
        got = knn_candidates(train, test, 5, block_rows=block).orderBy("rank").collect()
        assert [r["train_id"] for r in got] == [0, 1, 2, 3, 4] and all(r["nb_label"] == 1 for r in got)


def test_forest_does_not_depend_on_layout(spark):
    from flowforge.operators.classifiers import random_forest
    r = np.random.default_rng(1)
    rows = [(i, int(i % 3), (r.normal(i % 3, 2, 6)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label_idx int, features array<double>")
    got = [sorted(map(tuple, random_forest(df.repartition(n), df, num_trees=5, max_depth=5).collect()))
           for n in (1, 8, 17)]
    assert got[0] == got[1] == got[2]


def test_null_group_and_outside_class_stay(spark):
    from flowforge.operators.metrics import dense_confusion
    from flowforge.operators.split import hash_rank
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "k long, g string")
    assert sorted(r["_rank"] for r in hash_rank(df, ["g"], ["k"], 0).collect()) == [1, 1, 2]
    c = spark.createDataFrame([(0, 0), (1, 5), (7, 1)], "label_idx int, prediction int")
    cells = {(r[0], r[1]): r[2] for r in dense_confusion(c, 2).collect()}
    assert sum(cells.values()) == 3 and cells[(7, 1)] == 1 and len(cells) == 16


def test_short_lines_and_pruned_labels_fail(spark, tmp_path):
    from flowforge.operators.cleaning import validate_labels
    from flowforge.schema import FLOW_SCHEMA
    from flowforge.sources.flows import read_flows
    f = tmp_path / "short.csv"
    n = len(FLOW_SCHEMA.fields)
    f.write_text(",".join("h" * n) + "\n" + ",".join(["1"] * (n - 1)) + "\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        read_flows(spark, str(f)).collect()
    bad = spark.createDataFrame([("x", 1)], "label string, v int")
    with pytest.raises(Exception, match="unknown label"):
        validate_labels(bad, ["benign"]).select("v").count()


def test_all_seven_models_tell_languages_apart(spark):
    from flowforge.plans.q_models import language_predictions, language_splits
    train, test = language_splits(spark, "/root/testdata/sf0.01")
    floors = {"MLP": 0.85, "LDA": 0.9, "QDA": 0.85, "SVM": 0.85, "k-NN": 0.9, "DT": 0.8, "RF": 0.9}
    got = {}
    for name, pred in language_predictions(train, test).items():
        rows = [(r["label_idx"], r["prediction"]) for r in pred.collect()]
        got[name] = sum(a == b for a, b in rows) / len(rows)
    assert all(got[m] >= f for m, f in floors.items()), got


def test_knn_vote_is_told_without_a_search_where_all_near_cells_are_of_one_class(spark):
    """Rows of classes far apart meet no block; rows of one id have to agree, others are searched."""
    from flowforge.operators.classifiers import _knn_blocks, knn, knn_candidates

    rng = np.random.default_rng(5)
    schema = "id long, label_idx int, features array<double>"

    def rows(n, first):
        return [(first + i, i % 3, (rng.random(4) + 100 * (i % 3)).tolist()) for i in range(n)]
    train = spark.createDataFrame(rows(300, 0), schema)
    far = rows(60, 1000)
    te, _, sure = _knn_blocks(train, spark.createDataFrame(far, schema), 5, "label_idx", "features", "id", 64, vote=True)
    assert te.count() == 0
    assert sorted(map(tuple, sure.collect())) == [(r[0], r[1]) for r in far]

    twice = far + [far[0], (far[1][0], 0, [0.5] * 4), (2000, 1, [150.0] * 4), (2001, 2, [50.0] * 4)]
    test = spark.createDataFrame(twice, schema)
    got = knn(train, test, block_rows=64).collect()
    assert len(got) == len(twice)
    votes = {}
    for r in knn_candidates(train, test, 5, block_rows=64).collect():
        votes.setdefault(r["test_id"], []).append(r["nb_label"])
    assert {r["id"]: r["prediction"] for r in got} == {
        i: min(set(v), key=lambda c: (-v.count(c), c)) for i, v in votes.items()}


def test_letters_are_counted_in_one_pass_over_a_text(spark, tmp_path):
    """Shares as counted one letter at a time, odd texts included; a text is not read once a letter."""
    from flowforge.plans.q_models import LANGUAGES, LETTERS, language_features
    texts = ["Abc eéE o", "", None, "İo Kß \U0001f600e", "zzz\n\x00a", " "]
    rows = [(i, t, LANGUAGES[i % 4]) for i, t in enumerate(texts)] + [(90, "e", "xx"), (91, "e", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for letters in (LETTERS, "eo"):
        found = language_features(spark, str(tmp_path), letters)
        got = {r["id"]: (r["label_idx"], r["features"]) for r in found.collect()}
        want = {}
        for i, t, lang in rows[:len(texts)]:
            low = (t or "").lower()
            want[i] = (LANGUAGES.index(lang), [100.0 * low.count(c) / len(low) if low else 0.0 for c in letters])
        assert got == want
        assert found._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 0


def test_knn_fills_blocks_where_all_cells_are_visited(spark):
    """Rows that no cell can be ruled out for are copied to blocks of about the asked size, not to
    blocks of a cell each; results as brute force."""
    from flowforge.operators.classifiers import _knn_blocks, knn_candidates
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(2000, 40)), rng.normal(size=(600, 40))
    schema = "id long, label_idx int, features array<double>"
    train = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(x.tolist())], schema)
    test = spark.createDataFrame([(i, 0, v) for i, v in enumerate(q.tolist())], schema)
    te, tr = _knn_blocks(train, test, 5, "label_idx", "features", "id", 200)
    assert te.count() <= 600 * 20  # blocks are half full at least
    assert tr.count() <= 2000 * 8
    got = {}
    for r in knn_candidates(train, test, 5, block_rows=200).orderBy("test_id", "rank").collect():
        got.setdefault(r["test_id"], []).append(r["train_id"])
    d2 = ((q[:, None, :] - x[None]) ** 2).sum(-1)
    assert got == {i: np.lexsort((np.arange(2000), d))[:5].tolist() for i, d in enumerate(d2)}


def test_knn_screen_keeps_rows_beside_missing_numbers(spark):
    """Columns of NaN fill most groups of the screen; the finite rows are found all the same."""
    from flowforge.operators.classifiers import knn_candidates
    schema = "id long, label_idx int, features array<double>"
    rows = [(i, 0, [float(i)] * 2 if i % 40 == 0 else [float("nan")] * 2) for i in range(200)]
    train = spark.createDataFrame(rows, schema)
    got = knn_candidates(train, spark.createDataFrame([(1, 0, [81.0, 81.0])], schema), 3).orderBy("rank").collect()
    assert [r["train_id"] for r in got] == [80, 120, 40]


def test_network_is_trained_beside_the_other_models(spark, monkeypatch):
    """The network waits for a model that is fitted after it in order."""
    import threading
    from flowforge.plans import q_models as q
    fitted = threading.Event()
    empty = spark.createDataFrame([(1, 0, 0)], "id long, label_idx int, prediction int")

    def network():
        assert fitted.wait(60)
    monkeypatch.setattr(q.C, "model_runs", lambda *_: {
        "MLP": (network, lambda _: empty), "LDA": (fitted.set, lambda _: empty)})
    got = q.language_predictions(empty, empty)
    assert list(got) == ["MLP", "LDA"] and all(p.count() == 1 for p in got.values())


def test_network_is_timed_beside_the_other_models(spark):
    """The models are reported in their order, and the network is not waited for by the others."""
    import threading
    from flowforge.operators.classifiers import timed_runs
    others_done = threading.Event()

    def predict(name):
        return lambda _: spark.createDataFrame([(name,)], "name string")

    def wait():
        assert others_done.wait(60)
    runs = {"MLP": (wait, predict("MLP")), "LDA": (lambda: None, predict("LDA")), "DT": (others_done.set, predict("DT"))}
    done = timed_runs(spark, runs)
    assert list(done) == ["MLP", "LDA", "DT"]
    assert [done[m][0].first()["name"] for m in done] == ["MLP", "LDA", "DT"]
    assert all(a >= 0 and b >= 0 for _, a, b in done.values())


def test_knn_copies_of_a_row_do_not_grow_with_the_rows(spark):
    """Where no cell can be ruled out, a row is copied to a bounded number of blocks, however many
    blocks of the asked size there would be; results as brute force."""
    from flowforge.operators.classifiers import COPIES, _knn_blocks, knn_candidates
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(3000, 40)), rng.normal(size=(800, 40))
    schema = "id long, label_idx int, features array<double>"
    train = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(x.tolist())], schema)
    test = spark.createDataFrame([(i, 0, v) for i, v in enumerate(q.tolist())], schema)
    te, tr = _knn_blocks(train, test, 5, "label_idx", "features", "id", 10)
    assert te.count() <= 800 * 2 * COPIES and tr.count() <= 3000 * 2 * COPIES
    got = {}
    for r in knn_candidates(train, test, 5, block_rows=10).orderBy("test_id", "rank").collect():
        got.setdefault(r["test_id"], []).append(r["train_id"])
    d2 = ((q[:, None, :] - x[None]) ** 2).sum(-1)
    assert got == {i: np.lexsort((np.arange(3000), d))[:5].tolist() for i, d in enumerate(d2)}


def test_knn_block_search_is_exact_on_odd_rows():
    """Ties, rows with infinite or missing numbers, a far offset, bounds, blocks of few rows."""
    from flowforge.operators import classifiers
    rng = np.random.default_rng(10)
    x = np.vstack([rng.integers(0, 3, (700, 3)).astype(float), rng.normal(0, 1, (700, 3)), np.full((400, 3), 1.0)])
    q = np.vstack([rng.integers(0, 3, (300, 3)).astype(float), rng.normal(0, 1, (300, 3))])
    tid = rng.permutation(len(x))
    x[5], x[6], q[3], q[4] = [np.inf, 0, 0], [np.nan, 0, 0], [np.inf, 0, 0], [0, np.nan, 0]
    for own, at in ((x, 0.0), (x, 1e9), (x[:7], 0.0), (x[[5, 6]], 0.0)):
        y, z = own + at, q + at
        with np.errstate(invalid="ignore"):
            d2 = ((z[:, None, :] - y[None]) ** 2).sum(-1)
        want = []
        for i, d in enumerate(d2):
            best = np.lexsort((tid[:len(y)], d))[:5]
            want += [(i, c, d[c]) for c in best.tolist() if not np.isnan(d[c])]
        kth = np.full(len(z), np.inf)
        for i, _, d in want:
            kth[i] = np.sqrt(d)
        for bound in (np.full(len(z), np.inf), kth):
            got = sorted(zip(*(v.tolist() for v in classifiers._found(z, bound, y, tid[:len(y)], 5))))
            assert [g[:2] for g in got] == sorted(w[:2] for w in want)
            assert np.allclose([g[2] for g in got], [w[2] for w in sorted(want)], rtol=1e-12)


def test_knn_of_rows_alike_meets_few_of_them(spark):
    """Of training rows with the same features the k least ids are all that is dealt to blocks,
    repeated ids and test rows alike included; results as brute force."""
    from flowforge.operators.classifiers import _knn_blocks, knn, knn_candidates
    schema = "id long, label_idx int, features array<double>"
    tr = [(i // 2 * 7 % 3001, (i // 2 * 7 % 3001) % 3, [float(i % 3), float(i % 2)]) for i in range(3000)]
    te = [(9000 + i, i % 3, [float(i % 4), 0.5 * (i % 3)]) for i in range(60)]
    train, test = spark.createDataFrame(tr, schema), spark.createDataFrame(te, schema)
    _, dealt = _knn_blocks(train, test, 5, "label_idx", "features", "id", 100)
    assert dealt.count() <= 6 * 5 * 2
    x, ids = np.array([r[2] for r in tr]), np.array([r[0] for r in tr])
    got, votes = {}, {r["id"]: r["prediction"] for r in knn(train, test, block_rows=100).collect()}
    for r in knn_candidates(train, test, 5, block_rows=100).orderBy("test_id", "rank").collect():
        got.setdefault(r["test_id"], []).append(r["train_id"])
    want = {i: ids[np.lexsort((ids, ((x - np.array(q)) ** 2).sum(1)))[:5]].tolist() for i, _, q in te}
    assert got == want
    assert votes == {i: int(np.bincount([w % 3 for w in v]).argmax()) for i, v in want.items()}
