"""Scaler, clip and quantisation fixtures (FIXTURES §6)."""

import numpy as np
import pytest

from flowforge.operators.profile import column_stats, histogram
from flowforge.operators.scaling import Normalizer, clip, normalize_splits, quantize


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (9.0, 5.0)], "x double, c double")


def test_stats_match_numpy(small):
    st = {r["column"]: r for r in column_stats(small, ["x"]).collect()}["x"]
    x = np.array([1.0, 2.0, 4.0, 9.0])
    assert st["std"] == pytest.approx(np.std(x))
    assert st["q1"] == pytest.approx(np.percentile(x, 25))
    assert st["q3"] == pytest.approx(np.percentile(x, 75))


def test_minmax_constant_is_zero(small):
    out = Normalizer("min_max_scaling").fit_transform(small, ["x", "c"]).collect()
    assert [r["c"] for r in out] == [0.0] * 4
    assert [r["x"] for r in out] == pytest.approx([0.0, 1 / 8, 3 / 8, 1.0])


def test_zscore_population_std_and_constant_null(small):
    out = Normalizer("z_score_std").fit_transform(small, ["x", "c"]).collect()
    x = np.array([1.0, 2.0, 4.0, 9.0])
    assert [r["x"] for r in out] == pytest.approx(list((x - x.mean()) / x.std()))
    assert [r["c"] for r in out] == [None] * 4


def test_robust_centres_on_q1(small):
    out = Normalizer("robust_scaling").fit_transform(small, ["x", "c"]).collect()
    x = np.array([1.0, 2.0, 4.0, 9.0])
    q1, q3 = np.percentile(x, 25), np.percentile(x, 75)
    assert [r["x"] for r in out] == pytest.approx(list((x - q1) / (q3 - q1)))
    assert [r["c"] for r in out] == [0.0] * 4


def test_global_scaler(small):
    out = Normalizer("min_max_scaling", per_column=False).fit_transform(small, ["x", "c"]).collect()
    assert [r["c"] for r in out] == pytest.approx([0.5] * 4)


def test_transform_before_fit_and_unknown_method(small):
    with pytest.raises(RuntimeError):
        Normalizer().transform(small)
    with pytest.raises(ValueError):
        Normalizer("nope")


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-5.0,), (0.5,), (None,), (7.0,)], "x double")
    assert [r["x"] for r in clip(df, ["x"], -1, 1).collect()] == [-1.0, 0.5, None, 1.0]


def test_quantize(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "x double")
    model = Normalizer().fit(df, ["x"])
    assert [r["x"] for r in quantize(df, ["x"], model).collect()] == [-127, 0, 127]
    with pytest.raises(RuntimeError):
        quantize(df, ["x"], None)


def test_histogram_half_open_last_closed(spark):
    df = spark.createDataFrame([(-1.0,), (-0.8,), (0.99,), (1.0,), (1.5,)], "x double")
    got = {r["bin"]: r["count"] for r in histogram(df, ["x"], "min_max_scaling").collect()}
    assert got == {0: 1, 1: 1, 9: 2}


def test_normalize_splits_uses_train_stats(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 3.0), ("test", 5.0)], "split string, x double")
    out = {r["split"] + str(r["x"]) for r in normalize_splits(df, ["x"]).collect()}
    assert out == {"train-1.0", "train1.0", "test3.0"}


@pytest.mark.parametrize("max_bracket", [2_000_000, 40])
def test_exact_quartiles_with_hot_value_and_narrowing(spark, max_bracket):
    rnd = np.random.default_rng(0)
    n = 6000
    x = rnd.normal(size=n)
    y = np.where(rnd.random(n) < 0.4, 3.0, rnd.normal(size=n))  # a value holding 40 % of rows
    z = rnd.integers(0, 5, n).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, z)],
                               "x double, y double, z double")
    st = {r["column"]: r for r in column_stats(df, ["x", "y", "z"], accuracy=100,
                                               max_bracket=max_bracket).collect()}
    for c, arr in (("x", x), ("y", y), ("z", z)):
        assert st[c]["q1"] == pytest.approx(np.percentile(arr, 25), abs=1e-12)
        assert st[c]["q3"] == pytest.approx(np.percentile(arr, 75), abs=1e-12)


def test_label_index_fitted_on_train_and_inverse(spark):
    from flowforge.operators.scaling import apply_label_index, fit_label_index, index_to_label, one_hot
    train = spark.createDataFrame([("dos",), ("benign",), ("bot",), ("benign",)], "label string")
    test = spark.createDataFrame([("bot",), ("dos",)], "label string")
    model = fit_label_index(train)
    assert list(model.labels) == ["benign", "bot", "dos"]
    idx = apply_label_index(model, test)
    assert [r["label_idx"] for r in idx.collect()] == [1, 2]
    back = index_to_label(model, idx, "label_idx", "name")
    assert [r["name"] for r in back.collect()] == ["bot", "dos"]
    oh = one_hot(idx, "label_idx", 3).collect()
    assert [(r["class_0"], r["class_1"], r["class_2"]) for r in oh] == [(0, 1, 0), (0, 0, 1)]


def test_quantize_global(spark):
    df = spark.createDataFrame([(-1.0, 0.0), (1.0, 0.5)], "a double, b double")
    model = Normalizer(per_column=False).fit(df, ["a", "b"])
    out = quantize(df, ["a", "b"], model, per_column=False).collect()
    assert [(r["a"], r["b"]) for r in out] == [(-127, 0), (127, 63)]


def test_quartiles_of_many_columns(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 72)) * 10, 1)
    x[:150, 3] = 7.5  # a hot value
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"c{i}" for i in range(72)])
    got = {r["column"]: (r["q1"], r["q3"]) for r in
           column_stats(df, df.columns, accuracy=200, max_bracket=20).collect()}
    for i in range(72):
        want = np.percentile(x[:, i], [25, 75])
        assert abs(got[f"c{i}"][0] - want[0]) < 1e-9 and abs(got[f"c{i}"][1] - want[1]) < 1e-9


def test_constant_text_columns(spark):
    from flowforge.operators.profile import constant_features
    rows = [(s, "same", f"of {s}", str(i % 2), None if i else "once") for s in ("train", "crossval", "test")
            for i in range(4)]
    df = spark.createDataFrame(rows, "split string, a string, b string, c string, d string")
    assert sorted(r[0] for r in constant_features(df).collect()) == ["a", "b", "d"]
