"""Split cut points (golden counts), exactness and partition independence."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowforge.functions.exprs import hash_key
from flowforge.operators.split import (hash_rank, head_percent, split_cut_points,
                                       stratified_split, subsamples)
from flowforge.schema import CANONICAL_CLASSES, TRAIN_PERCENTAGES

# Golden class sizes and (train, cv=test) counts of the two dataset builds.
ORIGINAL = {
    "benign": (2272688, 220316, 110158), "bot": (1966, 367, 183), "ddos": (128027, 47841, 23920),
    "dos_goldeneye": (10293, 3382, 1691), "dos_hulk": (230124, 79494, 39747),
    "dos_slowhttptest": (5499, 2433, 1216), "dos_slowloris": (5796, 2837, 1418),
    "ftp_patator": (7938, 2001, 1000), "heartbleed": (11, 5, 2), "portscan": (158930, 79465, 39732),
    "ssh_patator": (5897, 1479, 739), "webattack_bruteforce": (1507, 680, 340),
    "webattack_sql_injection": (21, 6, 3), "webattack_xss": (652, 326, 163), "Infiltration": (36, 0, 0),
}
GENERATED = {
    "benign": (1395675, 220316, 110158), "bot": (735, 367, 183), "ddos": (95683, 47841, 23920),
    "dos_goldeneye": (6765, 3382, 1691), "dos_hulk": (158988, 79494, 39747),
    "dos_slowhttptest": (4866, 2433, 1216), "dos_slowloris": (5674, 2837, 1418),
    "ftp_patator": (4003, 2001, 1000), "heartbleed": (11, 5, 2), "portscan": (160106, 79465, 39732),
    "ssh_patator": (2959, 1479, 739), "webattack_bruteforce": (1360, 680, 340),
    "webattack_sql_injection": (12, 6, 3), "webattack_xss": (661, 326, 163),
}


@pytest.mark.parametrize("dataset,golden,names", [
    ("original", ORIGINAL, CANONICAL_CLASSES + ["Infiltration"]),
    ("generated", GENERATED, CANONICAL_CLASSES),
])
def test_golden_cut_points(dataset, golden, names):
    pct = dict(zip(names, TRAIN_PERCENTAGES[dataset]))
    cuts = split_cut_points({k: v[0] for k, v in golden.items()}, pct)
    for label, (_, tr, cv) in golden.items():
        assert cuts[label] == (tr, cv, cv), label
    totals = [sum(c[i] for c in cuts.values()) for i in range(3)]
    assert totals == [440632, 220312, 220312]


def test_percentages_over_100(spark):
    df = spark.createDataFrame([(1, "a")], "id int, label string")
    with pytest.raises(ValueError):
        stratified_split(df, "label", ["id"], {"a": (60, 30, 20)})


def _frame(spark, n=3000, parts=4):
    rows = [(i, "big" if i % 10 < 7 else ("mid" if i % 10 < 9 else "small")) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label string").repartition(parts)


def test_two_level_rank_equals_plain_window(spark):
    df = _frame(spark)
    ranked = hash_rank(df, ["label"], ["id"], 5, target_rows_per_bucket=50, max_prefix=2)
    w = Window.partitionBy("label").orderBy(hash_key(["id"], 5), "id")
    plain = df.withColumn("rk", F.row_number().over(w))
    a = {(r["id"], r["_rank"]) for r in ranked.collect()}
    b = {(r["id"], r["rk"]) for r in plain.collect()}
    assert a == b


def test_split_exact_disjoint_and_partition_independent(spark):
    pct = {"big": 20.0, "mid": 50.0, "small": (10.0, 10.0, 80.0)}
    a = stratified_split(_frame(spark, parts=1), "label", ["id"], pct, seed=3)
    b = stratified_split(_frame(spark, parts=17), "label", ["id"], pct, seed=3, rows_per_bucket=20)
    ra = {(r["id"], r["split"]) for r in a.collect()}
    rb = {(r["id"], r["split"]) for r in b.collect()}
    assert ra == rb
    ids = [i for i, _ in ra]
    assert len(ids) == len(set(ids))
    counts = {}
    for r in a.groupBy("label", "split").count().collect():
        counts[(r["label"], r["split"])] = r["count"]
    assert counts[("big", "train")] == int(2100 * 20.0 / 100)
    assert counts[("big", "crossval")] == int(2100 * 10.0 / 100)
    assert counts[("small", "test")] == int(300 * 80.0 / 100)


def test_head_percent_multi_bucket(spark):
    df = spark.createDataFrame([(i * 7 % 1000, i) for i in range(1000)], "k long, v long").repartition(5)
    out = head_percent(df, 33.3, ["k"], rows_per_bucket=50)
    got = sorted(r["k"] for r in out.collect())
    assert got == sorted(r["k"] for r in df.orderBy("k").limit(333).collect())


def test_subsamples_sizes(spark):
    df = spark.range(100).withColumnRenamed("id", "key")
    out = subsamples(df, 3, ["key"], seed=1)
    sizes = {r["subset_id"]: r["count"] for r in out.groupBy("subset_id").count().collect()}
    assert sizes == {1: 34, 2: 34, 3: 34}
    assert out.select("subset_id", "key").distinct().count() == 102


def test_split_ignores_input_order(spark):
    pct = {"big": 20.0, "mid": 50.0, "small": 50.0}
    df = _frame(spark, parts=3)
    shuffled = df.orderBy(F.md5(F.col("id").cast("string"))).repartition(7)
    a = {(r["id"], r["split"]) for r in stratified_split(df, "label", ["id"], pct, seed=9).collect()}
    b = {(r["id"], r["split"]) for r in stratified_split(shuffled, "label", ["id"], pct, seed=9).collect()}
    assert a == b


def test_seed_changes_selection(spark):
    pct = {"big": 20.0, "mid": 50.0, "small": 50.0}
    df = _frame(spark, parts=3)
    a = {(r["id"], r["split"]) for r in stratified_split(df, "label", ["id"], pct, seed=1).collect()}
    b = {(r["id"], r["split"]) for r in stratified_split(df, "label", ["id"], pct, seed=2).collect()}
    assert a != b and len(a) == len(b)


def test_head_percent_recursive_and_ties(spark):
    # a hot tied value around the cut, a second order column, few rows per bucket
    rows = [(5 if i % 3 == 0 else i, (i * 37) % 1001, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, k2 long, v long").repartition(4)
    out = head_percent(df, 40.0, ["k", "k2"], rows_per_bucket=60)
    want = sorted((r["k"], r["k2"]) for r in df.orderBy("k", "k2").limit(600).collect())
    assert sorted((r["k"], r["k2"]) for r in out.collect()) == want


def test_head_percent_text_nulls_and_nan(spark):
    import math
    rows = [(None if i % 7 == 0 else f"k{(i * 37) % 90:03d}", float("nan") if i % 5 == 0 else float(i % 13), i)
            for i in range(900)]
    df = spark.createDataFrame(rows, "k string, x double, v long").repartition(6)
    key = lambda r: (r[0] is None, r[0] or "")
    for pct in (10.0, 55.5, 95.0):
        got = [tuple(r) for r in head_percent(df, pct, ["k"], rows_per_bucket=40).collect()]
        k = int(900 * pct / 100)
        want = sorted(rows, key=key)
        assert len(got) == k and len({r[2] for r in got}) == k
        assert sorted(map(key, got)) == [key(r) for r in want[:k]]
        x = sorted(r["x"] for r in head_percent(df, pct, ["x"], rows_per_bucket=40).collect()
                   if not math.isnan(r["x"]))
        assert x == sorted(r[1] for r in rows if not math.isnan(r[1]))[:k]


def test_no_full_row_is_shuffled(spark):
    df = _frame(spark).withColumn("wide", F.repeat(F.col("label"), 50))
    split = stratified_split(df, "label", ["id"], {"big": 20.0, "mid": 50.0}, seed=3)
    head = head_percent(df.withColumn("k", F.col("id").cast("string")), 30.0, ["k"], rows_per_bucket=100)
    for out in (split, head):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan


def test_cuts_inside_repeated_rows(spark):
    # half of each class is one and the same row, many others come twice
    rows = [("a", 1 if i % 2 else i // 4) for i in range(400)] + [("b", 7)] * 100 + [(None, 3)] * 10
    df = spark.createDataFrame(rows, "label string, v long").repartition(5)
    for bucket in (10, 1_000_000):
        out = stratified_split(df, "label", ["label", "v"], {"a": (30, 25, 20), "b": (33, 33, 33)},
                               rows_per_bucket=bucket)
        got = {(r[0], r[1]): r[2] for r in out.groupBy("label", "split").count().collect()}
        assert got == {("a", "train"): 120, ("a", "crossval"): 100, ("a", "test"): 80,
                       ("b", "train"): 33, ("b", "crossval"): 33, ("b", "test"): 33}
        left = df.filter("label is not null").exceptAll(out.drop("split")).count()
        assert left == 500 - 300 - 99
    sub = subsamples(df, 3, ["v"], seed=2, rows_per_bucket=10)
    assert {r[0]: r[1] for r in sub.groupBy("subset_id").count().collect()} == {1: 170, 2: 170, 3: 170}
    assert head_percent(df, 50.0, ["v"], rows_per_bucket=10).count() == 255


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "label string, v long")
    assert stratified_split(df, "label", ["v"], {"a": 50.0}).count() == 0
    assert subsamples(df, 3, ["v"]).count() == 0
    assert head_percent(df, 50.0, ["v"]).count() == 0


def test_set_order_is_worked_out_once_a_row(spark):
    """The sort compares a column; an expression in it would be hashed in every comparison."""
    from flowforge.functions.exprs import hash_key
    from flowforge.operators.split import row_order, shuffle_sets, stratified_split

    df = spark.range(500).selectExpr("id", "cast(id % 3 as string) as label", "id / 7.0 as x")
    keys = df.columns
    sets = stratified_split(df, "label", keys, {"0": 40, "1": 50})
    shuffled = shuffle_sets(sets, ["split"], keys)
    plan = shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Sort [" in line and "md5" in line]

    # stored keys give the same sets in the same order
    stored = df.withColumns({"_a": row_order(df, keys, 0), "_b": hash_key(keys, "shuffle")})
    again = stratified_split(stored, "label", keys, {"0": 40, "1": 50}, order="_a")
    assert again.columns == [*keys, "_b", "split"]
    assert shuffle_sets(again, ["split"], keys, order="_b").collect() == shuffled.collect()
