"""Boundary rows of the five capture days (FIXTURES §5) and rule semantics."""

import pytest
from pyspark.sql import functions as F

from flowforge.operators.capture_rules import CAPTURE_DAYS
from flowforge.operators.labelling import (Drop, FlowFields, Rule, apply_drops, label_by_day,
                                           label_flows, label_flows_join, rules_frame)

A, V, C = "172.16.0.1", "192.168.10.50", "205.174.165.73"
SCHEMA = ("id int, day string, src_addr string, src_port bigint, dst_addr string, "
          "dst_port bigint, ip_prot bigint, timestamp bigint, label string")

# (day, src, src_port, dst, dst_port, prot, ts, incoming label, expected; None = dropped)
CASES = [
    ("monday", "1.1.1.1", 1, "2.2.2.2", 2, 6, 5, "x", "benign"),
    ("tuesday", A, 1, V, 21, 6, 1499170620000000, "NeedLabel", "ftp_patator"),
    ("tuesday", A, 1, V, 21, 6, 1499170619999999, "NeedLabel", "benign"),
    ("tuesday", A, 1, V, 21, 6, 1499175000000000, "NeedLabel", "ftp_patator"),
    ("tuesday", A, 1, V, 9999, 17, 1499188140000000, "NeedLabel", "ssh_patator"),
    ("tuesday", V, 1, A, 21, 6, 1499170620000000, "NeedLabel", "benign"),
    ("tuesday", A, 1, V, 21, 6, None, "NeedLabel", "benign"),
    ("tuesday", "9.9.9.9", 1, V, 21, 6, 5, "other", "other"),
    ("wednesday", A, 45022, "192.168.10.51", 444, 6, 5, "NeedLabel", "heartbleed"),
    ("wednesday", A, 1, V, 80, 6, 1499275440000000, "NeedLabel", "dos_slowloris"),
    ("wednesday", A, 1, V, 443, 6, 1499262180000000, "NeedLabel", "benign"),
    ("wednesday", A, 1, V, 80, 6, 1499263700000000, "NeedLabel", "benign"),
    ("thursday", A, 1, V, 80, 17, 1499343300000000, "NeedLabel", "benign"),
    ("thursday", "3.3.3.3", 1, "4.4.4.4", 80, 6, 1499353200000000, "NeedLabel", None),
    ("thursday", "3.3.3.3", 1, "4.4.4.4", 80, 6, 1499353199999999, "NeedLabel", "benign"),
    ("thursday", "3.3.3.3", 1, "4.4.4.4", 80, 6, None, "NeedLabel", "benign"),
    ("friday", "5.5.5.5", 1, C, 80, 6, 1499436122000000, "NeedLabel", "bot"),
    ("friday", "5.5.5.5", 1, C, 80, 6, 1499436122000001, "NeedLabel", "benign"),
    ("friday", "5.5.5.5", 1, C, 80, 6, 1499436193000000, "NeedLabel", "benign"),
    ("friday", "5.5.5.5", 1, C, 80, 6, 1499436193000001, "NeedLabel", None),
    ("friday", "5.5.5.5", 1, "52.6.13.28", 80, 6, 5, "NeedLabel", None),
    ("friday", "5.5.5.5", 1, "52.7.235.158", 80, 6, None, "NeedLabel", None),
    ("friday", A, 1, V, 80, 6, 1499451842000000, "NeedLabel", "portscan"),
    ("friday", A, 1, V, 80, 6, 1499453791000000, "NeedLabel", "ddos"),
]


@pytest.fixture(scope="module")
def flows(spark):
    rows = [(i, *c[:8]) for i, c in enumerate(CASES)]
    return spark.createDataFrame(rows, SCHEMA)


def test_capture_day_boundaries(flows):
    out = {r["id"]: r["label"] for r in label_by_day(flows, "day", CAPTURE_DAYS).collect()}
    for i, case in enumerate(CASES):
        expected = case[-1]
        if expected is None:
            assert i not in out, f"row {i} {case} should be dropped"
        else:
            assert out.get(i) == expected, f"row {i} {case}: got {out.get(i)}"


def test_unknown_day_raises(spark, flows):
    bad = flows.withColumn("day", F.lit("saturday"))
    with pytest.raises(Exception, match="unknown capture day"):
        label_by_day(bad, "day", CAPTURE_DAYS).collect()


def test_last_rule_wins_and_sentinel_only(spark):
    df = spark.createDataFrame([(1, "a", 10, "NeedLabel"), (2, "a", 99, "keep"), (3, "b", 10, None)],
                               "id int, dst_addr string, timestamp bigint, label string")
    rules = [Rule("first", dst_addr="a", ts_lo=0, ts_hi=20), Rule("second", dst_addr="a", ts_lo=5, ts_hi=15)]
    out = {r["id"]: r["label"] for r in label_flows(df, rules).collect()}
    assert out == {1: "second", 2: "keep", 3: None}


def test_null_operand_keeps_row(spark):
    df = spark.createDataFrame([(1, None), (2, 10), (3, 1)], "id int, timestamp bigint")
    kept = {r["id"] for r in apply_drops(df, [Drop(ts_op=">=", ts=5)], FlowFields()).collect()}
    assert kept == {1, 3}


def test_join_form_equals_case_form(spark):
    import random
    rnd = random.Random(1)
    dsts = ["a", "b", "c"]
    rules = [Rule(f"l{i}", dst_addr=rnd.choice(dsts),
                  src_addr=rnd.choice([None, "s1", "s2"]),
                  ts_lo=rnd.randint(0, 50), ts_hi=rnd.randint(50, 100)) for i in range(12)]
    rows = [(i, rnd.choice(["s1", "s2", "s3"]), rnd.choice(dsts + ["d"]),
             rnd.choice([None] + list(range(0, 110, 3))), rnd.choice(["NeedLabel", "x"]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "id int, src_addr string, dst_addr string, timestamp bigint, label string")
    a = {r["id"]: r["label"] for r in label_flows(df, rules).collect()}
    b = {r["id"]: r["label"] for r in label_flows_join(df, rules_frame(spark, rules)).collect()}
    assert a == b
    rules_open = rules + [Rule("open", dst_addr="b", src_addr="s2"), Rule("late", dst_addr="a", ts_lo=90)]
    a2 = {r["id"]: r["label"] for r in label_flows(df, rules_open).collect()}
    c = {r["id"]: r["label"] for r in
         label_flows_join(df, rules_frame(spark, rules_open), time_bucket_us=7).collect()}
    assert a2 == c


def test_join_form_needs_endpoint(spark):
    df = spark.createDataFrame([(1, "a", 1, "NeedLabel")], "id int, dst_addr string, timestamp bigint, label string")
    with pytest.raises(ValueError):
        label_flows_join(df, rules_frame(spark, [Rule("x")]))


def test_join_form_shuffle_path_equals_broadcast(spark):
    rules = [Rule("x", dst_addr="hot", ts_lo=0, ts_hi=50), Rule("y", dst_addr="hot", ts_lo=40, ts_hi=60),
             Rule("z", dst_addr="cold")]
    # one endpoint holds most rows (hot key)
    rows = [(i, "s", "hot" if i % 4 else "cold", i % 100, "NeedLabel") for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, src_addr string, dst_addr string, timestamp bigint, label string")
    rf = rules_frame(spark, rules)
    a = {r["id"]: r["label"] for r in label_flows_join(df, rf).collect()}
    b = {r["id"]: r["label"] for r in label_flows_join(df, rf, broadcast_max_endpoints=0).collect()}
    c = {r["id"]: r["label"] for r in label_flows(df, rules).collect()}
    assert a == b == c


def test_join_salts_hot_endpoints_and_counts_listed_rules(spark):
    from flowforge.operators.labelling import Rule, label_flows, label_flows_join, rules_frame
    rules = [Rule("a", dst_addr="hot", ts_lo=0, ts_hi=10 ** 6), Rule("b", dst_addr="hot", dst_port=3),
             Rule("c", dst_addr="cold", ts_lo=5, ts_hi=4), Rule("d", dst_addr="cold", dst_port=1)]
    flows = spark.createDataFrame(
        [(i, "hot" if i % 10 else "cold", i % 5, i * 7, "NeedLabel") for i in range(600)] + [(600, None, 1, 1, "x")],
        "id long, dst_addr string, dst_port long, timestamp long, label string")
    want = sorted(map(tuple, label_flows(flows, rules).collect()))
    table = rules_frame(spark, rules)
    # one rule overlaps 100,001 buckets: counted as listed, it is too large to broadcast
    bucketed = label_flows_join(flows, table, time_bucket_us=10, broadcast_max_rules=1000)
    plain = label_flows_join(flows, table, broadcast_max_rules=0)
    for out in (bucketed, plain):
        assert "_f_salt" not in out.columns
        assert sorted(map(tuple, out.select(flows.columns).collect())) == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" not in plan
