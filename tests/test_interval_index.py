"""The interval index against a plain search, on large and odd rule tables."""

import random

import pytest

RULES = ("seq long, src_addr string, src_port bigint, dst_addr string, dst_port bigint, ip_prot bigint, "
         "ts_lo bigint, ts_hi bigint, label string")
FLOWS = "id long, src_addr string, dst_addr string, dst_port long, timestamp long, label string"


def plain(flow, rules):
    _, src, dst, port, ts, label = flow
    best = None
    for seq, rs, rsp, rd, rp, prot, lo, hi, lab in rules:
        if rd != dst or rd is None or rsp is not None or prot is not None:
            continue
        if (rs is None or rs == src) and (rp is None or rp == port) and (lo is None or (ts is not None and ts >= lo)) \
                and (hi is None or (ts is not None and ts <= hi)) and (best is None or seq > best[0]):
            best = (seq, lab)
    return best[1] if best else ("benign" if label == "NeedLabel" else label)


def test_elementary_and_dyadic():
    from flowforge.operators.interval_index import dyadic, elementary
    r = random.Random(0)
    for _ in range(200):
        n = r.randint(1, 12)
        lo = [r.randint(0, 20) for _ in range(n)]
        hi = [a + r.randint(0, 9) for a in lo]
        seq = r.sample(range(100), n)
        got = elementary(lo, hi, seq)
        assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
        for t in range(-1, 32):
            want = max(((s, i) for i, s in enumerate(seq) if lo[i] <= t <= hi[i]), default=(None, None))[1]
            assert next((i for a, b, i in got if a <= t <= b), None) == want
    for a in range(16):
        for b in range(a, 16):
            nodes = dyadic(a, b, 16)
            below = sorted(x for n in nodes for x in range(n * (16 >> (n.bit_length() - 1)) - 16,
                                                           (n + 1) * (16 >> (n.bit_length() - 1)) - 16))
            assert below == list(range(a, b + 1)) and len(nodes) <= 8


@pytest.mark.parametrize("max_rules", [4096, 16])
def test_equals_a_plain_search(spark, max_rules):
    from flowforge.operators.interval_index import label_flows_indexed
    r = random.Random(1)
    rules = []
    for seq in range(700):
        dst = r.choice(["hot", "hot", "hot", "b", "c"])
        lo = r.randint(0, 5000) if r.random() < 0.9 else None
        hi = (lo or 0) + r.choice([0, 5, 300, 4000]) if r.random() < 0.9 else None
        rules.append((seq, r.choice([None, None, "s1", "s2"]), 9 if r.random() < 0.03 else None, dst,
                      r.choice([None, None, 80, 22]), None, lo, hi, f"l{r.randint(0, 9)}"))
    rules += [(900, None, None, "b", None, 6, None, None, "protocol"), (901, None, None, "c", None, None, 50, 40, "empty")]
    r.shuffle(rules)
    flows = [(i, r.choice(["s1", "s2", "s3", None]), r.choice(["hot", "hot", "hot", "b", "c", "d", None]),
              r.choice([80, 22, 7, None]), r.choice([None, r.randint(-10, 9100)]) if r.random() < 0.2 else r.randint(0, 6000),
              r.choice(["NeedLabel", "NeedLabel", "known", None])) for i in range(3000)]
    flows += [(5000 + i, "s1", "hot", 80, 77, "NeedLabel") for i in range(2500)]  # one time holds many flows
    got = {q["id"]: q["label"] for q in label_flows_indexed(
        spark.createDataFrame(flows, FLOWS).repartition(4), spark.createDataFrame(rules, RULES),
        max_rules=max_rules).collect()}
    assert len(got) == len(flows)
    for f in flows:
        assert got[f[0]] == plain(f, rules), f


def test_a_million_rules_on_one_endpoint(spark):
    """No sweep gets more than a bounded part of them."""
    from pyspark.sql import functions as F

    from flowforge.operators import interval_index as x
    rules = spark.range(1_000_000).select(
        F.col("id").alias("seq"), F.lit(None).cast("string").alias("src_addr"), F.lit(None).cast("long").alias("src_port"),
        F.lit("one").alias("dst_addr"), F.lit(None).cast("long").alias("dst_port"), F.lit(None).cast("long").alias("ip_prot"),
        (F.col("id") * 7919 % 1_000_003 * 10).alias("ts_lo"),
        (F.col("id") * 7919 % 1_000_003 * 10 + F.when(F.col("id") % 1000 == 0, 4_000_000).otherwise(25)).alias("ts_hi"),
        F.concat(F.lit("r"), F.col("id")).alias("label"))
    own = rules.select("dst_addr", F.col("ts_lo").alias("lo"), F.col("ts_hi").alias("hi"), "seq", "label")
    clipped, cuts, size = x._with_ranges(own, ["dst_addr"], 4096)
    sizes = clipped.groupBy("part").count().agg(F.max("count"), F.count("part")).first()
    assert sizes[1] > 200 and sizes[0] < 3 * 4096 and size >= 256
    flows = spark.createDataFrame([(i, "s", "one", 1, i * 9973 % 10_000_030, "NeedLabel") for i in range(500)], FLOWS)
    got = {q["id"]: q["label"] for q in x.label_flows_indexed(flows, rules).collect()}
    lo = [k * 7919 % 1_000_003 * 10 for k in range(1_000_000)]
    at = {v: k for k, v in enumerate(lo)}
    for i in range(500):
        t = i * 9973 % 10_000_030
        near = [at[v] for v in range(max(t - 25, 0), t + 1) if v in at]
        wide = [k for k in range(0, 1_000_000, 1000) if lo[k] <= t <= lo[k] + 4_000_000]
        want = max(near + wide, default=None)
        assert got[i] == (f"r{want}" if want is not None else "benign")


def test_a_wildcard_destination_is_refused(spark):
    from flowforge.operators.interval_index import label_flows_indexed
    flows = spark.createDataFrame([(1, "s", "d", 1, 5, "NeedLabel")], FLOWS)
    with pytest.raises(ValueError, match="destination"):
        label_flows_indexed(flows, spark.createDataFrame([(1,) + (None,) * 7 + ("x",)], RULES))
    assert label_flows_indexed(flows, spark.createDataFrame([], RULES)).first()["label"] == "benign"
