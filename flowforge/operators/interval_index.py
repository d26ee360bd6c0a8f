"""Rule labelling over an interval index, for very large rule tables.

A rule names its destination endpoint, may name further fields, and may have a time
window; the last matching rule wins.  Rules that name the same fields form a *shape*.
Inside a shape a key (the values of these fields) has *elementary intervals*: disjoint
time ranges, each with the rule of highest number that covers it, found by a sort and a
sweep over the rules of the key.  A flow looks its time up in the intervals of its key by
binary search, once per shape, and the highest of these winners is its rule.

A key with more than ``max_rules`` rules is cut into time ranges at approximate quantiles
of its window ends.  A rule is swept only in the (at most two) ranges that it covers in
part; over ranges that it covers whole, only the highest rule counts, kept per dyadic
group of ranges.  So no task and no row holds more than about ``2 * max_rules`` rules of
a key, whatever their number, and a rule table of n rules becomes at most ``O(n)``
intervals.  Flows meet intervals in buckets of bounded size; a (key, range) with more
than one in ``HOT`` of all flows is dealt over ``SALTS`` buckets with its intervals
repeated.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowforge.operators.labelling import DEFAULT_LABEL, NEED_LABEL, FlowFields

MAX_RULES = 4096
FLOWS_PER_BUCKET = 200_000
RULES_PER_BUCKET = 200_000
HOT, SALTS = 200, 32
OPTIONAL = ("src_addr", "src_port", "dst_port", "ip_prot")
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def elementary(lo, hi, seq) -> list[tuple[int, int, int]]:
    """Disjoint (from, to, position of the rule of highest ``seq``), rising in time."""
    order = sorted(range(len(lo)), key=lambda i: lo[i])
    points = sorted({*lo, *(h + 1 for h in hi)})
    heap, out, k = [], [], 0
    for p, after in zip(points, points[1:]):
        while k < len(order) and lo[order[k]] == p:
            heapq.heappush(heap, (-seq[order[k]], order[k]))
            k += 1
        while heap and hi[heap[0][1]] < p:
            heapq.heappop(heap)
        if heap:
            best = heap[0][1]
            if out and out[-1][2] == best and out[-1][1] == p - 1:
                out[-1] = (out[-1][0], after - 1, best)
            else:
                out.append((p, after - 1, best))
    return out


def dyadic(first: int, last: int, size: int) -> list[int]:
    """Nodes (root 1, children 2i and 2i + 1) of a tree over ``size`` ranges, a power of
    two, that together cover the ranges first to last."""
    out, a, b = [], first + size, last + size + 1
    while a < b:
        if a & 1:
            out.append(a)
            a += 1
        if b & 1:
            b -= 1
            out.append(b)
        a, b = a >> 1, b >> 1
    return out


def _with_ranges(rules: DataFrame, key: list[str], max_rules: int):
    """(clipped rules with column ``part``, cut points per large key as {key: values})."""
    large = rules.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_rules)
    most = large.agg(F.max("n")).first()[0]
    if most is None:
        return rules.withColumn("part", F.lit(0)), {}, None
    size = 1 << math.ceil(math.log2(2 * most / max_rules))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    keys = F.broadcast(large.select(*key).alias("k"))  # at most one key in max_rules rules
    of_large = rules.alias("r").join(keys, on, "left_semi")
    ends = of_large.select(*key, F.explode(F.array("lo", F.when(F.col("hi") < _HIGH, F.col("hi") + 1))).alias("e")) \
        .filter(F.col("e").isNotNull() & (F.col("e") > _LOW))
    found = ends.groupBy(*key).agg(F.percentile_approx(
        "e", F.array(*[F.lit(i / size) for i in range(1, size)]), 20 * size).alias("cuts")).collect()
    cuts = {tuple(r[c] for c in key): np.unique(np.array(r["cuts"], np.int64)) for r in found}
    sent = rules.sparkSession.sparkContext.broadcast(cuts)

    def clip(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                own = sent.value[tuple(r[c] for c in key)]
                a, z = (int(np.searchsorted(own, r[c], side="right")) for c in ("lo", "hi"))
                first, last = a, z  # ranges covered whole: only the two at the ends may not be
                for p in sorted({a, z}):
                    start, end = (_LOW if p == 0 else int(own[p - 1])), (_HIGH if p == len(own) else int(own[p]) - 1)
                    if r["lo"] > start or r["hi"] < end:
                        rows.append({**r, "part": p, "lo": max(r["lo"], start), "hi": min(r["hi"], end), "node": None})
                        first, last = (a + 1 if p == a else first), (z - 1 if p == z else last)
                if first <= last:
                    rows += [{**r, "part": None, "node": n} for n in dyadic(first, last, size)]
            yield pa.RecordBatch.from_pylist(rows, schema=out_schema)

    schema = T.StructType([*rules.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("node", T.IntegerType())])
    out_schema = to_arrow_schema(schema)
    clipped = of_large.mapInArrow(clip, schema)
    in_part = clipped.filter("part is not null").drop("node")
    # the highest rule over whole ranges, per dyadic node, goes down to each of its ranges
    high = clipped.filter("node is not null").groupBy(*key, "node").agg(F.max(F.struct("seq", "label")).alias("b"))

    def spread(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                own, node = sent.value[tuple(r[c] for c in key)], r["node"]
                below = size >> (node.bit_length() - 1)  # ranges under the node
                for p in range(node * below - size, min((node + 1) * below - size, len(own) + 1)):
                    rows.append({**{c: r[c] for c in key}, "seq": r["b"]["seq"], "label": r["b"]["label"], "part": p,
                                 "lo": _LOW if p == 0 else int(own[p - 1]), "hi": _HIGH if p == len(own) else int(own[p]) - 1})
            yield pa.RecordBatch.from_pylist(rows, schema=down_schema)

    down = T.StructType([f for f in schema.fields if f.name != "node"])
    down_schema = to_arrow_schema(down)
    whole = high.mapInArrow(spread, down).groupBy(*key, "part", "lo", "hi") \
        .agg(F.max(F.struct("seq", "label")).alias("b")).select(*key, "part", "lo", "hi", "b.seq", "b.label")
    rest = rules.alias("r").join(keys, on, "left_anti").withColumn("part", F.lit(0))
    names = rest.columns
    return rest.unionByName(in_part.select(*names)).unionByName(whole.select(*names)), cuts, size


def _intervals(rules: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """(key, part, lo, hi, seq, label) elementary intervals."""
    def sweep(t: pa.Table) -> pa.Table:
        pdf = t.to_pandas(types_mapper=pd.ArrowDtype)
        out = []
        for _, g in pdf.groupby([*key, "part"], dropna=False, sort=False):
            lo, hi, seq = (g[c].to_numpy(np.int64).tolist() for c in ("lo", "hi", "seq"))
            label = g["label"].tolist()
            own = g.iloc[0]
            for a, b, i in elementary(lo, hi, seq):
                out.append({**{c: own[c] for c in key}, "part": int(own["part"]), "lo": a, "hi": b, "seq": seq[i],
                            "label": label[i]})
        return pa.Table.from_pylist([{k: (None if v is pd.NA else v) for k, v in r.items()} for r in out],
                                    schema=out_schema)

    names = [*key, "part", "lo", "hi", "seq", "label"]
    schema = T.StructType([rules.schema[c] for c in names])
    out_schema = to_arrow_schema(schema)
    return (rules.select(*names).withColumn("b", F.pmod(F.xxhash64(*key, "part"), F.lit(buckets)))
            .groupBy("b").applyInArrow(lambda t: sweep(t.drop_columns(["b"])), schema))


def _lookup(flows: DataFrame, base: DataFrame, intervals: DataFrame, key: list[str], columns: dict, cuts: dict, buckets: int,
            timed: bool) -> DataFrame:
    """``flows`` with (_seq, _label) raised to the winner of this shape; ``base`` are the
    flows before any shape, on which hot keys are counted."""
    ts = F.col("_ts") if timed else F.lit(0).cast("long")
    part = F.lit(0)
    if cuts:
        sent = flows.sparkSession.sparkContext.broadcast(cuts)

        @F.pandas_udf("int")
        def part_of(k: pd.DataFrame, t: pd.Series) -> pd.Series:
            out = np.zeros(len(t), np.int32)
            at = t.fillna(0).to_numpy(np.int64)
            names = [tuple(None if pd.isna(v) else v for v in r) for r in k.itertuples(index=False)]
            for name, own in sent.value.items():
                rows = np.flatnonzero(np.fromiter((n == name for n in names), bool, len(names)))
                out[rows] = np.searchsorted(own, at[rows], side="right")
            return pd.Series(out)

        part = part_of(F.struct(*[F.col(columns[c]).alias(c) for c in key]), ts)
    can = F.lit(True)
    for c in key:
        can = can & F.col(columns[c]).isNotNull()
    if timed:
        can = can & F.col("_ts").isNotNull()
    flows, base = (d.withColumn("_part", F.when(can, part)) for d in (flows, base))
    counts = base.filter("_part is not null").groupBy(*[F.col(columns[c]).alias(c) for c in key], "_part") \
        .agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.filter(F.col("n") > max(total / HOT, 1000)).drop("n").withColumnRenamed("_part", "_p")
                      .withColumnsRenamed({c: f"_h_{c}" for c in key}).withColumn("_hot", F.lit(1)))

    def with_hot(df, of, part_name):
        on = F.col(part_name) == F.col("_p")
        for c in key:
            on = on & (F.col(of[c]) == F.col(f"_h_{c}"))
        return df.join(hot, on, "left").drop("_p", *[f"_h_{c}" for c in key])

    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*flows.columns), F.lit(SALTS))).otherwise(F.lit(0))
    place = F.when(F.col("_part").isNull(), F.pmod(F.xxhash64(*flows.columns), F.lit(buckets))).otherwise(
        F.pmod(F.xxhash64(*[F.col(columns[c]) for c in key], F.col("_part").cast("int"), F.col("_s")), F.lit(buckets)))
    left = with_hot(flows, columns, "_part").withColumn("_s", salt.cast("int")).withColumn("_b", place).drop("_hot", "_s")
    right = with_hot(intervals, {c: c for c in key}, "part").withColumn("_s", F.explode(F.when(
        F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))) \
        .withColumn("_b", F.pmod(F.xxhash64(*key, F.col("part").cast("int"), F.col("_s")), F.lit(buckets))).drop("_hot", "_s")

    def find(f: pa.Table, r: pa.Table) -> pa.Table:
        out = f.drop_columns(["_b", "_part"])
        if not len(f) or not len(r):
            return out
        names = [f"k{i}" for i in range(len(key))]
        ours = pd.DataFrame({n: f.column(columns[c]).to_pandas(types_mapper=pd.ArrowDtype) for n, c in zip(names, key)})
        ours["part"] = f.column("_part").to_pandas(types_mapper=pd.ArrowDtype)
        theirs = pd.DataFrame({n: r.column(c).to_pandas(types_mapper=pd.ArrowDtype) for n, c in zip(names, key)})
        theirs["part"] = r.column("part").to_pandas(types_mapper=pd.ArrowDtype)
        for n in (*names, "part"):
            theirs[n] = theirs[n].astype(ours[n].dtype)
        code = theirs.groupby([*names, "part"], sort=False).ngroup().to_numpy()
        known = theirs.assign(code=code).drop_duplicates("code")
        of = ours.merge(known, on=[*names, "part"], how="left")["code"].fillna(-1).to_numpy(np.int64)
        lo, hi = r.column("lo").to_numpy(), r.column("hi").to_numpy()
        t = (f.column("_ts").fill_null(0).to_numpy() if timed else np.zeros(len(f), np.int64))
        order = np.lexsort((lo, code))
        starts, at = np.unique(lo, return_inverse=True)
        width = len(starts) + 1
        ranked = code[order] * width + at[order] + 1
        want = of * width + np.searchsorted(starts, t, side="right")
        k = np.searchsorted(ranked, want, side="right") - 1  # the last interval of the key that starts by then
        pick = order[np.maximum(k, 0)]
        hit = (k >= 0) & (of >= 0) & (code[pick] == of) & (t <= hi[pick])
        seq = r.column("seq").to_numpy()[pick]
        old = f.column("_seq").fill_null(_LOW).to_numpy()
        better = hit & (seq > old)
        labels = r.column("label").take(pa.array(pick))
        new_seq = pa.array(np.where(better, seq, old), pa.int64(), mask=~better & (old == _LOW))
        new_label = pc.if_else(pa.array(better), labels.combine_chunks(), f.column("_label").combine_chunks())
        return out.set_column(out.column_names.index("_seq"), "_seq", new_seq) \
            .set_column(out.column_names.index("_label"), "_label", new_label)

    schema = flows.drop("_part").schema
    return left.groupBy("_b").cogroup(right.groupBy("_b")).applyInArrow(find, schema)


def label_flows_indexed(df: DataFrame, rules_df: DataFrame, fields: FlowFields = FlowFields(),
                        sentinel: str = NEED_LABEL, default: str = DEFAULT_LABEL,
                        max_rules: int = MAX_RULES) -> DataFrame:
    """As ``label_flows_join``, by elementary intervals; a field that the flows lack is
    never matched by a rule that names it."""
    if not rules_df.filter(F.col("dst_addr").isNull()).isEmpty():
        raise ValueError("the interval index needs a destination endpoint on every rule; "
                         "use label_flows for wildcard-destination rules")
    flows = df.withColumns({"_seq": F.lit(None).cast("long"), "_label": F.lit(None).cast("string"),
                            "_ts": fields.col("timestamp").cast("long")})
    base = flows
    present = set(df.columns)
    columns = {c: getattr(fields, c) for c in ("dst_addr", *OPTIONAL)}
    timed = F.col("ts_lo").isNotNull() | F.col("ts_hi").isNotNull()
    bits = sum((F.col(c).isNotNull().cast("int") * (1 << i) for i, c in enumerate(OPTIONAL)), F.lit(0))
    typed = df.select(*[fields.col(c).alias(c) for c in columns if columns[c] in present or c in fields.extra])

    def as_flows(c):  # a value that the flows' type cannot hold matches nothing
        return F.col(c).try_cast(typed.schema[c].dataType).alias(c) if c in typed.columns else F.col(c)

    rules = rules_df.select(*[as_flows(c) for c in columns], F.col("seq").cast("long").alias("seq"), "label",
                            F.coalesce("ts_lo", F.lit(_LOW)).alias("lo"), F.coalesce("ts_hi", F.lit(_HIGH)).alias("hi"),
                            bits.alias("shape"), timed.alias("timed")).filter("lo <= hi")
    for i, c in enumerate(OPTIONAL):
        rules = rules.filter((F.shiftright("shape", i) % 2 == 0) | F.col(c).isNotNull())
    shapes = rules.groupBy("shape", "timed").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 32
    n_flows = df.count() if shapes else 0
    for s in sorted(shapes, key=lambda s: (s["shape"], s["timed"])):
        key = ["dst_addr", *(c for i, c in enumerate(OPTIONAL) if s["shape"] >> i & 1)]
        if any(columns[c] not in present and c not in fields.extra for c in key):
            continue
        own = rules.filter((F.col("shape") == s["shape"]) & (F.col("timed") == s["timed"])) \
            .select(*key, "lo", "hi", "seq", "label")
        width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        clipped, cuts, _ = _with_ranges(own, key, max_rules) if s["timed"] else (
            own.groupBy(*key, "lo", "hi").agg(F.max(F.struct("seq", "label")).alias("b"))
            .select(*key, "lo", "hi", "b.seq", "b.label").withColumn("part", F.lit(0)), {}, None)
        intervals = _intervals(clipped, key, max(width, math.ceil(s["n"] / RULES_PER_BUCKET)))
        flows = _lookup(flows, base, intervals, key, columns, cuts,
                        max(width, math.ceil(n_flows / FLOWS_PER_BUCKET)), s["timed"])
    current = fields.col("label")
    fill = F.when(current == F.lit(sentinel), F.lit(default)).otherwise(current)
    return flows.withColumn(fields.label, F.coalesce("_label", fill)).drop("_seq", "_label", "_ts")
