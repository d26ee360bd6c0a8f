"""Rule labelling of flows (endpoint + time-window predicates) and rule drops.

A rule names any of source address/port, destination address/port, protocol
and an inclusive time window; a missing field is a wildcard.  Rules are applied
in order and assignment is unconditional, so the *last* matching rule wins.
Afterwards only rows still carrying the sentinel label get the default class;
other incoming labels stay.

Two physical forms:

* ``label_flows``: the rule list compiles to one ``CASE`` chain in reverse rule
  order.  Row-local, no shuffle, whole-stage codegen, usable on a stream.
* ``label_flows_join``: for large rule tables.  Rules are grouped per
  destination endpoint into one array row each and hash-joined on the
  endpoint (broadcast when the rule table is small enough); the match is picked
  per row with higher-order functions, so the flow table is never exploded and
  never shuffled for a per-flow ``max_by``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowforge.functions.exprs import is_not_true
from flowforge.schema import DEFAULT_LABEL, NEED_LABEL


@dataclass(frozen=True)
class Rule:
    """One labelling rule; ``None`` fields are wildcards, time bounds inclusive."""

    label: str
    src_addr: str | None = None
    src_port: int | None = None
    dst_addr: str | None = None
    dst_port: int | None = None
    ip_prot: int | None = None
    ts_lo: int | None = None
    ts_hi: int | None = None


@dataclass(frozen=True)
class Drop:
    """Remove rows whose destination is in ``dst_addrs`` (if given) and whose
    time satisfies ``ts_op ts`` (if given).  A NULL operand keeps the row."""

    dst_addrs: tuple[str, ...] | None = None
    ts_op: str | None = None  # '>=' or '>'
    ts: int | None = None


@dataclass(frozen=True)
class DayRules:
    """Rules and drops of one capture day."""

    rules: tuple[Rule, ...] = ()
    drops: tuple[Drop, ...] = ()


@dataclass(frozen=True)
class FlowFields:
    """Where the rule fields live in the input table (column names)."""

    src_addr: str = "src_addr"
    src_port: str = "src_port"
    dst_addr: str = "dst_addr"
    dst_port: str = "dst_port"
    ip_prot: str = "ip_prot"
    timestamp: str = "timestamp"
    label: str = "label"
    extra: dict = field(default_factory=dict)

    def col(self, name: str) -> Column:
        if name in self.extra:
            return self.extra[name]
        return F.col(getattr(self, name))


_RULE_FIELDS = ("src_addr", "src_port", "dst_addr", "dst_port", "ip_prot")


def rule_condition(rule: Rule, fields: FlowFields = FlowFields()) -> Column:
    """Boolean column: does a row match ``rule``?  NULL operands never match."""
    cond = F.lit(True)
    for name in _RULE_FIELDS:
        v = getattr(rule, name)
        if v is not None:
            cond = cond & (fields.col(name) == F.lit(v))
    ts = fields.col("timestamp")
    if rule.ts_lo is not None:
        cond = cond & (ts >= F.lit(rule.ts_lo))
    if rule.ts_hi is not None:
        cond = cond & (ts <= F.lit(rule.ts_hi))
    return cond


def label_expr(rules: Sequence[Rule], fields: FlowFields = FlowFields(),
               sentinel: str = NEED_LABEL, default: str = DEFAULT_LABEL) -> Column:
    """The new label as one ``CASE`` chain: last rule first, then sentinel fill."""
    current = fields.col("label")
    expr = None
    for rule in reversed(list(rules)):
        cond = rule_condition(rule, fields)
        expr = F.when(cond, F.lit(rule.label)) if expr is None else expr.when(cond, F.lit(rule.label))
    fill = F.when(current == F.lit(sentinel), F.lit(default)).otherwise(current)
    return fill if expr is None else expr.otherwise(fill)


def drop_condition(drops: Sequence[Drop], fields: FlowFields = FlowFields()) -> Column:
    """True for rows any drop removes (NULL where undecided, i.e. kept)."""
    cond = F.lit(False)
    ts = fields.col("timestamp")
    for d in drops:
        c = F.lit(True)
        if d.dst_addrs is not None:
            c = c & fields.col("dst_addr").isin(*d.dst_addrs)
        if d.ts_op is not None:
            if d.ts_op == ">=":
                c = c & (ts >= F.lit(d.ts))
            elif d.ts_op == ">":
                c = c & (ts > F.lit(d.ts))
            else:
                raise ValueError(f"unsupported drop operator {d.ts_op!r}")
        cond = cond | c
    return cond


def apply_drops(df: DataFrame, drops: Sequence[Drop], fields: FlowFields = FlowFields()) -> DataFrame:
    """Row-local drop; rows with a NULL operand stay (``IS NOT TRUE``)."""
    if not drops:
        return df
    return df.filter(is_not_true(drop_condition(drops, fields)))


def label_flows(df: DataFrame, rules: Sequence[Rule], drops: Sequence[Drop] = (),
                fields: FlowFields = FlowFields(), sentinel: str = NEED_LABEL,
                default: str = DEFAULT_LABEL) -> DataFrame:
    """Label with a compiled ``CASE`` chain, then apply the drops."""
    out = df.withColumn(fields.label, label_expr(rules, fields, sentinel, default))
    return apply_drops(out, drops, fields)


def label_by_day(df: DataFrame, day_col: str, day_rules: Mapping[str, DayRules],
                 fields: FlowFields = FlowFields(), sentinel: str = NEED_LABEL,
                 default: str = DEFAULT_LABEL) -> DataFrame:
    """Dispatch rules by capture day in one pass over all days.

    Unknown days raise at run time (``raise_error``), like a file name that no
    day function handles.
    """
    day = F.col(day_col)
    lab = None
    drop = None
    for name, dr in day_rules.items():
        e = label_expr(dr.rules, fields, sentinel, default)
        lab = F.when(day == F.lit(name), e) if lab is None else lab.when(day == F.lit(name), e)
        if dr.drops:
            dc = drop_condition(dr.drops, fields)
            drop = F.when(day == F.lit(name), dc) if drop is None else drop.when(day == F.lit(name), dc)
    lab = lab.otherwise(F.raise_error(F.concat(F.lit("unknown capture day: "),
                                               F.coalesce(day, F.lit("NULL")))))
    out = df.withColumn(fields.label, lab)
    if drop is not None:
        out = out.filter(is_not_true(drop.otherwise(F.lit(False))))
    return out


# --------------------------------------------------------------------------
# Join form for large rule tables.
# --------------------------------------------------------------------------

#: Endpoints with more than this part of all flows are salted in a shuffled join.
HOT_ENDPOINTS = 200
SALTS = 32

RULE_TABLE_COLUMNS = ["seq", "src_addr", "src_port", "dst_addr", "dst_port",
                      "ip_prot", "ts_lo", "ts_hi", "label"]


def rules_frame(spark, rules: Sequence[Rule]) -> DataFrame:
    """Rule list as a DataFrame (``seq`` = list position)."""
    rows = [(i, r.src_addr, r.src_port, r.dst_addr, r.dst_port, r.ip_prot,
             r.ts_lo, r.ts_hi, r.label) for i, r in enumerate(rules, start=1)]
    return spark.createDataFrame(
        rows, "seq int, src_addr string, src_port bigint, dst_addr string, "
              "dst_port bigint, ip_prot bigint, ts_lo bigint, ts_hi bigint, label string")


def label_flows_join(df: DataFrame, rules_df: DataFrame, fields: FlowFields = FlowFields(),
                     sentinel: str = NEED_LABEL, default: str = DEFAULT_LABEL,
                     broadcast_max_endpoints: int = 200_000,
                     broadcast_max_rules: int = 1_000_000,
                     time_bucket_us: int | None = None) -> DataFrame:
    """Endpoint-keyed interval join with last-rule-wins.

    Every rule must name its destination endpoint.  Rules are packed into one
    row per endpoint, ``array<struct>``; the flow table is hash-joined on the
    endpoint and the winning rule is ``array_max`` of the matching ``(seq, label)``
    structs.  One output row per input row, no aggregation over flows.

    ``time_bucket_us`` packs rules with a closed time window per (endpoint,
    time bucket) instead -- a rule is listed in every bucket its window
    overlaps -- so a flow only scans the rules of its own bucket; rules with an
    open window stay in a per-endpoint list.  Same result, for endpoints with
    very many rules.

    Rules are broadcast when there are at most ``broadcast_max_endpoints`` endpoints
    and at most ``broadcast_max_rules`` rules, counted as listed, that is once per
    time bucket.  Otherwise both sides are shuffled: endpoints with more than one in
    ``HOT_ENDPOINTS`` of all flows (so at most that many) are dealt over ``SALTS``
    keys, and their rules repeated for each.
    """
    missing = rules_df.filter(F.col("dst_addr").isNull()).limit(1).count()
    if missing:
        raise ValueError("label_flows_join needs a destination endpoint on every rule; "
                         "use label_flows for wildcard-destination rules")
    rule_struct = F.struct(*[F.col(c) for c in RULE_TABLE_COLUMNS if c != "dst_addr"])
    listed = F.lit(1)
    if time_bucket_us is not None:
        w = int(time_bucket_us)
        listed = F.coalesce(F.greatest(F.floor(F.col("ts_hi") / w) - F.floor(F.col("ts_lo") / w) + 1,
                                       F.lit(0)), F.lit(1))
    sizes = rules_df.agg(F.coalesce(F.sum(listed), F.lit(0)).alias("n"),
                         F.countDistinct("dst_addr").alias("e")).first()
    small = sizes["e"] <= broadcast_max_endpoints and sizes["n"] <= broadcast_max_rules
    if small:
        hot = []
    else:
        flows_per = df.groupBy(fields.col("dst_addr").alias("d")).agg(F.count(F.lit(1)).alias("n"))
        total = df.count()
        hot = [r["d"] for r in flows_per.filter((F.col("n") > total / HOT_ENDPOINTS)
                                                & F.col("d").isNotNull()).collect()]

    def maybe_broadcast(t, endpoint):
        if small:
            return F.broadcast(t).withColumn("_r_salt", F.lit(0))
        salts = F.when(F.col(endpoint).isin(*hot), F.sequence(F.lit(0), F.lit(SALTS - 1))) \
            .otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
        return t.withColumn("_r_salt", F.explode(salts))

    salt = F.when(fields.col("dst_addr").isin(*hot), F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
                  .cast("int")).otherwise(F.lit(0)) if hot else F.lit(0)

    present = set(df.columns)

    def flow_col(name):
        # a field the flow table lacks is NULL: rules that test it never match
        if name in fields.extra or getattr(fields, name) in present:
            return fields.col(name)
        return F.lit(None)

    src_a, src_p = flow_col("src_addr"), flow_col("src_port")
    dst_p, prot, ts = flow_col("dst_port"), flow_col("ip_prot"), flow_col("timestamp")

    def hit(r):
        return ((r["src_addr"].isNull() | (r["src_addr"] == src_a))
                & (r["src_port"].isNull() | (r["src_port"] == src_p))
                & (r["dst_port"].isNull() | (r["dst_port"] == dst_p))
                & (r["ip_prot"].isNull() | (r["ip_prot"] == prot))
                & (r["ts_lo"].isNull() | (ts >= r["ts_lo"]))
                & (r["ts_hi"].isNull() | (ts <= r["ts_hi"])))

    def best_of(col_name):
        return F.array_max(F.transform(
            F.filter(F.col(col_name), hit),
            lambda r: F.struct(r["seq"].alias("seq"), r["label"].alias("label"))))

    flows = df.withColumn("_f_salt", salt)

    def join_rules(left, packed, endpoint, *also):
        right = maybe_broadcast(packed, endpoint)
        on = (fields.col("dst_addr") == F.col(endpoint)) & (F.col("_f_salt") == F.col("_r_salt"))
        for cond in also:
            on = on & cond
        return left.join(right, on, "left").drop("_r_salt")

    if time_bucket_us is None:
        packed = rules_df.groupBy(F.col("dst_addr").alias("_r_dst")) \
                         .agg(F.collect_list(rule_struct).alias("_r_rules"))
        joined = join_rules(flows, packed, "_r_dst")
        best = best_of("_r_rules")
        drop = ["_f_salt", "_r_dst", "_r_rules"]
    else:
        closed = F.col("ts_lo").isNotNull() & F.col("ts_hi").isNotNull()
        timed = (rules_df.filter(closed & (F.col("ts_lo") <= F.col("ts_hi")))
                 .withColumn("_r_tb", F.explode(F.sequence(F.floor(F.col("ts_lo") / w),
                                                           F.floor(F.col("ts_hi") / w))))
                 .groupBy(F.col("dst_addr").alias("_r_dst"), "_r_tb")
                 .agg(F.collect_list(rule_struct).alias("_r_timed")))
        untimed = (rules_df.filter(~closed)
                   .groupBy(F.col("dst_addr").alias("_u_dst"))
                   .agg(F.collect_list(rule_struct).alias("_r_open")))
        flows = flows.withColumn("_f_tb", F.floor(ts / w))
        joined = join_rules(flows, timed, "_r_dst", F.col("_f_tb") == F.col("_r_tb"))
        joined = join_rules(joined, untimed, "_u_dst")
        best = F.greatest(best_of("_r_timed"), best_of("_r_open"))
        drop = ["_f_salt", "_f_tb", "_r_dst", "_r_tb", "_r_timed", "_u_dst", "_r_open"]
    current = fields.col("label")
    fill = F.when(current == F.lit(sentinel), F.lit(default)).otherwise(current)
    return joined.withColumn(fields.label, F.coalesce(best["label"], fill)).drop(*drop)
