"""Labelling queries (rule compiler, join form, day dispatch, drops, sort)
over the ``events`` table seen as flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.operators.capture_rules import CAPTURE_DAYS
from flowforge.operators.interval_index import label_flows_indexed
from flowforge.operators.labelling import (DayRules, Drop, FlowFields, Rule, apply_drops,
                                           label_by_day, label_flows, label_flows_join,
                                           rules_frame)
from flowforge.operators.profile import class_counts
from flowforge.operators.split import sort_flows
from flowforge.plans.tables import EVENT_FLOWS_SQL, event_flows, table

# Rules for the events table (epoch microseconds, UTC).  Rule 2 overlaps rule 1
# on 2024-01-04 00:00-12:00, so the last-rule-wins order is exercised.
EVENT_RULES = (
    Rule("ftp_patator", dst_addr="error", ts_lo=1704153600000000, ts_hi=1704369600000000),
    Rule("ssh_patator", dst_addr="error", ts_lo=1704326400000000, ts_hi=1704499200000000),
    Rule("heartbleed", src_addr=7, dst_addr="click"),
    Rule("dos_slowloris", dst_addr="purchase", ts_lo=1704844800000000, ts_hi=1705017600000000),
    Rule("dos_slowloris", dst_addr="purchase", ts_lo=1705730400000000, ts_hi=1705773600000000),
    Rule("portscan", src_addr=16, dst_addr="view", ts_lo=1705276800000000, ts_hi=1706140800000000),
    Rule("ddos", dst_addr="click", ts_lo=1706443200000000, ts_hi=1706572800000000),
    Rule("bot", dst_addr="view", dst_port=7),
)

# Per-weekday rules (same shapes as the five capture days).
EVENT_DAYS = {
    "monday": DayRules(rules=(Rule("benign"),)),
    "tuesday": DayRules(rules=(
        Rule("ftp_patator", dst_addr="error", ts_lo=1704758400000000, ts_hi=1704844799999999),
        Rule("ssh_patator", dst_addr="error", ts_lo=1705363200000000, ts_hi=1705449599999999),
    )),
    "wednesday": DayRules(rules=(
        Rule("heartbleed", src_addr=7, dst_addr="click"),
        Rule("dos_slowloris", dst_addr="purchase", ts_lo=1704844800000000, ts_hi=1704931199999999),
        Rule("dos_slowloris", dst_addr="purchase", ts_lo=1706054400000000, ts_hi=1706140799999999),
        Rule("dos_hulk", dst_addr="view", ts_lo=1705449600000000, ts_hi=1705535999999999),
    )),
    "thursday": DayRules(
        rules=(Rule("webattack_bruteforce", dst_addr="click",
                    ts_lo=1704931200000000, ts_hi=1705017599999999),),
        drops=(Drop(ts_op=">=", ts=1706184000000000),),
    ),
    "friday": DayRules(
        rules=(
            Rule("bot", dst_addr="error", ts_lo=1706227200000000, ts_hi=1706270400000000),
            Rule("portscan", dst_addr="view", ts_lo=1705622400000000, ts_hi=1705708799999999),
        ),
        drops=(Drop(dst_addrs=("error",), ts_op=">", ts=1706270400000000),
               Drop(dst_addrs=("signup",))),
    ),
    "saturday": DayRules(),
    "sunday": DayRules(),
}

# Drops for ``rule_drop``: a time cut-off, an endpoint + strict time bound and
# an endpoint list; time is NULL for rows with value < 2 (NULL keeps the row).
EVENT_DROPS = (
    Drop(ts_op=">=", ts=1706184000000000),
    Drop(dst_addrs=("error",), ts_op=">", ts=1705017600000000),
    Drop(dst_addrs=("signup",)),
)


def rule_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_flows(spark, sf_dir)
    return label_flows(ev, EVENT_RULES).select("event_id", "label")


def rule_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_counts(rule_label(spark, sf_dir), "label")


def rule_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_flows(spark, sf_dir)
    rules = rules_frame(spark, EVENT_RULES)
    return label_flows_join(ev, rules).select("event_id", "label")


def day_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_flows(spark, sf_dir)
    return label_by_day(ev, "day", EVENT_DAYS).select("event_id", "day", "label")


def rule_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_flows(spark, sf_dir).withColumn(
        "timestamp", F.when(F.col("value") < 2.0, F.lit(None)).otherwise(F.col("timestamp")))
    return apply_drops(ev, EVENT_DROPS, FlowFields()).select("event_id", "dst_addr", "timestamp")


def sort_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = event_flows(spark, sf_dir).withColumn(
        "timestamp", F.when(F.col("value") < 2.0, F.lit(None)).otherwise(F.col("timestamp")))
    return sort_flows(ev.select("event_id", "timestamp", "src_addr", "dst_addr", "dst_port"),
                      ["timestamp", "dst_port", "src_addr", "dst_addr", "event_id"])


CAPTURE_SOURCES = ("172.16.0.1", "172.16.0.1", "10.0.0.9")
CAPTURE_ENDPOINTS = ("192.168.10.50", "192.168.10.51", "205.174.165.73", "192.168.10.50",
                     "52.6.13.28", "8.8.8.8", "52.7.235.158")


def capture_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events mapped onto the five capture days: endpoints, ports and protocol of the
    rules (and others), times spread over each day's hours."""
    e = F.col("event_id")
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]),
                                          (c % len(values) + 1).cast("int"))
    day = e % 5
    return table(spark, sf_dir, "events").select(
        "event_id",
        pick(list(CAPTURE_DAYS), e).alias("day"),
        pick(CAPTURE_SOURCES, F.floor(e / 5)).alias("src_addr"),
        pick(CAPTURE_ENDPOINTS, F.floor(e / 15)).alias("dst_addr"),
        pick([45022, 50000], F.col("user_id")).alias("src_port"),
        F.when(F.col("event_type").isin("click", "view"), 80).otherwise(444).alias("dst_port"),
        F.when(F.col("event_type") == "signup", 17).otherwise(6).alias("ip_prot"),
        F.when(e % 97 != 0, F.lit(1499040000000000) + day * 86400000000
               + F.lit(28800000000) + (e * 7919 % 50400) * 1000000).alias("timestamp"),
        F.when(e % 89 == 0, F.lit("prelabelled")).otherwise(F.lit("NeedLabel")).alias("label"))


def capture_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules and drops of the five capture days (D1-D5), dispatched by day."""
    return label_by_day(capture_flows(spark, sf_dir), "day", CAPTURE_DAYS) \
        .select("event_id", "day", "dst_addr", "timestamp", "label")


QUERIES = {
    "capture_rules": capture_rules,
    "rule_label": rule_label,
    "rule_label_counts": rule_label_counts,
    "rule_label_join": rule_label_join,
    "day_rules": day_rules,
    "rule_drop": rule_drop,
    "sort_events": sort_events,
}

_EV = f"ev AS ({EVENT_FLOWS_SQL})"

_RULE_LABEL_SQL = f"""
WITH {_EV}
SELECT event_id,
  CASE
    WHEN dst_addr = 'view' AND dst_port = 7 THEN 'bot'
    WHEN dst_addr = 'click' AND timestamp BETWEEN 1706443200000000 AND 1706572800000000 THEN 'ddos'
    WHEN src_addr = 16 AND dst_addr = 'view' AND timestamp BETWEEN 1705276800000000 AND 1706140800000000 THEN 'portscan'
    WHEN dst_addr = 'purchase' AND timestamp BETWEEN 1705730400000000 AND 1705773600000000 THEN 'dos_slowloris'
    WHEN dst_addr = 'purchase' AND timestamp BETWEEN 1704844800000000 AND 1705017600000000 THEN 'dos_slowloris'
    WHEN src_addr = 7 AND dst_addr = 'click' THEN 'heartbleed'
    WHEN dst_addr = 'error' AND timestamp BETWEEN 1704326400000000 AND 1704499200000000 THEN 'ssh_patator'
    WHEN dst_addr = 'error' AND timestamp BETWEEN 1704153600000000 AND 1704369600000000 THEN 'ftp_patator'
    WHEN label = 'NeedLabel' THEN 'benign'
    ELSE label
  END AS label
FROM ev
"""

_RULES_VALUES = """
rules(seq, src_addr, dst_addr, dst_port, ts_lo, ts_hi, label) AS (VALUES
  (1, NULL, 'error', NULL, 1704153600000000, 1704369600000000, 'ftp_patator'),
  (2, NULL, 'error', NULL, 1704326400000000, 1704499200000000, 'ssh_patator'),
  (3, 7, 'click', NULL, NULL, NULL, 'heartbleed'),
  (4, NULL, 'purchase', NULL, 1704844800000000, 1705017600000000, 'dos_slowloris'),
  (5, NULL, 'purchase', NULL, 1705730400000000, 1705773600000000, 'dos_slowloris'),
  (6, 16, 'view', NULL, 1705276800000000, 1706140800000000, 'portscan'),
  (7, NULL, 'click', NULL, 1706443200000000, 1706572800000000, 'ddos'),
  (8, NULL, 'view', 7, NULL, NULL, 'bot'))
"""

ORACLE = {
    "rule_label": _RULE_LABEL_SQL,
    "rule_label_counts": f"""
WITH lab AS ({_RULE_LABEL_SQL})
SELECT label, count(*) AS count FROM lab WHERE label IS NOT NULL GROUP BY label
""",
    "rule_label_join": f"""
WITH {_EV}, {_RULES_VALUES},
m AS (
  SELECT e.event_id, arg_max(r.label, r.seq) AS hit
  FROM ev e JOIN rules r
    ON r.dst_addr = e.dst_addr
   AND (r.src_addr IS NULL OR r.src_addr = e.src_addr)
   AND (r.dst_port IS NULL OR r.dst_port = e.dst_port)
   AND (r.ts_lo IS NULL OR e.timestamp >= r.ts_lo)
   AND (r.ts_hi IS NULL OR e.timestamp <= r.ts_hi)
  GROUP BY e.event_id)
SELECT e.event_id,
       coalesce(m.hit, CASE WHEN e.label = 'NeedLabel' THEN 'benign' ELSE e.label END) AS label
FROM ev e LEFT JOIN m ON m.event_id = e.event_id
""",
    "day_rules": f"""
WITH {_EV}
SELECT event_id, day,
  CASE day
    WHEN 'monday' THEN 'benign'
    WHEN 'tuesday' THEN CASE
      WHEN dst_addr = 'error' AND timestamp BETWEEN 1705363200000000 AND 1705449599999999 THEN 'ssh_patator'
      WHEN dst_addr = 'error' AND timestamp BETWEEN 1704758400000000 AND 1704844799999999 THEN 'ftp_patator'
      WHEN label = 'NeedLabel' THEN 'benign' ELSE label END
    WHEN 'wednesday' THEN CASE
      WHEN dst_addr = 'view' AND timestamp BETWEEN 1705449600000000 AND 1705535999999999 THEN 'dos_hulk'
      WHEN dst_addr = 'purchase' AND timestamp BETWEEN 1706054400000000 AND 1706140799999999 THEN 'dos_slowloris'
      WHEN dst_addr = 'purchase' AND timestamp BETWEEN 1704844800000000 AND 1704931199999999 THEN 'dos_slowloris'
      WHEN src_addr = 7 AND dst_addr = 'click' THEN 'heartbleed'
      WHEN label = 'NeedLabel' THEN 'benign' ELSE label END
    WHEN 'thursday' THEN CASE
      WHEN dst_addr = 'click' AND timestamp BETWEEN 1704931200000000 AND 1705017599999999 THEN 'webattack_bruteforce'
      WHEN label = 'NeedLabel' THEN 'benign' ELSE label END
    WHEN 'friday' THEN CASE
      WHEN dst_addr = 'view' AND timestamp BETWEEN 1705622400000000 AND 1705708799999999 THEN 'portscan'
      WHEN dst_addr = 'error' AND timestamp BETWEEN 1706227200000000 AND 1706270400000000 THEN 'bot'
      WHEN label = 'NeedLabel' THEN 'benign' ELSE label END
    ELSE CASE WHEN label = 'NeedLabel' THEN 'benign' ELSE label END
  END AS label
FROM ev
WHERE (CASE day
         WHEN 'thursday' THEN timestamp >= 1706184000000000
         WHEN 'friday' THEN (dst_addr = 'error' AND timestamp > 1706270400000000) OR dst_addr = 'signup'
         ELSE false END) IS NOT TRUE
""",
    "rule_drop": f"""
WITH {_EV}, e2 AS (
  SELECT event_id, dst_addr, CASE WHEN value < 2.0 THEN NULL ELSE timestamp END AS timestamp FROM ev)
SELECT event_id, dst_addr, timestamp FROM e2
WHERE (timestamp >= 1706184000000000
       OR (dst_addr = 'error' AND timestamp > 1705017600000000)
       OR dst_addr = 'signup') IS NOT TRUE
""",
    "sort_events": f"""
WITH {_EV}
SELECT event_id, CASE WHEN value < 2.0 THEN NULL ELSE timestamp END AS timestamp,
       src_addr, dst_addr, dst_port
FROM ev
ORDER BY timestamp NULLS LAST, dst_port NULLS LAST, src_addr NULLS LAST, dst_addr NULLS LAST, event_id
""",
}


def stream_rule_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rule_label`` run as a Structured Streaming query over the events file,
    written to a checkpointed file sink and read back."""
    from flowforge.plans.tables import table
    from flowforge.streaming.labelling import run_label_stream

    ev = table(spark, sf_dir, "events")

    def to_flows(stream):
        from flowforge.functions.exprs import epoch_micros
        return stream.select(
            F.col("event_id"), F.col("user_id").alias("src_addr"),
            F.col("event_type").alias("dst_addr"),
            F.get_json_object("props", "$.k").try_cast("bigint").alias("dst_port"),
            epoch_micros(stream, "ts").alias("timestamp"),
            F.when(F.col("event_type") == "signup", F.lit("prelabelled"))
             .otherwise(F.lit("NeedLabel")).alias("label"))

    sink = run_label_stream(spark, sf_dir, ev.schema, to_flows,
                            lambda s: label_flows(s, EVENT_RULES).select("event_id", "label"),
                            glob="events.parquet")
    return spark.read.parquet(sink)


QUERIES["stream_rule_label"] = stream_rule_label
ORACLE["stream_rule_label"] = _RULE_LABEL_SQL


def rule_label_join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join form with rules packed per (endpoint, day) bucket."""
    ev = event_flows(spark, sf_dir)
    rules = rules_frame(spark, EVENT_RULES)
    return label_flows_join(ev, rules, time_bucket_us=86_400_000_000).select("event_id", "label")


QUERIES["rule_label_join_bucketed"] = rule_label_join_bucketed
ORACLE["rule_label_join_bucketed"] = ORACLE["rule_label_join"]


def order_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per order, over four endpoints: windows of up to two hours, some open, some
    with a port or a source too.  The table grows with the data."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lo = F.lit(1704067200000000) + F.pmod(k * 7919, F.lit(2592000)) * 1000000
    null = F.lit(None)
    return table(spark, sf_dir, "orders").select(
        k.cast("long").alias("seq"),
        F.when(k % 23 == 0, F.pmod(c, F.lit(40)).cast("string")).otherwise(null).alias("src_addr"),
        null.cast("long").alias("src_port"),
        F.get(F.array(*[F.lit(v) for v in ("click", "view", "error", "purchase")]), (k % 4).cast("int")).alias("dst_addr"),
        F.when(k % 3 == 0, k % 10).otherwise(null).alias("dst_port"), null.cast("long").alias("ip_prot"),
        F.when(k % 41 == 0, null).otherwise(lo).alias("ts_lo"),
        F.when(k % 1009 == 0, null).otherwise(lo + (F.pmod(c, F.lit(7200)) * 1000000)).alias("ts_hi"),
        F.concat(F.lit("rule_"), F.pmod(k, F.lit(97)).cast("string")).alias("label"))


def rule_label_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval index on a rule table of one rule per order."""
    return label_flows_indexed(event_flows(spark, sf_dir), order_rules(spark, sf_dir), max_rules=1024) \
        .select("event_id", "label")


QUERIES["rule_label_indexed"] = rule_label_indexed
ORACLE["rule_label_indexed"] = f"""
WITH {_EV}, rules AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 23 = 0 THEN o_custkey % 40 END AS src_addr,
         list_value('click', 'view', 'error', 'purchase')[o_orderkey % 4 + 1] AS dst_addr,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 END AS dst_port,
         CASE WHEN o_orderkey % 41 <> 0 THEN 1704067200000000 + o_orderkey * 7919 % 2592000 * 1000000 END AS ts_lo,
         CASE WHEN o_orderkey % 1009 <> 0 THEN 1704067200000000 + o_orderkey * 7919 % 2592000 * 1000000
              + o_custkey % 7200 * 1000000 END AS ts_hi,
         'rule_' || (o_orderkey % 97) AS label FROM orders),
m AS (
  SELECT e.event_id, arg_max(r.label, r.seq) AS hit
  FROM ev e JOIN rules r
    ON r.dst_addr = e.dst_addr
   AND (r.src_addr IS NULL OR r.src_addr = e.src_addr)
   AND (r.dst_port IS NULL OR r.dst_port = e.dst_port)
   AND (r.ts_lo IS NULL OR e.timestamp >= r.ts_lo)
   AND (r.ts_hi IS NULL OR e.timestamp <= r.ts_hi)
  GROUP BY e.event_id)
SELECT e.event_id,
       coalesce(m.hit, CASE WHEN e.label = 'NeedLabel' THEN 'benign' ELSE e.label END) AS label
FROM ev e LEFT JOIN m ON m.event_id = e.event_id
"""


def _capture_oracle() -> str:
    """The capture days' rules as a table, joined and decided by ``arg_max``; the drops
    are written out."""
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    rules = [(day, i, r.src_addr, r.src_port, r.dst_addr, r.dst_port, r.ip_prot, r.ts_lo, r.ts_hi, r.label)
             for day, dr in CAPTURE_DAYS.items() for i, r in enumerate(dr.rules)]
    values = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rules)

    def pick(names, expr):
        return f"list_value({', '.join(map(lit, names))})[CAST({expr} % {len(names)} + 1 AS INTEGER)]"

    return f"""
WITH flows AS (
  SELECT event_id, {pick(list(CAPTURE_DAYS), 'event_id')} AS day,
         {pick(CAPTURE_SOURCES, 'event_id // 5')} AS src_addr,
         {pick(CAPTURE_ENDPOINTS, 'event_id // 15')} AS dst_addr,
         CASE WHEN user_id % 2 = 0 THEN 45022 ELSE 50000 END AS src_port,
         CASE WHEN event_type IN ('click', 'view') THEN 80 ELSE 444 END AS dst_port,
         CASE WHEN event_type = 'signup' THEN 17 ELSE 6 END AS ip_prot,
         CASE WHEN event_id % 97 <> 0 THEN 1499040000000000 + (event_id % 5) * 86400000000
              + 28800000000 + (event_id * 7919 % 50400) * 1000000 END AS timestamp,
         CASE WHEN event_id % 89 = 0 THEN 'prelabelled' ELSE 'NeedLabel' END AS label
  FROM events),
rules(day, seq, src_addr, src_port, dst_addr, dst_port, ip_prot, ts_lo, ts_hi, label) AS (VALUES {values}),
won AS (
  SELECT f.event_id, arg_max(r.label, r.seq) AS label
  FROM flows f JOIN rules r ON f.day = r.day
   AND (r.src_addr IS NULL OR f.src_addr = r.src_addr) AND (r.src_port IS NULL OR f.src_port = r.src_port)
   AND (r.dst_addr IS NULL OR f.dst_addr = r.dst_addr) AND (r.dst_port IS NULL OR f.dst_port = r.dst_port)
   AND (r.ip_prot IS NULL OR f.ip_prot = r.ip_prot)
   AND (r.ts_lo IS NULL OR f.timestamp >= r.ts_lo) AND (r.ts_hi IS NULL OR f.timestamp <= r.ts_hi)
  GROUP BY f.event_id)
SELECT f.event_id, f.day, f.dst_addr, f.timestamp,
       coalesce(w.label, CASE WHEN f.label = 'NeedLabel' THEN 'benign' ELSE f.label END) AS label
FROM flows f LEFT JOIN won w USING (event_id)
WHERE NOT coalesce(f.day = 'thursday' AND f.timestamp >= 1499353200000000, false)
  AND NOT coalesce(f.day = 'friday' AND f.dst_addr = '205.174.165.73' AND f.timestamp > 1499436193000000, false)
  AND NOT (f.day = 'friday' AND f.dst_addr IN ('52.6.13.28', '52.7.235.158'))
"""


ORACLE["capture_rules"] = _capture_oracle()
