"""The labelling stream gives the batch result."""

import os

from flowforge.plans import q_labelling as Q

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    batch = {tuple(r) for r in Q.rule_label(spark, SF_SMALL).collect()}
    stream = {tuple(r) for r in Q.stream_rule_label(spark, SF_SMALL).select("event_id", "label").collect()}
    assert batch == stream and len(batch) > 0


def test_stream_uses_checkpoint_folder(spark):
    from flowforge.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).replace("file:", "")
    Q.stream_rule_label(spark, SF_SMALL)
    assert any(n.startswith("label-stream-") for n in os.listdir(root))


def test_day_rules_with_drops_on_a_stream(spark):
    from pyspark.sql import functions as F

    from flowforge.functions.exprs import epoch_micros
    from flowforge.plans.tables import table
    from flowforge.streaming.labelling import label_stream, run_label_stream

    ev = table(spark, SF_SMALL, "events")

    def to_flows(stream):
        return stream.select(
            "event_id", F.col("user_id").alias("src_addr"), F.col("event_type").alias("dst_addr"),
            F.get_json_object("props", "$.k").try_cast("bigint").alias("dst_port"),
            epoch_micros(stream, "ts").alias("timestamp"),
            F.when(F.col("event_type") == "signup", F.lit("prelabelled"))
             .otherwise(F.lit("NeedLabel")).alias("label"),
            F.lower(F.date_format("ts", "EEEE")).alias("day"))

    sink = run_label_stream(spark, SF_SMALL, ev.schema, to_flows,
                            lambda s: label_stream(s, day_col="day", day_rules=Q.EVENT_DAYS)
                            .select("event_id", "day", "label"),
                            glob="events.parquet")
    streamed = {tuple(r) for r in spark.read.parquet(sink).select("event_id", "day", "label").collect()}
    batch = {tuple(r) for r in Q.day_rules(spark, SF_SMALL).collect()}
    assert streamed == batch and len(batch) > 0
