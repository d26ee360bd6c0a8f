"""Labelling on a stream.

Rule labelling and the drop rules are row-local (a ``CASE`` projection and an
``IS NOT TRUE`` filter), so the same expressions run on ``readStream`` without
state, watermark or shuffle.  The sink is a file sink whose checkpoint lives
under the session's shared checkpoint folder, so a restarted query resumes
where it stopped (exactly-once file output).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from flowforge.operators.labelling import (DayRules, Drop, FlowFields, Rule, label_by_day,
                                           label_flows)
from flowforge.session import ensure_checkpoint_dir


def label_stream(stream: DataFrame, rules: Sequence[Rule] | None = None,
                 drops: Sequence[Drop] = (), day_col: str | None = None,
                 day_rules: Mapping[str, DayRules] | None = None,
                 fields: FlowFields = FlowFields()) -> DataFrame:
    """Apply rules (or per-day rules) to a streaming DataFrame."""
    if day_rules is not None:
        return label_by_day(stream, day_col or "day", day_rules, fields)
    return label_flows(stream, rules or (), drops, fields)


def run_label_stream(spark: SparkSession, source_dir: str, schema,
                     to_flows: Callable[[DataFrame], DataFrame],
                     label: Callable[[DataFrame], DataFrame],
                     sink_dir: str | None = None, files_per_batch: int = 1,
                     fmt: str = "parquet", glob: str | None = None) -> str:
    """Run the labelling stream over the files in ``source_dir`` until all
    present files are processed (``availableNow``); return the sink folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    run = uuid.uuid4().hex
    sink_dir = sink_dir or f"{root}/label-stream-{run}/out"
    ckpt = f"{root}/label-stream-{run}/checkpoint"
    reader = (spark.readStream.schema(schema).format(fmt)
              .option("maxFilesPerTrigger", files_per_batch))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.load(source_dir)
    out = label(to_flows(stream))
    q = (out.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", ckpt).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink_dir
