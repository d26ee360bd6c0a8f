"""Loading the shared parquet tables.

Each query selects only the columns it needs right after the scan so the
parquet reader prunes columns (``ReadSchema``) and filters push down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.functions.exprs import epoch_micros
from flowforge.session import pin_utc

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as flows: user = source, event type = destination endpoint,
    the ``k`` property = destination port, ``ts`` in epoch microseconds.

    The incoming label is the sentinel except for sign-ups, which arrive
    pre-labelled (so the sentinel-only default fill is exercised).
    """
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"),
        F.col("user_id").alias("src_addr"),
        F.col("event_type").alias("dst_addr"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("dst_port"),
        epoch_micros(ev, "ts").alias("timestamp"),
        F.when(F.col("event_type") == "signup", F.lit("prelabelled"))
         .otherwise(F.lit("NeedLabel")).alias("label"),
        F.lower(F.date_format("ts", "EEEE")).alias("day"),
        F.col("value"),
    )


#: The same view in DuckDB SQL, used by the oracles.
EVENT_FLOWS_SQL = """
SELECT event_id,
       user_id AS src_addr,
       event_type AS dst_addr,
       TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst_port,
       epoch_us(ts) AS timestamp,
       CASE WHEN event_type = 'signup' THEN 'prelabelled' ELSE 'NeedLabel' END AS label,
       lower(dayname(ts)) AS day,
       value
FROM events
"""
