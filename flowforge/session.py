"""Session helpers.

Library code never creates its own cluster settings: it takes the session it is
given.  ``get_session`` is for tests, benchmarks and scripts on one machine.
"""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "flowforge") -> SparkSession:
    """Local session with the settings every query here assumes.

    The session time zone is pinned to UTC: labelling rules compare integer
    epoch microseconds and the oracle (DuckDB) works in UTC.
    """
    master = master or os.environ.get("FLOWFORGE_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.constraintPropagation.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FLOWFORGE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def wide_table_settings(spark: SparkSession) -> None:
    """Flow tables have 80+ columns, each cleaned by a ``CASE``; Catalyst's
    constraint propagation grows combinatorially over such projections and
    can stall planning for minutes.  It only feeds filter inference, which
    these plans do not need.  A stage over so many columns is one method too long
    for the JVM's compiler (8,000 bytes of code), which then interprets it: such stages
    run operator by operator instead."""
    spark.conf.set("spark.sql.constraintPropagation.enabled", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def pin_utc(spark: SparkSession) -> None:
    """Fix the session zone; rules and oracles are written against UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    That setting is taken as it is.  Where it is unset, only a master of threads in
    this one process (tests, a laptop) gets a folder of its own; on a cluster only a
    folder that every executor shares will do, so a missing setting is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="flowforge-ckpt-"))
    return sc.getCheckpointDir()


@contextmanager
def shuffles_released(spark: SparkSession):
    """Shuffle files of every query run inside are removed as it ends; else they stay until the
    driver happens to collect garbage, and queries in a loop pile them up.  For queries whose
    result is collected, checkpointed or written, and which are not run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job wrote for itself and has read for the last time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_checkpoint(df: DataFrame) -> None:
    """Delete the files of a frame that ``checkpoint()`` returned and that is not read again."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        remove_folder(df.sparkSession, file.get())
