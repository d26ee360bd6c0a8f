"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.session import ensure_checkpoint_dir

#: Word separators of every operator here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names (see ``ensure_checkpoint_dir``)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts the lineage, survives the
    loss of executors and makes the rows the same on every later read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for one written table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most bytes of texts that one shuffle partition is meant to get.
TASK_BYTES = 64 << 20


def deal_width(spark: SparkSession, n_bytes: int) -> int:
    """Partitions for ``n_bytes``: as many as the session sets, and more where these
    would get over ``TASK_BYTES`` each."""
    return max(shuffle_width(spark), math.ceil(n_bytes / TASK_BYTES))


def text_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def dealt(df: DataFrame, key: str, n_bytes: int) -> DataFrame:
    """``df`` dealt by ``key`` where its ``n_bytes`` ask for more partitions than the
    session sets; otherwise as it is, and the grouping by ``key`` deals it."""
    width = deal_width(df.sparkSession, n_bytes)
    return df.repartition(width, key) if width > shuffle_width(df.sparkSession) else df


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine (driver or executor).

    ``name`` may be a path, or a file name that the installed tokenizer
    package resolves."""
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)
