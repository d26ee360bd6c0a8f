"""Small column expressions.  Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_not_true(cond: Column) -> Column:
    """``cond IS NOT TRUE``: keeps rows whose condition is false *or* NULL.

    A drop rule written as ``filter(~cond)`` would also lose rows with a NULL
    operand, which a masked drop keeps.
    """
    return ~cond.eqNullSafe(F.lit(True))


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Integer epoch microseconds of a time column, independent of session zone.

    ``timestamp_ntz`` is read as wall-clock UTC; ``timestamp`` is an instant;
    integer columns are taken to be microseconds already.
    """
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(
            f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    return c.cast("bigint")


def hash_key(key_cols: list[str] | list[Column], seed: int | str, *extra) -> Column:
    """Order key used instead of a random permutation.

    ``md5(key | seed [| extra])`` is the same in Spark and DuckDB, is fixed for a
    given row and seed, and does not depend on partitioning or row order.
    """
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string")
             for k in key_cols]
    parts.append(F.lit(str(seed)))
    for e in extra:
        parts.append(e.cast("string") if isinstance(e, Column) else F.lit(str(e)))
    return F.md5(F.concat_ws("|", *parts))


def clip_col(c: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; NULL stays NULL (``least``/``greatest`` skip NULLs)."""
    return (F.when(c < F.lit(low), F.lit(low))
            .when(c > F.lit(high), F.lit(high))
            .otherwise(c))


def round_half_up(c: Column, digits: int = 6) -> Column:
    """Round like the SQL oracle (half away from zero) for result comparison."""
    return F.round(c, digits)
