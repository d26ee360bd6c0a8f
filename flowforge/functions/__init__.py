"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from flowforge.functions.exprs import (  # noqa: F401
    clip_col,
    epoch_micros,
    hash_key,
    is_not_true,
    round_half_up,
)
