"""Flow scans and sinks."""

from flowforge.sources.flows import (  # noqa: F401
    day_from_file,
    load,
    load_splits,
    read_flows,
    read_parquet,
    write_labelled,
    write_metric_table,
    write_splits,
)
