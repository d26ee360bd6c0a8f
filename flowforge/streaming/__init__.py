"""Structured Streaming form of the row-local labelling and drop rules."""

from flowforge.streaming.labelling import label_stream, run_label_stream  # noqa: F401
