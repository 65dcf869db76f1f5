"""Structured Streaming forms of the daily activity metrics (extension)."""

from cohortlens.streaming.metrics import streaming_conversion, streaming_dau

__all__ = ["streaming_dau", "streaming_conversion"]
