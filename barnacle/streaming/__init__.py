"""Counts over a stream of reads."""

from .counts import stream_counts

__all__ = ["stream_counts"]
