"""Structured Streaming: incremental load of the raw extracts into cleaned tables."""

from retentia.streaming.incremental import STREAMABLE, stream_cleaned

__all__ = ["STREAMABLE", "stream_cleaned"]
