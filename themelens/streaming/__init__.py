"""Structured Streaming variants of the batch operators."""

from .harvest_stream import run_to_completion, start_record_stream  # noqa: F401
