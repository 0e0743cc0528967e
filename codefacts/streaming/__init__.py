"""Structured Streaming jobs."""

from .jobs import run_summary, still_running, stream_build_messages, stream_run_summary, stream_still_running

__all__ = ["run_summary", "still_running", "stream_build_messages", "stream_run_summary", "stream_still_running"]
