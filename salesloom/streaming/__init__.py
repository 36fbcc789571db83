"""Incremental versions of the batch jobs (Structured Streaming)."""
