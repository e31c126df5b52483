"""Structured Streaming: incremental indexing of arriving documents and windowed counts of events."""
