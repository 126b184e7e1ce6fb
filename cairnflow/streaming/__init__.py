"""Streaming ingest and latency windows."""
