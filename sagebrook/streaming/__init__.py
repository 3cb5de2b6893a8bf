"""Structured Streaming: incremental ingestion and keyed state."""
