"""Structured Streaming forms of the polling service and of incremental deduplication."""
