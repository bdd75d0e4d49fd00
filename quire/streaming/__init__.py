"""Incremental and streaming ingestion of documents."""
