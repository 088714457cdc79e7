"""Ingestion of ledger files as a stream."""
