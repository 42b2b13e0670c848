"""Structured Streaming forms of ingestion, settlement, scoring and corrections."""
