"""Structured Streaming forms of ingest, duplicate removal and trend."""
