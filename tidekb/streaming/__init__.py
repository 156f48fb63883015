"""Structured Streaming forms of the log, article, upsert and series operators."""
