"""Load-once file ingestion with Structured Streaming."""
