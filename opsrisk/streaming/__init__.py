"""Standing queries on Structured Streaming."""
