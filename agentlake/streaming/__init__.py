"""Files, queues and windows as Structured Streaming."""
