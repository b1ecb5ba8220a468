"""Structured Streaming: idempotent micro-batch handlers and the consumer queries."""
