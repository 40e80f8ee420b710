"""Structured Streaming: review counts and refresh-after-N."""
