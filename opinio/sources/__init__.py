"""Readers and writers: driver tables, product JSON, review JSONL, sinks."""
