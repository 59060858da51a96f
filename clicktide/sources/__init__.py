"""Readers, declared schemas, and the table sinks."""
