"""Readers, record parsers and sinks."""
