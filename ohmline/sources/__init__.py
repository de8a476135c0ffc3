"""Readers, parsers, generators and sinks."""
