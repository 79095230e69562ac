"""Readers for the source files, the fixed lookups, stand-in inputs and sinks."""
