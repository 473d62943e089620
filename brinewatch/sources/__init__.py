"""Connectors: message streams, machine lists, traces, run extracts and keyed sinks."""
