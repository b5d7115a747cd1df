"""Readers, sinks, path conventions and adapters."""
