"""Readers, sinks, configuration and schemas."""
