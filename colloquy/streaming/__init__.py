"""Structured Streaming twins of stateful operators."""
