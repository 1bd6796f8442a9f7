"""Streaming forms of the verdict operators."""
