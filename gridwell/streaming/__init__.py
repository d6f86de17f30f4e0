"""Streaming forms of mergeable operators."""
