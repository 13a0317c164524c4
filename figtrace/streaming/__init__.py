"""Append-only flows that accept a batch or a streaming DataFrame."""
