"""Binding, reading and writing points tables and their companions."""
