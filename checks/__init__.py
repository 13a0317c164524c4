"""Registered queries, the inputs they derive from the given tables, and the SQL they are checked with."""
