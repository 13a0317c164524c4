"""The harvest manifest: one (path, status) row for every file the harvest saw."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Name fragments by which a manifest table and its columns are recognised.
TABLE_HINTS = ("skip", "skipped", "manifest")
PATH_HINT, STATUS_HINT = "path", "status"


def find_manifest(names: Iterable[str]) -> str | None:
    return next((n for n in names if any(h in n.casefold() for h in TABLE_HINTS)), None)


def manifest_columns(columns: list[str]) -> tuple[str | None, str | None]:
    """The path column (failing a name with the hint, the first) and the status column."""
    path = next((c for c in columns if PATH_HINT in c.lower()), columns[0] if columns else None)
    return path, next((c for c in columns if STATUS_HINT in c.lower()), None)


def read_manifest(manifest: DataFrame) -> DataFrame | None:
    """(path, status), or None where the table records no status."""
    path, status = manifest_columns(manifest.columns)
    if path is None or status is None:
        return None
    return manifest.select(F.col(f"`{path}`").alias("path"), F.col(f"`{status}`").alias("status"))
