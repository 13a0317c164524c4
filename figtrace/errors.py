"""Errors a caller can act on. An empty result is never an error."""

from __future__ import annotations


class FigtraceError(Exception):
    """Base class."""


class SourceError(FigtraceError):
    """A table could not be read or bound."""


class SchemaContractError(SourceError):
    """A points table lacks columns for concepts that every question needs."""


class SealedSourceError(FigtraceError):
    """A record was asked for by id and its source lies in a sealed folder."""
