"""Errors that a user can act on."""

from __future__ import annotations


class DriftError(Exception):
    """Base of the errors that a user can act on."""


class CacheMismatch(DriftError):
    """A cache entry doesn't belong to what is asked for."""


class TokenizerMismatch(DriftError):
    """Teacher and student don't read text alike."""


class RecordSchema(DriftError):
    """A record lacks what the schema locks."""


class CorpusError(DriftError, ValueError):
    """A corpus lacks a usable column or is too small."""
