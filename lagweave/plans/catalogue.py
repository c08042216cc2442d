"""All registered queries of the signal operators, with their SQL."""

from __future__ import annotations

from . import coding, decisions, details, lossy, measures, repeats, search, spectra, streams, timeline  # noqa: F401  their queries register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
