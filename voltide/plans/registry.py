"""Every registered query of the library and its SQL."""

from __future__ import annotations

from . import bars, book, features, frames, ingest, streams  # noqa: F401  register their queries
from .base import ORACLE_SQL, QUERIES  # noqa: F401
