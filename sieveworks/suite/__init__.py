"""The registered query suite: every operator of the library applied to the
given tables, each with a DuckDB SQL twin where SQL can express it."""

from __future__ import annotations

from . import catalog, cleaning, conversation, images, io_streams, learning, profiling, versions  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
