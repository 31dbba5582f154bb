"""All registered queries."""

from __future__ import annotations

from . import queries_clean, queries_ingest, queries_models, queries_reports, queries_series, queries_stream  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
