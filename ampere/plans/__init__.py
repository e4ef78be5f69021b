"""Registered queries over the driver tables (one module per area)."""

from . import cleaning, features, keyed, modelling, sources, stream, summaries, trading  # noqa: F401
from .registry import REGISTRY, Query, register

__all__ = ["REGISTRY", "Query", "register"]
