"""Registered queries: every operator over the given tables, with equivalent SQL where there is one."""

from .base import CATALOGUE
from . import detections, lod, lookups, pictures, planning, streams, tables  # noqa: F401  (registration)
from . import named  # noqa: F401  (after the queries whose SQL it shares)

__all__ = ["CATALOGUE"]
