"""All queries and their SQL, by name."""

from . import axes, catalogs, dates, drills, ingests, outputs, rasters, scans, services  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
