"""Importing this module registers every query."""

from . import binning_queries, calibration_queries, ensemble_queries, fill_queries, ingest_queries, network_queries, plan_queries, polygon_queries, rollup_queries, spatial_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
