"""Imports every module that registers queries."""

from . import quality, results, runtime, streams, workload  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
