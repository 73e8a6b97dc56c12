"""Imports every query module so that the registry is complete."""

import importlib

from percussa.plans.catalog import ORACLES, QUERIES

for _name in ("strings", "review", "pairing", "air", "shots", "detection", "signal", "table", "stream"):
    importlib.import_module(f"percussa.plans.{_name}_queries")

__all__ = ["ORACLES", "QUERIES"]
