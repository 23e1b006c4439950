"""Everything registered: name -> Spark query, name -> equivalent SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("status_queries", "region_queries", "layout_queries", "diagnostics_queries", "page_queries", "archive_queries", "review_queries", "raster_queries", "stream_queries", "job_queries")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"panelflow.plans.{name}"), attribute)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found.update(part)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
