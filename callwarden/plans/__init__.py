"""Registered queries, grouped by area."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

AREAS = ["report_queries", "access_queries", "ledger_queries", "content_queries", "supply_queries", "stream_queries"]


def load() -> ModuleType:
    """Import every area once and return the registry."""
    for area in AREAS:
        import_module(f"callwarden.plans.{area}")
    return import_module("callwarden.plans.registry")
