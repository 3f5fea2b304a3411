"""Registered queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

import importlib

#: Modules that define QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("placing", "indexing", "serving", "checking", "reporting", "filing")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"larder.plans.{m}").QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(f"larder.plans.{m}").ORACLES.items()}
