"""Registered queries and their SQL equivalents, by module."""

from __future__ import annotations

from collections.abc import Callable

from gridloom.plans import assembly, general, package, statistics, structure

MODULES = (statistics, structure, assembly, package, general)


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
