"""Every operator as a query over the given tables, with the same result in SQL."""

from __future__ import annotations

from importlib import import_module

SECTIONS = (
    "sources",
    "typing",
    "merge",
    "prepare",
    "filters",
    "profile",
    "relate",
    "distribution",
    "timeseries",
    "findings",
)


def _collect(what: str) -> dict:
    out: dict = {}
    for section in SECTIONS:
        part = getattr(import_module(f"catalog.{section}"), what)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"Registered twice: {clash}")
        out.update(part)
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_sql() -> dict:
    return _collect("SQL")
