"""Registered query plans: each operator on the given tables, with the SQL that must give the same rows."""

from importlib import import_module

from orfloom.plans.registry import ORACLES, QUERIES

SECTIONS = (
    "sources", "filters", "joins", "aggregates", "windows", "functions", "quality", "construction", "review", "streams",
)


def load() -> None:
    for section in SECTIONS:
        import_module(f"orfloom.plans.{section}")


__all__ = ["ORACLES", "QUERIES", "load"]
