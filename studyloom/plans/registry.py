"""The registered queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES: list[str] = ["text", "structure", "concepts", "learner", "graph", "planning", "study", "extraction", "retrieval", "linking", "responses", "streams", "phrases", "graph_search"]


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in import_module(f"studyloom.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"studyloom.plans.{m}").ORACLES.items()}
