"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ["token_count", "substrings", "jaccard", "secrets", "packing", "chat", "line_dedup", "nearest", "decontaminate", "quality", "hard_negatives", "vector_codes", "page_text"]


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in import_module(f"studyloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"studyloom.llm.{m}").ORACLES.items()}
