"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_MODULES = ("chat", "simhash", "secrets", "mixing", "language", "packing", "huffman", "mpeg", "quality", "lm")


def queries() -> dict[str, Callable]:
    return {k: f for m in _MODULES for k, f in import_module(f".{m}", __package__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in _MODULES for k, f in import_module(f".{m}", __package__).SQL.items()}
