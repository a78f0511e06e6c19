"""The engine's queries over the tables, each with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from . import answers, corpus, ingest, questions, retrieval

_PARTS = (corpus, retrieval, questions, ingest, answers)


def queries() -> dict[str, Callable]:
    return {name: f for part in _PARTS for name, (f, _) in part.REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.REGISTRY.items() if sql}
