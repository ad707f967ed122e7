"""All queries of the library, by name, with their DuckDB twins."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Modules that register queries, in the order of the inventory.
PLANS = ("flows", "scalars", "sources", "lookups", "joins", "aggregates", "windows", "graph", "labels", "tasks", "questions", "reports", "checks", "scores", "answers", "learned", "texts")


def with_views(sql: str) -> str:
    """A DuckDB query preceded by the derived views that it names, directly or not."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in needed)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if head:
        return f"WITH {head[1] or ''}{ctes}, {sql[head.end():]}"
    return f"WITH {ctes} {sql}"


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under a name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return register


def load() -> None:
    for name in PLANS:
        importlib.import_module(f"ledgerloom.plans.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["taint_fifo_summary"](spark, sf_dir)
