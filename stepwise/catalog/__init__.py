"""Registry of named queries over the driver tables.

Each entry binds an operator (or a composition of operators) to the driver
tables and carries an independent DuckDB SQL statement computing the same
result, used as the correctness oracle.  Entries without SQL are checked on
row counts only (iterative fits, streaming) and have brute-force tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stepwise.plans.bindings import EVENTS_CTE, FACT_CTE, MATCHES_CTE, ORDERS_CTE


@dataclass(frozen=True)
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...] = ()


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, ids: tuple[str, ...] = ()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql.strip() if sql else None, ids)
        return fn
    return deco


def with_ctes(body: str, *ctes: str) -> str:
    """Prefix ``body`` with the binding CTEs; a body that starts with its own
    ``WITH`` is merged into the same clause."""
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + b[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + b


__all__ = ["REGISTRY", "register", "with_ctes", "Entry", "EVENTS_CTE", "ORDERS_CTE",
           "FACT_CTE", "MATCHES_CTE"]


def load_all() -> dict[str, Entry]:
    # import for side effects (registration)
    from stepwise.catalog import (  # noqa: F401
        win_q, agg_q, rel_q, dq_q, tpl_q, eda_q, view_q, model_q, src_q, stream_q)
    return REGISTRY
