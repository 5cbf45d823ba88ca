"""All registered queries and their SQL counterparts."""

from __future__ import annotations

import functools
import importlib

from codestrata.plans.corpora import CORPORA, duck
from codestrata.session import ship_package

_AREAS = [
    "quality", "inventory", "collection", "technology", "dependency", "security",
    "lint", "symbol", "token", "tree", "report", "change", "stream",
]


def _merged(name: str) -> dict:
    out: dict = {}
    for area in _AREAS:
        module = importlib.import_module(f"codestrata.plans.{area}_plans")
        for key, value in getattr(module, name).items():
            if key in out:
                raise ValueError(f"query {key} registered twice")
            out[key] = value
    return out


def with_workers(query):
    """Python workers of the query can import this package."""
    @functools.wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)
    return run


def queries() -> dict:
    return {name: with_workers(query) for name, query in _merged("QUERIES").items()}


def _share_corpora(sql: str) -> str:
    """Render each corpus once per oracle, as a materialized common table."""
    shared = []
    for name in CORPORA:
        text = duck(name)
        if text in sql:
            sql = sql.replace(text, f"select * from corpus_{name}")
            shared.append(f"corpus_{name} as materialized ({text})")
    if not shared:
        return sql
    head = next((h for h in ("with recursive ", "with ") if sql.startswith(h)), "")
    rest = ", " + sql[len(head):] if head else " " + sql
    return (head or "with ") + ", ".join(shared) + rest


def oracle_sql() -> dict:
    return {name: _share_corpora(sql) for name, sql in _merged("ORACLES").items()}
