"""Registry of named queries with the SQL each must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix the statement with the shared views it mentions, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, sql in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(sql)

    visit(body)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed]
    body = body.strip()
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body, flags=re.I)
    if head:
        rest = body[head.end():]
        return "WITH RECURSIVE " + ",\n".join(ctes + [rest])
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = with_views(sql)
        return fn

    return register
