"""Registered queries: a Spark function per name and, where expressible, its SQL statement."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketlake.plans.inputs import Inputs
from ticketlake.plans.views import MATERIALIZED, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix a statement with the domain views it mentions, dependencies first."""
    needed: list[str] = []

    def visit(body: str) -> None:
        words = set(re.findall(r"\b[a-z_]+\b", body))
        for name in VIEWS:
            if name in words and name not in needed:
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ", ".join(f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({VIEWS[name]})" for name in needed)
    body = sql.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else ""
    if body.upper().startswith("WITH "):
        body = body[len("WITH " + recursive):]
        return f"WITH {recursive}{views}, {body}"
    return f"WITH {views} {body}"


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            # A statement taken over from another query has its views already.
            STATEMENTS[name] = sql if sql in STATEMENTS.values() else with_views(sql)
        return build

    return register
