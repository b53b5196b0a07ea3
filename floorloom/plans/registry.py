"""Named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the stand-in views as the query ``name``; ``sql`` is its DuckDB oracle."""

    def keep(build):
        from floorloom.plans.standin import Views

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Views(spark, sf_dir))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return keep


def with_views(sql: str) -> str:
    """``sql`` under the definitions of the stand-in views that it names, directly or through others."""
    from floorloom.plans.standin import SQL

    import re

    used: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                need(body)
                if name not in used:
                    used.append(name)

    need(sql)
    if not used:
        return sql
    views = ", ".join(f"{name} AS ({SQL[name]})" for name in used)
    body = sql.strip()
    head = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if head:
        return f"WITH {head[1] or ''}{views}, {body[head.end():]}"
    return f"WITH {views} {body}"
