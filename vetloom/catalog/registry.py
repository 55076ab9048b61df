"""Query registry and the assembly of check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vetloom.sources import views
from vetloom.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}
SQL_VIEWS: dict[str, str] = {
    **{name: views.duckdb_text(text) for name, text in views.SHARED_SQL.items()},
    **views.DUCKDB_ONLY,
}


def query(name: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``, with its check SQL where it has one."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(name, build, sql)
        return build

    return add


def check_sql(text: str) -> str:
    """Prefix ``text`` with the view definitions it reads, in dependency order."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in SQL_VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", body):
                visit(SQL_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(text)
    if not needed:
        return text
    recursive = "recursive " if re.match(r"\s*with\s+recursive\b", text, re.I) else ""
    body = re.sub(r"^\s*with\s+(recursive\s+)?", "", text, flags=re.I) if re.match(r"\s*with\b", text, re.I) else None
    ctes = ",\n".join(f"{name} as ({SQL_VIEWS[name]})" for name in needed)
    if body is not None:
        return f"with {recursive}{ctes},\n{body}"
    return f"with {ctes}\n{text}"
