"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accordant.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[str, tuple[str, ...]]] = {}
_SHARED: dict[str, tuple[tuple[str, ...], str]] = {}


class Tables:
    """The input tables of one folder, read on demand.

    `arrange` is for callers who want the inputs laid out in another way; the bench uses it to give
    every core a share of tables that come as one file.
    """

    arrange = staticmethod(lambda df: df)

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.arrange(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))


def shared(name: str, body: str, *needs: str) -> None:
    """A named SQL step other queries may build on."""
    _SHARED[name] = (needs, body)


def with_shared(body: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for inner in _SHARED[name][0]:
            visit(inner)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    steps = ",\n".join(f"{name} AS ({_SHARED[name][1]})" for name in ordered)
    return f"WITH {steps}\n{body}"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query over Tables under its name, with the SQL that must give the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            _SQL[name] = (sql, needs)
        return build

    return register


def sql_texts() -> dict[str, str]:
    """The complete SQL of every query that has one; shared steps may come from any module."""
    return {name: with_shared(body, *needs) for name, (body, needs) in _SQL.items()}
