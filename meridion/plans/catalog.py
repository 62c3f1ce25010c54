"""All queries of the engine by name, each with the SQL that checks it (None where SQL cannot)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("features", "panels", "quality", "research", "general")


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ("session_date",)):
    """Registers a query.  Dates are compared as ISO texts; `dates` names those of the SQL."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is defined twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(f"`{c}`") for c, t in df.dtypes])

        run.__doc__ = f.__doc__
        _QUERIES[name] = run
        if sql:
            replace = f" REPLACE ({', '.join(f'{d}::VARCHAR AS {d}' for d in dates)})" if dates else ""
            _SQL[name] = f"SELECT *{replace} FROM ({sql})"
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded for comparison (and -0.0 as 0.0)."""
    return df.select(*[(F.round(F.col(c), own.get(c, digits)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(names: dict[str, int | None]) -> str:
    """Select list: a number of digits rounds a column, None leaves it."""
    return ", ".join(n if d is None else f"round(({n})::DOUBLE, {d}) + 0.0 AS {n}" for n, d in names.items())


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"meridion.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest series of each session by a cross-section of momentum and trend."""
    return queries()["flagship_top5"](spark, sf_dir)
