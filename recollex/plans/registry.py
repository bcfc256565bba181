"""Names of all queries of the core, with the DuckDB statement each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("memories", "searches", "reviews", "streams")


def _all() -> dict[str, tuple[Callable, str | None]]:
    return {name: made for module in MODULES for name, made in import_module(f"recollex.plans.{module}").QUERIES.items()}


#: Columns that tables hold as 32-bit integers; other integers of results count or rank.
STORED = ("dim",)


def _wide(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with counts and ranks as bigint, as SQL engines give them."""

    @wraps(query)
    def run(spark: SparkSession, directory: str) -> DataFrame:
        found = query(spark, directory)
        return found.withColumns({c: found[c].cast("bigint") for c, kind in found.dtypes if kind == "int" and c not in STORED})

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _wide(made[0]) for name, made in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: made[1] for name, made in _all().items() if made[1] is not None}
