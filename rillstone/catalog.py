"""All queries by name: each plan module registers its queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

PLANS = ("scans", "predicates", "joins", "aggregates", "sequences", "folds", "scalars", "signals", "reports", "vitals", "ledgers", "live", "imports", "nights", "rings", "transfers", "captures", "versions", "windows_of_days", "models", "wearables", "bundles")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, days: str = ""):
    """Register a function of (spark, sf_dir) under its own name.

    ``days`` names the result's date columns, apart by spaces: they are given as yyyy-MM-dd on both sides.
    """
    names = days.split()

    def take(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: df[c].cast("string") for c in names}) if names else df

        _QUERIES[f.__name__] = run
        if sql:
            casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in names)
            _SQL[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql}) AS result" if names else sql
        return f

    return take


def _loaded() -> None:
    for p in PLANS:
        import_module(f"rillstone.plans.{p}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)
