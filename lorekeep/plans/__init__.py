"""Query registry: library operators bound to the driver tables, each with its SQL twin where one is practical."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.plans.ctes import with_ctes
from lorekeep.plans.views import Views

MODULES = ("catalog", "search", "items", "messages", "links", "ledger", "upserts", "pages", "folders", "streams", "audits")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a function of ``Views``; ``needs`` names the shared CTEs in front of ``sql``."""

    def wrap(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = with_ctes(sql, needs)
        return fn

    return wrap


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"lorekeep.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
