"""Registered queries: every operator run over the generated tables, with its SQL counterpart."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_MODULES = [
    "sources", "parse", "usage", "assemble", "cost", "metrics", "quota", "routing", "filtering",
    "traces", "vectors", "streams",
]


def query(name: str, oracle: str | None = None):
    """Register ``fn(Tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
