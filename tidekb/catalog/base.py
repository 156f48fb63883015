"""Query registry: each entry runs an operator over whole tables and may carry an equal SQL statement."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidekb.session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name

        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries read: built once per application, as Parquet in the shared folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}/{name}"
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def s_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text},{lit(t)})" for t in terms) + ")"


def s_count(text: str, terms) -> str:
    return "(" + " + ".join(f"contains({text},{lit(t)})::INT" for t in dict.fromkeys(terms)) + ")"


def s_labels(text: str, hints: dict[str, list[str]]) -> str:
    parts = ", ".join(f"CASE WHEN {s_any(text, hs)} THEN {lit(k)} END" for k, hs in hints.items())
    return f"list_filter([{parts}], lambda z: z IS NOT NULL)"


def s_in(col: str, values) -> str:
    return f"{col} IN (" + ", ".join(lit(v) for v in values) + ")"
