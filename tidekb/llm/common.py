"""Helpers shared by the corpus operators: registry, shared tables and word splitting."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidekb.session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: What separates words in the size and token contracts: space, tab, line feed, vertical tab, form feed, return.
BLANKS = r"\x20\x09-\x0D"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with an equal SQL statement if there is one."""

    def register(fn):
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


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor repeats nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(df: DataFrame) -> DataFrame:
    """``df`` with ``at_file`` and ``at_row``: where each row's content lies in its Parquet file.

    A frame that doesn't come from Parquet files is stored first. The names must be free.
    """
    try:
        return df.select("*", F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"))
    except AnalysisException:
        return located(stored(df, "located"))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... that clash with no other name, and the new name of each old one."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


_KEPT: list = [None, None]


def kept(token: str | None, build: Callable = lambda: None):
    """What ``build`` makes, kept by this Python worker for later tasks of the same token. A worker keeps one thing at a
    time: the next token's tables replace it, and a token of None only lets it go, so stages don't add up in memory.
    """
    if _KEPT[0] != token:
        _KEPT[:] = [None, None]
        _KEPT[:] = [token, build()]
    return _KEPT[1]
