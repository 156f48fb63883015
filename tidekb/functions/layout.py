"""Partition layout helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core when the input has fewer splits than the cluster has slots.

    A large table has more scan splits than slots and passes through untouched; only a table of a few files is
    redistributed, by hash of its key, before CPU-heavy column work.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner", most: int = 10_000) -> DataFrame:
    """Join ``left`` with ``right``, whose keys are unique and whose column ``n`` counts the rows of ``left`` with that key.

    Keys that more than one ``most``-th of all rows carry, of which there are at most ``most``, are broadcast, so that their rows
    stay where they are; the rest is joined by key, and no partition gets more than its share. ``how``: inner or left.
    Column ``n`` is dropped.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = right.filter(F.col(n) > max(1, total // most))
    rest = [c for c in right.columns if c not in keys and c != n]
    first = left.join(F.broadcast(hot.select(*keys, *rest)), keys)
    other = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.filter(F.col(n) <= max(1, total // most)).select(*keys, *rest), keys, how)
    return first.select(*left.columns, *rest).unionByName(other.select(*left.columns, *rest))
