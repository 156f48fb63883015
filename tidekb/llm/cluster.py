"""Connected components, and grouped rows as numpy columns inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekb.llm.common import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, comp) for every end of an edge: comp is the smallest id that edges lead to. Ids are longs.

    Alternates two star steps: every larger neighbour of a node, then every smaller one, is linked to the smallest
    neighbour. Rounds grow with the logarithm of the longest path; each is written to the shared folder. Smallest
    neighbours are aggregated before the shuffle, and joins on a node with very many edges are split by Spark.
    """
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    state = None
    while True:
        now = stored(now, "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state or new[0] == 0:
            break
        state = new
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct()


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, starts, ends) of the runs of two rows or more that agree in the first ``keys`` columns (integers); input is sorted by them."""
    held: pa.Table | None = None
    for b in batches:
        rows = pa.concat_tables([held, pa.Table.from_batches([b])]) if held is not None else pa.Table.from_batches([b])
        rows = rows.combine_chunks()
        change = np.zeros(max(0, rows.num_rows - 1), bool)
        for k in range(keys):
            x = rows.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        edge = np.flatnonzero(change) + 1
        last = int(edge[-1]) if len(edge) else 0
        if last:
            starts = np.concatenate([[0], edge[:-1]])
            many = edge - starts > 1
            if many.any():
                yield rows.slice(0, last).combine_chunks().to_batches()[0], starts[many], edge[many]
        held = rows.slice(last)
    if held is not None and held.num_rows > 1:
        yield held.combine_chunks().to_batches()[0], np.array([0]), np.array([held.num_rows])


def lowest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the smallest id that links lead to, its own included."""
    low = ids.copy()
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            return low
        low = new


def split_pairs(df: DataFrame, ident: str, blocks: str) -> DataFrame:
    """Repeat each row once per pair of blocks that its own block is part of: ``own``, ``lo`` and ``hi`` are added.

    Every pair of rows of a group meets in one (lo, hi): within a block where lo = hi, across two blocks otherwise.
    """
    own = F.pmod(F.xxhash64(ident), F.col(blocks))
    return df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")
