"""Distributed numbering: a global ``row_number`` without pulling the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidekb.session import written


def positions(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "rank",
              group_name: str | None = None, parts: int | None = None) -> DataFrame:
    """Add each row's place (0, 1, ...) among the rows of its group, in ascending ``order``, nulls first.

    Rows are sorted by range partitioning and written once; a row's place is its index in its partition plus the number
    of its group's rows in the partitions before. Those prefix sums are a table of one row per (partition, group), which
    is joined back, so nothing passes through the driver and the plan is the same at every size. A group may hold all
    rows. ``order`` has to tell rows apart (add a row id), or equal rows share one range. group_name: also number the
    groups, in ascending order of their keys.
    """
    by = list(by or [])
    keys = [F.col(c).asc_nulls_first() for c in [*by, *order]]
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    rows = written(ranged.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*by or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if group_name:
        starts = counts.groupBy(*by).agg(F.min("_first").alias("_start")).withColumn("_home", F.shiftright("_start", 33))
        local = F.row_number().over(Window.partitionBy("_home").orderBy("_start")) - 1
        per_part = starts.groupBy("_home").agg(F.count("*").alias("_k"))
        earlier = Window.partitionBy(F.lit(0)).orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)
        per_part = per_part.select("_home", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_off"))
        starts = starts.withColumn("_local", local).join(per_part, "_home")
        starts = starts.select(*[F.col(c).alias(f"_g_{c}") for c in by], (F.col("_local") + F.col("_off")).alias("_group"))
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        counts = counts.join(starts, same)
    extra = [F.col("_group").alias("_p_group")] if group_name else []
    shift = counts.select(F.col("_part").alias("_p_part"), *[F.col(c).alias(f"_p_{c}") for c in by], "_first", "_before", *extra)
    same = F.col("_part") == F.col("_p_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    out = rows.join(shift, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
    if group_name:
        out = out.withColumn(group_name, F.col("_p_group"))
    return out.select(*df.columns, name, *([group_name] if group_name else []))


def with_row_number(df: DataFrame, seq: str, name: str = "rn", parts: int | None = None) -> DataFrame:
    """Number all rows 1..n in the order of the unique numeric column ``seq``."""
    return positions(df, [seq], name=name, parts=parts).withColumn(name, F.col(name) + 1)


def top_per_group(df: DataFrame, group: list[str] | str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group; Spark prunes each map partition to k rows per group before the shuffle."""
    group = [group] if isinstance(group, str) else group
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
