"""Detectors over ``(metric, ts, value)`` series.

A series holds one point per metric and period: callers aggregate to that grain first, with map-side
combine, so a window partition is as long as the calendar and never as large as a raw hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY_ORDER = {"critical": 0, "warning": 1, "info": 2}


def _w(metric: str, ts: str):
    return Window.partitionBy(metric).orderBy(ts)


def moving_average(df: DataFrame, window: int = 4, metric: str = "metric", ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean of the last ``window`` points at every point; null until the window is full."""
    w = _w(metric, ts).rowsBetween(-(window - 1), 0)
    return df.withColumn("ma", F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def series_profile(df: DataFrame, window: int = 4) -> DataFrame:
    """One row per metric with everything the detectors need, from one sort of each series."""
    w = _w("metric", "ts")
    prev = F.lag("value").over(w)
    pts = (
        df.withColumn("x", F.row_number().over(w) - 1)
        .withColumn("ma_before", F.avg("value").over(w.rowsBetween(-window, -1)))
        .withColumn("falls", F.coalesce(F.col("value") < prev, F.lit(False)))
    )
    # a run ends at every non-falling point, so points of one run share the count of breaks so far
    pts = pts.withColumn("run_id", F.sum(F.when(F.col("falls"), 0).otherwise(1)).over(w))
    pts = pts.withColumn("run", F.sum(F.col("falls").cast("int")).over(Window.partitionBy("metric", "run_id")))
    r2 = F.when(F.min("value") == F.max("value"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.regr_r2("value", "x")))
    prof = pts.groupBy("metric").agg(
        F.count("*").alias("n"), F.max_by("value", "x").alias("latest"), F.max_by("ma_before", "x").alias("ma_before"),
        F.max("run").alias("longest_decline"), F.regr_slope(F.col("value"), F.col("x").cast("double")).alias("slope"),
        F.avg("value").alias("mean"), r2.alias("r2"),
    )
    rel = F.when(F.col("mean") != 0, F.col("slope") / F.abs("mean")).otherwise(0.0)
    direction = F.when(rel > 0.05, "rising").when(rel < -0.05, "falling").otherwise("stable")
    return prof.withColumn("direction", F.when(F.col("n") >= 3, direction))


def ma_deviation(profile: DataFrame, window: int = 4) -> DataFrame:
    ratio = F.col("latest") / F.col("ma_before")
    ok = (F.col("n") >= window + 1) & (F.col("ma_before") != 0)
    return (
        profile.filter(ok).withColumn("ratio", ratio).filter("ratio < 0.85")
        .withColumn("severity", F.when(F.col("ratio") < 0.7, "critical").otherwise("warning"))
    )


def consecutive_decline(profile: DataFrame, at_least: int = 3) -> DataFrame:
    return profile.filter(F.col("longest_decline") >= at_least).withColumn(
        "severity", F.when(F.col("longest_decline") >= 5, "critical").otherwise("warning"))


def trend_anomaly(profile: DataFrame) -> DataFrame:
    sev = F.when(F.col("direction") == "rising", "info").when(F.col("r2") > 0.8, "critical").otherwise("warning")
    return profile.filter("direction <> 'stable' AND r2 >= 0.5").withColumn("severity", sev)


def severity_rank(sev: Column) -> Column:
    return F.when(sev == "critical", 0).when(sev == "warning", 1).otherwise(2)


def analyze_series(df: DataFrame) -> DataFrame:
    """All detectors on every metric with four points or more: ``(metric, type, severity, measure, pos)``.

    One profile row per metric is expanded to its at most three findings, so the series are sorted once.
    """
    p = series_profile(df).filter("n >= 4")
    ratio = F.col("latest") / F.col("ma_before")
    deviates = (F.col("n") >= 5) & (F.col("ma_before") != 0) & (ratio < 0.85)
    trend = (F.col("direction") != "stable") & (F.col("r2") >= 0.5)
    tsev = F.when(F.col("direction") == "rising", "info").when(F.col("r2") > 0.8, "critical").otherwise("warning")

    def finding(cond, pos, kind, sev, measure):
        return F.when(cond, F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("type"), sev.alias("severity"),
                                     measure.cast("double").alias("measure")))

    items = F.array_compact(F.array(
        finding(deviates, 0, "ma_deviation", F.when(ratio < 0.7, "critical").otherwise("warning"), ratio),
        finding(F.col("longest_decline") >= 3, 1, "consecutive_decline",
                F.when(F.col("longest_decline") >= 5, "critical").otherwise("warning"), F.col("longest_decline")),
        finding(trend, 2, "trend", tsev, F.col("slope")),
    ))
    return p.select("metric", F.inline(items)).withColumn("severity_rank", severity_rank(F.col("severity")))


def series_from_snapshots(df: DataFrame, last_n: int, only: list[str] | None = None) -> DataFrame:
    """Series from the last ``last_n`` (4 to 12) snapshots ``(snapshot, metrics MAP<STRING,DOUBLE>)``; null values skipped."""
    n = max(4, min(12, last_n))
    newest = df.select("snapshot").distinct().orderBy(F.desc("snapshot")).limit(n)
    long = df.join(newest, "snapshot", "left_semi").select(
        "snapshot", F.explode("metrics").alias("metric", "value")).filter(F.col("value").isNotNull())
    if only:
        long = long.filter(F.col("metric").isin(*only))
    return long.select("metric", F.col("snapshot").alias("ts"), "value")


def first_last_trend(df: DataFrame, key: str = "dimension", date: str = "report_date", level: str = "level") -> DataFrame:
    """First against last report per dimension: improved / stagnant / regressed."""
    agg = df.groupBy(key).agg(F.min_by(level, date).alias("first_level"), F.max_by(level, date).alias("last_level"))
    d = F.col("last_level") - F.col("first_level")
    return agg.withColumn("trend", F.when(d > 0, "improved").when(d < 0, "regressed").otherwise("stagnant"))


def prior_report(df: DataFrame, by: str, date: str = "report_date", ident: str = "report_id") -> DataFrame:
    """As-of look-up: for each report the latest one of a strictly earlier date in its series.

    Reports are first reduced to one per (series, date) — the largest id stands for the date — and ``lag`` runs
    over dates, so repeated dates neither see each other nor inflate the window.
    """
    per_day = df.groupBy(by, date).agg(F.max(ident).alias("day_id"))
    w = Window.partitionBy(by).orderBy(date)
    prior = per_day.select(by, date, F.lag("day_id").over(w).alias("prior_id"), F.lag(date).over(w).alias("prior_date"))
    return df.join(prior, [by, date], "left")


def score_drift(df: DataFrame, by: str, date: str, dims: list[str], cap: float = 4.0) -> DataFrame:
    """Drift of dimension scores against the prior row: sum of absolute changes / 4 (capped at 1) and step score."""
    w = Window.partitionBy(by).orderBy(date)
    deltas = [F.abs(F.col(d) - F.lag(d).over(w)) for d in dims]
    step = [F.when(x <= 1, 1.0).when(x <= 2, 0.5).otherwise(0.0) for x in deltas]
    total, steps = deltas[0], step[0]
    for x, s in zip(deltas[1:], step[1:]):
        total, steps = total + x, steps + s
    has_prev = F.lag(dims[0]).over(w).isNotNull()
    return df.select(
        by, date, F.when(has_prev, F.least(F.lit(1.0), total / cap)).alias("drift"),
        F.when(has_prev, steps / len(dims)).alias("consistency"))
