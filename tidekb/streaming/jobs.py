"""Streaming transformations and sinks.

Every transformation takes and returns a streaming DataFrame; it also runs on a batch DataFrame where Spark allows,
which is how the tests compare stream and batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidekb.sources.tables import upsert
from tidekb.streaming import versions


# ---- S1 ----
def hit_counts(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Counts per day and returned id from ``(ts, returned_ids, event, top_score)``; update or append mode."""
    kept = log.withWatermark("ts", lateness).filter(F.col("event").isin("search", "chat") & F.col("top_score").isNotNull())
    ids = kept.select("ts", F.explode("returned_ids").alias("id"))
    return ids.groupBy(F.window("ts", "1 day").alias("w"), "id").agg(F.count("*").alias("hits")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "id", "hits")


# ---- S2 ----
def arriving_articles(arrivals: DataFrame, known: DataFrame, lateness: str = "1 day") -> DataFrame:
    """First arrival of each guid inside the watermark that the static table does not know yet."""
    seen = known.select("guid").distinct().withColumn("_known", F.lit(True))
    fresh = arrivals.join(seen, "guid", "left").filter(F.col("_known").isNull()).drop("_known")
    return fresh.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["guid"])


# ---- S3 ----
def _latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def upsert_sink(path: str, key: str, version: str):
    """``foreachBatch`` writer: the latest row per key of each micro-batch becomes a folder of its own and is published by a
    new version of the table's manifest. A repeated batch changes nothing, also after it was compacted; no micro-batch
    rewrites the table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        versions.add_batch(_latest(batch, key, version), path, batch_id)

    return write


def read_upserted(spark: SparkSession, path: str, key: str, version: str) -> DataFrame:
    """The latest row per key of the newest version, read as a whole whatever a compaction does meanwhile."""
    rows = versions.read_version(spark, path)
    if rows is None:
        raise ValueError(f"no batch was written to {path}")
    return upsert(rows.limit(0), rows, key, version)


def compact(spark: SparkSession, path: str, key: str, version: str) -> int:
    """Fold all batches of the newest version into one folder that readers see from one version to the next."""
    return versions.compact(spark, path, lambda rows: _latest(rows, key, version))


# ---- S4 ----
def weekly_deviation(points: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Week total against the mean of the four weeks before it, from ``(metric, ts, value)``; append mode.

    Two chained window aggregations: tumbling weeks, then a sliding window of five weeks over their ends.
    """
    weeks = points.withWatermark("ts", lateness).groupBy(F.window("ts", "7 days").alias("w"), "metric").agg(F.sum("value").alias("value"))
    weeks = weeks.select("metric", "value", F.window_time("w").alias("at"))
    five = weeks.groupBy(F.window("at", "35 days", "7 days").alias("w5"), "metric").agg(
        F.count("*").alias("n"), F.max_by("value", "at").alias("latest"), F.sum("value").alias("total"), F.max("at").alias("last_at"))
    ma = (F.col("total") - F.col("latest")) / 4
    full = (F.col("n") == 5) & (ma != 0)
    ratio = F.col("latest") / ma
    return five.filter(full).select("metric", F.col("w5.end").alias("week_end"), F.round("latest", 2).alias("latest"), F.round(ma, 4).alias("ma"),
                                    F.when(ratio < 0.7, "critical").when(ratio < 0.85, "warning").otherwise("ok").alias("severity"))


# ---- S5 ----
def fetch_sessions(log: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Pages and skips per client and activity session; append mode, late events beyond the watermark are dropped."""
    s = log.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("s"), "client").agg(
        F.count("*").alias("events"), F.count_if(F.col("event") == "fetch_page").alias("pages"), F.count_if(F.col("event") == "fetch_skip").alias("skips"))
    return s.select("client", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events", "pages", "skips")


# ---- S6, S7: keyed state ----
REUSE_STATE, REUSE_OUT = "anchor long", "query_hash string, calls long, hits long"


def _reuse_step(key, frames: Iterator[pd.DataFrame], state, ttl: int):
    if state.hasTimedOut:  # the watermark passed the anchor's lifetime: the next call is a miss with or without it
        state.remove()
        return
    secs = np.concatenate([f["sec"].to_numpy() for f in frames])
    anchor = state.get[0] if state.exists else None
    uniq = np.unique(secs)
    misses, i = 0, 0
    if anchor is not None:
        i = int(np.searchsorted(uniq, anchor + ttl, side="left"))
    while i < len(uniq):
        anchor, misses = int(uniq[i]), misses + 1
        i = int(np.searchsorted(uniq, anchor + ttl, side="left"))
    state.update((anchor,))
    expiry = (anchor + ttl) * 1000
    state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"query_hash": [key[0]], "calls": [len(secs)], "hits": [len(secs) - misses]})


def cache_reuse(log: DataFrame, ttl_seconds: int = 7200, lateness: str = "1 hour") -> DataFrame:
    """Reuse increments per query hash and micro-batch from ``(query_hash, ts)`` in time order across batches.

    State is one anchor per hash and leaves when the watermark passes its lifetime. Summed over a replay the output
    equals the batch operator.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    secs = timed.select("query_hash", "ts", F.col("ts").cast("long").alias("sec"))
    return secs.groupBy("query_hash").applyInPandasWithState(
        lambda k, f, s: _reuse_step(k, f, s, ttl_seconds), REUSE_OUT, REUSE_STATE, "append", "EventTimeTimeout")


DECLINE_STATE, DECLINE_OUT = "last double, run long, best long", "metric string, run long, best long"


def _decline_step(key, frames: Iterator[pd.DataFrame], state):
    pts = pd.concat(list(frames)).sort_values("ts")["value"].to_numpy()
    last, run, best = state.get if state.exists else (None, 0, 0)
    for v in pts:
        run = run + 1 if last is not None and v < last else 0
        best, last = max(best, run), float(v)
    state.update((last, int(run), int(best)))
    yield pd.DataFrame({"metric": [key[0]], "run": [int(run)], "best": [int(best)]})


def decline_runs(points: DataFrame) -> DataFrame:
    """Current and longest run of falls per metric after each micro-batch of in-order points ``(metric, ts, value)``."""
    return points.select("metric", "ts", "value").groupBy("metric").applyInPandasWithState(_decline_step, DECLINE_OUT, DECLINE_STATE, "update", "NoTimeout")


ORDERED_STATE = "last double, run long, best long, ts array<timestamp>, value array<double>"


def _fold(values: np.ndarray, last: float | None, run: int, best: int) -> tuple[float | None, int, int]:
    for v in values:
        run = run + 1 if last is not None and v < last else 0
        best, last = max(best, run), float(v)
    return last, int(run), int(best)


def _ordered_step(key, frames: Iterator[pd.DataFrame], state):
    last, run, best, ts, value = state.get if state.exists else (None, 0, 0, [], [])
    ts, value = np.array(ts, "datetime64[ns]"), np.array(value, float)
    for f in frames:
        ts = np.concatenate([ts, f["ts"].to_numpy().astype("datetime64[ns]")])
        value = np.concatenate([value, f["value"].to_numpy(float)])
    order = np.lexsort([value, ts])
    ts, value = ts[order], value[order]
    settled = int(np.searchsorted(ts, np.datetime64(state.getCurrentWatermarkMs(), "ms"), side="left"))
    last, run, best = _fold(value[:settled], last, run, best)
    ts, value = ts[settled:], value[settled:]
    state.update((last, run, best, [pd.Timestamp(t).to_pydatetime() for t in ts], value.tolist()))
    _, run, best = _fold(value, last, run, best)
    yield pd.DataFrame({"metric": [key[0]], "run": [run], "best": [best]})


def ordered_decline_runs(points: DataFrame, lateness: str) -> DataFrame:
    """``decline_runs`` of points ``(metric, ts, value)`` that arrive in any order, up to ``lateness`` late.

    Points wait in the state until the watermark has passed them and are folded in order of time then; Spark drops points
    behind the watermark. What is given out after each micro-batch counts the waiting points in their order too, so the last
    output of a metric is that of its whole series.
    """
    timed = points.select("metric", "ts", "value").withWatermark("ts", lateness)
    return timed.groupBy("metric").applyInPandasWithState(_ordered_step, DECLINE_OUT, ORDERED_STATE, "update", "EventTimeTimeout")


# ---- running ----
def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Work off what the source holds and stop: append mode into Parquet."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, writer, checkpoint: str, mode: str = "update") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def batch_writer(path: str):
    """``foreachBatch`` writer that keeps every micro-batch's rows under its batch id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
