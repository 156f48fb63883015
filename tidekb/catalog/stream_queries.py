"""Streaming operators replayed over the driver tables as file sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidekb.catalog import base
from tidekb.catalog import inputs as I
from tidekb.catalog import log_queries  # noqa: F401
from tidekb.catalog.base import ORACLE, query, stored, table
from tidekb.catalog.metric_queries import PROFILE
from tidekb.operators import logs as G
from tidekb.session import ensure_checkpoint_dir
from tidekb.streaming import jobs as J


TIMES = {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"}
SLICES, FILES = 3, 4


def _sliced(spark, sf, name):
    """The table cut into slices of time, written one after another, each as a few files that hold a share of the whole slice."""
    key = (spark.sparkContext.applicationId, sf, f"slices_{name}")
    if key not in base._STORED:
        t = table(spark, sf, name)
        at = F.col(TIMES[name]).cast("timestamp").cast("long")
        low, high = t.agg(F.min(at), F.max(at)).first()
        number = F.least(F.lit(SLICES - 1), F.expr(f"(unix_seconds(cast({TIMES[name]} as timestamp)) - {low}) * {SLICES} div {high - low + 1}"))
        path = work(spark)
        for k in range(SLICES):
            t.filter(number == k).repartition(FILES).write.mode("append").parquet(path)
        base._STORED[key] = path
    return base._STORED[key]


def source(spark, sf, name):
    """A replay in several micro-batches, one per slice of time."""
    schema = table(spark, sf, name).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(_sliced(spark, sf, name))
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def work(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def to_files(spark, stream):
    p = work(spark)
    J.run_to_files(stream, f"{p}/out", f"{p}/cp")
    return spark.read.schema(stream.schema).parquet(f"{p}/out")


def to_batches(spark, stream, mode="update"):
    p = work(spark)
    J.run_batches(stream, J.batch_writer(f"{p}/out"), f"{p}/cp", mode)
    return spark.read.option("basePath", f"{p}/out").parquet(f"{p}/out")


def log_stream(spark, sf):
    e = source(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "chat").when(F.col("event_type") == "error", "fetch_skip").otherwise("fetch_page")
    return e.select("ts", kind.alias("event"), F.col("user_id").alias("client"), F.array(F.regexp_extract("props", r'"k": (\d+)', 1).cast("long")).alias("returned_ids"), F.when(F.col("value") >= 5, F.col("value")).alias("top_score"))


@query("s01_hit_counts", f"WITH {I.LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, rid AS id, count(*) AS hits FROM log WHERE event IN ('click', 'view') AND top_score IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    b = to_batches(spark, J.hit_counts(log_stream(spark, sf)))
    return b.groupBy("day", "id").agg(F.max_by("hits", "batch_id").alias("hits"))


@query("s02_arriving_articles", "SELECT user_id AS guid, count(DISTINCT user_id) AS n FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def _(spark, sf):
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("guid"))
    e = source(spark, sf, "events").select(F.col("user_id").alias("guid"), "ts", "event_type")
    return to_files(spark, J.arriving_articles(e, known, "60 days")).groupBy("guid").agg(F.count("*").alias("n"))


@query("s03_upsert", "SELECT o_custkey AS id, max(o_orderkey) AS version, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def _(spark, sf):
    o = source(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    p = work(spark)
    J.run_batches(o, J.upsert_sink(f"{p}/out", "id", "version"), f"{p}/cp", "append")
    return J.read_upserted(spark, f"{p}/out", "id", "version")


@query("s03_compacted", "SELECT o_custkey AS id, max(o_orderkey) AS version, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def _(spark, sf):
    o = source(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    p = work(spark)
    J.run_batches(o, J.upsert_sink(f"{p}/out", "id", "version"), f"{p}/cp", "append")
    J.compact(spark, f"{p}/out", "id", "version")
    return J.read_upserted(spark, f"{p}/out", "id", "version")


@query("s04_weekly_deviation", """WITH w AS (SELECT l_returnflag AS metric, floor(epoch(l_shipdate) / 604800)::BIGINT AS wk, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2), lim AS (SELECT max(epoch(l_shipdate)) - 86400 AS m FROM lineitem),
f AS (SELECT metric, wk, value, count(*) OVER x AS n, sum(value) OVER x AS total FROM w WINDOW x AS (PARTITION BY metric ORDER BY wk RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT metric, strftime(to_timestamp((wk + 1) * 604800), '%Y-%m-%d') AS week_end, round(value, 2) AS latest, round((total - value) / 4, 4) AS ma, CASE WHEN value / ((total - value) / 4) < 0.7 THEN 'critical' WHEN value / ((total - value) / 4) < 0.85 THEN 'warning' ELSE 'ok' END AS severity FROM f, lim WHERE n = 5 AND (wk + 1) * 604800 <= m""")
def _(spark, sf):
    l = source(spark, sf, "lineitem").select(F.col("l_returnflag").alias("metric"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").alias("value"))
    return to_files(spark, J.weekly_deviation(l)).withColumn("week_end", F.date_format("week_end", "yyyy-MM-dd"))


@query("s05_fetch_sessions", """WITH e AS (SELECT user_id AS client, ts, event_type, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true) AS brk FROM events), s AS (SELECT *, sum(brk::INT) OVER (PARTITION BY client ORDER BY ts) AS sid FROM e),
g AS (SELECT client, sid, min(ts) AS start, max(ts) AS last, count(*) AS events, count(*) FILTER (event_type IN ('signup','purchase')) AS pages, count(*) FILTER (event_type = 'error') AS skips FROM s GROUP BY 1, 2)
SELECT client, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, events, pages, skips FROM g WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(spark, sf):
    s = to_files(spark, J.fetch_sessions(log_stream(spark, sf)))
    return s.select("client", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "pages", "skips")


@query("s06_cache_reuse", ORACLE["l08_cache_reuse"])
def _(spark, sf):
    e = source(spark, sf, "events")
    log = e.select(G.query_hash(F.concat_ws(" ", "event_type", F.floor(F.col("user_id") / 10).cast("string"))).alias("query_hash"), "ts")
    return to_files(spark, J.cache_reuse(log)).groupBy("query_hash").agg(F.sum("calls").alias("calls"), F.sum("hits").alias("hits"))


@query("s07_decline_runs", f"WITH {PROFILE} SELECT metric, longest_decline FROM p")
def _(spark, sf):
    d = stored(spark, sf, "daily_by_user", lambda: I.daily_series(spark, sf, "user_id"))
    p = spark.readStream.schema(d.schema).parquet(_path(spark, sf, "daily_by_user"))
    b = to_batches(spark, J.decline_runs(p))
    return b.groupBy("metric").agg(F.max_by("best", "batch_id").alias("longest_decline"))


@query("s07_ordered", f"WITH {PROFILE} SELECT metric, longest_decline FROM p")
def _(spark, sf):
    d = stored(spark, sf, "daily_by_user", lambda: I.daily_series(spark, sf, "user_id"))
    p = spark.readStream.schema(d.schema).parquet(_path(spark, sf, "daily_by_user")).withColumn("ts", F.col("ts").cast("timestamp"))
    b = to_batches(spark, J.ordered_decline_runs(p, "30 days"))
    return b.groupBy("metric").agg(F.max_by("best", "batch_id").alias("longest_decline"))


def _path(spark, sf, name):
    return base._STORED[(spark.sparkContext.applicationId, sf, name)]
