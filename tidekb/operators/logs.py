"""Access, fetch and chat log analytics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekb.functions.text import col


def fetch_sessions(log: DataFrame) -> DataFrame:
    """``(session_id, ts, event, mode, duration_sec)`` to one row per session: start fields, pages, skips, duration."""
    ev = F.col("event")
    start, done = ev == "fetch_start", ev == "fetch_complete"
    return log.groupBy(F.coalesce("session_id", F.lit("unknown")).alias("session_id")).agg(
        F.min(F.when(start, F.col("ts"))).alias("started"), F.max_by(F.when(start, F.col("mode")), F.when(start, F.col("ts"))).alias("mode"),
        F.count_if(ev == "fetch_page").alias("pages"), F.count_if(ev == "fetch_skip").alias("skips"),
        F.min_by(F.when(done, F.col("duration_sec")), F.when(done, F.col("ts"))).alias("duration_sec"))


def fetch_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("started").alias("sessions"), F.sum("pages").alias("pages"), F.sum("skips").alias("skips"))


def top_accessed(log: DataFrame, kb: DataFrame, n: int, key: str = "seq") -> DataFrame:
    """Most returned rows with category and question; ties by first appearance."""
    ids = log.select("event_id", F.explode("returned_ids").alias("id")).groupBy("id").agg(F.count("*").alias("hits"), F.min("event_id").alias("first_seen"))
    top = ids.orderBy(F.desc("hits"), F.asc("first_seen")).limit(n)
    return top.join(kb.select(F.col(key).alias("id"), "category", "question"), "id", "left")


def by_client(log: DataFrame, events: list[str]) -> DataFrame:
    """Requests per client and event, distinct ids and the ten smallest of them.

    Ids are made distinct per client first; only ten per client are ever put into an array.
    """
    c = F.coalesce(F.col("client").cast("string"), F.lit("unknown")).alias("client")
    counts = log.groupBy(c).agg(F.count("*").alias("requests"), *[F.count_if(F.col("event") == e).alias(e) for e in events])
    ids = log.select(c, F.explode("returned_ids").alias("id")).filter("id IS NOT NULL").select("client", F.col("id").cast("string").alias("id")).distinct()
    from tidekb.functions.ranking import top_per_group

    firsts = top_per_group(ids, "client", [F.asc("id")], 10).groupBy("client").agg(F.array_sort(F.collect_list("id")).alias("first_ids"))
    n = ids.groupBy("client").agg(F.count("*").alias("distinct_ids"))
    return counts.join(n, "client", "left").join(firsts, "client", "left").orderBy(F.desc("requests"), "client")


def daily_report(fetch: DataFrame, access: DataFrame) -> DataFrame:
    """Pages, skips and seconds from the fetch log and searches, chats and lists from the access log, per day."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    f = fetch.groupBy(day).agg(
        F.count_if(F.col("event") == "fetch_page").alias("pages"), F.count_if(F.col("event") == "fetch_skip").alias("skips"),
        F.sum(F.when(F.col("event") == "fetch_complete", F.col("duration_sec"))).alias("seconds"))
    a = access.groupBy(day).agg(*[F.count_if(F.col("event") == e).alias(n) for e, n in (("search", "searches"), ("chat", "chats"), ("list_qa", "lists"))],
                                F.approx_count_distinct("client").alias("approx_clients"))
    return f.join(a, "day", "full_outer")


def daily_top(log: DataFrame, what: str, n: int) -> DataFrame:
    """The ``n`` most frequent values of ``what`` per day."""
    from tidekb.functions.ranking import top_per_group

    counts = log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col(what).alias("item")).agg(F.count("*").alias("n"))
    return top_per_group(counts, "day", [F.desc("n"), F.asc("item")], n)


def timeline(log: DataFrame, event: str | None = None, day: str | None = None) -> DataFrame:
    """Events in time order with only the active (non-null) filters of each."""
    out = log
    if event:
        out = out.filter(F.col("event") == event)
    if day:
        d = F.lit(day).cast("timestamp")
        out = out.filter((F.col("ts") >= d) & (F.col("ts") < d + F.expr("INTERVAL 1 DAY")))
    return out.withColumn("filters", F.map_filter("filters", lambda k, v: v.isNotNull())).orderBy("ts", "event_id")


def feedback_cases(feedback: DataFrame, n: int = 100) -> DataFrame:
    """Negative feedback as candidate test cases, newest first."""
    bad = (F.col("feedback") == "not_relevant") | F.col("feedback_category").isin("wrong_answer", "wrong_source", "outdated")
    scenario = F.concat(F.lit("[feedback] "), F.col("feedback"), F.coalesce(F.concat(F.lit(" / "), "feedback_category"), F.lit("")))
    return feedback.filter(bad).select("query", scenario.alias("scenario"), "qa_id", "top_score", "created_at").orderBy(F.desc("created_at"), "qa_id").limit(n)


def search_misses(gated: DataFrame) -> DataFrame:
    return gated.filter("gate = 'incorrect'").select("query_id", F.round("top_score", 4).alias("top_score"))


def miss_rate(log: DataFrame, limit: float = 0.4) -> DataFrame:
    miss = F.coalesce(F.col("top_score") < limit, F.lit(True))
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("searches"), F.count_if(miss).alias("misses"))


def query_hash(query):
    return F.sha2(F.regexp_replace(F.trim(F.lower(col(query))), r"\s+", " "), 256)


def cache_reuse(log: DataFrame, ttl_seconds: int = 7200) -> DataFrame:
    """Would a response cache have answered? Per ``(query_hash, sec)`` of ``(query_hash, ts)``: number of calls and of hits.

    Calls are first counted per hash and second with map-side combine, which bounds a hash's group by the seconds of
    the log however often it is asked. Inside a hash, lifetimes restart only on a miss: the fold jumps from one miss
    to the first call after its lifetime.
    """
    per_sec = log.groupBy("query_hash", F.col("ts").cast("timestamp").cast("long").alias("sec")).agg(F.count("*").alias("calls"))

    def fold(table):
        t = table.sort_by("sec")
        sec = t["sec"].to_numpy()
        miss = np.zeros(len(sec), dtype=np.int64)
        i = 0
        while i < len(sec):
            miss[i] = 1
            i = int(np.searchsorted(sec, sec[i] + ttl_seconds, side="left"))
        calls = t["calls"].to_numpy()
        return pa.table({"query_hash": t["query_hash"].cast(pa.string()), "sec": pa.array(sec), "calls": pa.array(calls), "hits": pa.array(calls - miss)})

    return per_sec.groupBy("query_hash").applyInArrow(fold, "query_hash string, sec long, calls long, hits long")


def repeated_calls(calls: DataFrame) -> DataFrame:
    """Calls equal to the one just before them: ``(session_id, pos, name, args)`` with consecutive ``pos``.

    An equi-join on (session, position) over digests: no session, however long, ends up in one task.
    """
    sig = F.sha2(F.to_json(F.struct("name", "args")), 256)
    now = calls.select("session_id", "pos", "name", sig.alias("sig"))
    before = now.select("session_id", (F.col("pos") + 1).alias("pos"), F.col("sig").alias("prev"))
    return now.join(before, ["session_id", "pos"]).filter("sig = prev").select("session_id", "pos", "name")


def first_seen_sources(calls: DataFrame) -> DataFrame:
    """Distinct source ids per session at their first position: ``(session_id, pos, id)`` in, numbered out."""
    first = calls.filter("id IS NOT NULL").groupBy("session_id", "id").agg(F.min("pos").alias("first_pos"))
    return first


def online_scores(chats: DataFrame) -> DataFrame:
    """Scores of logged chats ``(answer, n_sources, top_score)``."""
    n = F.col("n_sources")
    return chats.withColumns({
        "answer_length": (F.length(F.trim(F.coalesce("answer", F.lit("")))) > 50).cast("double"), "has_sources": (n > 0).cast("double"),
        "top_source_score": F.when(n > 0, F.coalesce("top_score", F.lit(0.0))), "source_count": F.when(n > 0, F.least(n / 5, F.lit(1.0)))})
