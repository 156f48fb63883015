"""Log analytics over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidekb.catalog import inputs as I
from tidekb.catalog.base import query, table
from tidekb.operators import logs as G


def fetch_log(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "fetch_start").when(F.col("event_type") == "error", "fetch_skip").when(F.col("event_type") == "purchase", "fetch_complete").otherwise("fetch_page")
    return e.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), "ts", kind.alias("event"), F.regexp_extract("props", r'"k": (\d)', 1).alias("mode"), F.col("value").alias("duration_sec"))


_F = r"""fl AS (SELECT 's' || user_id AS session_id, ts, CASE event_type WHEN 'signup' THEN 'fetch_start' WHEN 'error' THEN 'fetch_skip' WHEN 'purchase' THEN 'fetch_complete' ELSE 'fetch_page' END AS event, regexp_extract(props, '"k": (\d)', 1) AS mode, value AS duration_sec FROM events),
fs AS (SELECT session_id, min(ts) FILTER (event='fetch_start') AS started, max_by(mode, ts) FILTER (event='fetch_start') AS mode, count(*) FILTER (event='fetch_page') AS pages, count(*) FILTER (event='fetch_skip') AS skips, min_by(duration_sec, ts) FILTER (event='fetch_complete') AS duration_sec FROM fl GROUP BY 1)"""


@query("l01_fetch_sessions", f"WITH {_F} SELECT session_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, mode, pages, skips, duration_sec FROM fs")
def _(spark, sf):
    return G.fetch_sessions(fetch_log(spark, sf)).withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


@query("l01_fetch_totals", f"WITH {_F} SELECT count(started) AS sessions, sum(pages)::BIGINT AS pages, sum(skips)::BIGINT AS skips FROM fs")
def _(spark, sf):
    return G.fetch_totals(G.fetch_sessions(fetch_log(spark, sf)))


@query("l02_top_accessed", f"WITH {I.LOG}, t AS (SELECT rid AS id, count(*) AS hits, min(event_id) AS first_seen FROM log GROUP BY 1 ORDER BY hits DESC, first_seen LIMIT 20) SELECT id, hits, first_seen, lang AS category, split_part(text, '.', 1) AS question FROM t LEFT JOIN documents ON doc_id = id")
def _(spark, sf):
    return G.top_accessed(I.access_log(spark, sf), I.kb(spark, sf).withColumnRenamed("lang", "category"), 20)


@query("l03_by_client", f"""WITH {I.LOG}, d AS (SELECT DISTINCT client, rid::VARCHAR AS id FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY id) AS rn FROM d)
SELECT c.client::VARCHAR AS client, requests, click, view, (SELECT count(*) FROM d WHERE d.client = c.client) AS distinct_ids, (SELECT string_agg(id, '|' ORDER BY id) FROM r WHERE r.client = c.client AND rn <= 10) AS first_ids
FROM (SELECT client, count(*) AS requests, count(*) FILTER (event='click') AS click, count(*) FILTER (event='view') AS view FROM log GROUP BY 1) c""")
def _(spark, sf):
    return G.by_client(I.access_log(spark, sf), ["click", "view"]).withColumn("first_ids", F.array_join("first_ids", "|"))


@query("l04_daily_report", f"""WITH {_F}, a AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type='click') AS searches, count(*) FILTER (event_type='view') AS chats, count(*) FILTER (event_type='signup') AS lists FROM events GROUP BY 1),
f AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event='fetch_page') AS pages, count(*) FILTER (event='fetch_skip') AS skips, round(sum(duration_sec) FILTER (event='fetch_complete'), 2) AS seconds FROM fl GROUP BY 1)
SELECT coalesce(f.day, a.day) AS day, pages, skips, seconds, searches, chats, lists FROM f FULL JOIN a ON a.day = f.day""")
def _(spark, sf):
    names = {"click": "search", "view": "chat", "signup": "list_qa"}
    ev = F.coalesce(*[F.when(F.col("event") == k, v) for k, v in names.items()], F.col("event"))
    return G.daily_report(fetch_log(spark, sf), I.access_log(spark, sf).withColumn("event", ev)).drop("approx_clients").withColumn("seconds", F.round("seconds", 2))


@query("l04_daily_top_clients", """WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS item, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, item) AS rank FROM c) WHERE rank <= 5""")
def _(spark, sf):
    return G.daily_top(I.access_log(spark, sf), "client", 5)


@query("l05_timeline", r"""SELECT event_id, event_type AS event, 'k=' || regexp_extract(props, '"k": (\d+)', 1) || CASE WHEN value >= 5 THEN ',v=' || event_type ELSE '' END AS filters FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'""")
def _(spark, sf):
    log = I.access_log(spark, sf).withColumn("filters", F.create_map(F.lit("k"), F.col("returned_ids")[0].cast("string"), F.lit("v"), F.when(F.col("top_score").isNotNull(), F.col("event"))))
    t = G.timeline(log, "click", "2024-01-10")
    return t.select("event_id", "event", F.array_join(F.transform(F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("filters"))


@query("l06_feedback_cases", r"""SELECT props AS query, '[feedback] ' || CASE WHEN event_type = 'error' THEN 'not_relevant' ELSE 'ok' END || CASE WHEN value > 30 THEN ' / outdated' ELSE '' END AS scenario, event_id AS qa_id, value AS top_score
FROM events WHERE event_type = 'error' OR value > 30 ORDER BY ts DESC, event_id LIMIT 100""")
def _(spark, sf):
    e = table(spark, sf, "events")
    f = e.select(F.col("props").alias("query"), F.when(F.col("event_type") == "error", "not_relevant").otherwise("ok").alias("feedback"), F.when(F.col("value") > 30, "outdated").alias("feedback_category"),
                 F.col("event_id").alias("qa_id"), F.col("value").alias("top_score"), F.col("ts").alias("created_at"))
    return G.feedback_cases(f).drop("created_at")


@query("l07_miss_rate", f"WITH {I.LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS searches, count(*) FILTER (coalesce(top_score < 8, true)) AS misses FROM log WHERE event = 'click' GROUP BY 1")
def _(spark, sf):
    return G.miss_rate(I.access_log(spark, sf).filter("event = 'click'"), 8.0)


@query("l07_search_misses", """WITH s AS (SELECT b.item_id AS query_id, max(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS m FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings e ON e.vec_id <> b.item_id GROUP BY 1)
SELECT query_id, round(m, 4) AS top_score FROM s WHERE m < 0.4""")
def _(spark, sf):
    from tidekb.catalog.search_queries import q, vectors
    from tidekb.operators import search as S

    h = S.vector_search(vectors(spark, sf), q(spark, sf), 2).filter("seq <> query_id")
    return G.search_misses(S.retrieval_gate(q(spark, sf), h))


# lifetimes in SQL: walk the seconds of each query; a call starts a new lifetime only when the last one is over
@query("l08_cache_reuse", """WITH RECURSIVE s AS (SELECT sha256(event_type || ' ' || (user_id // 10)) AS query_hash, date_trunc('second', ts) AS t, count(*) AS calls FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY t) AS p FROM s),
w AS (SELECT query_hash, p, t, calls, t AS anchor, 1 AS miss FROM o WHERE p = 1 UNION ALL SELECT o.query_hash, o.p, o.t, o.calls, CASE WHEN o.t >= w.anchor + INTERVAL 2 HOUR THEN o.t ELSE w.anchor END, CASE WHEN o.t >= w.anchor + INTERVAL 2 HOUR THEN 1 ELSE 0 END FROM w JOIN o ON o.query_hash = w.query_hash AND o.p = w.p + 1)
SELECT query_hash, sum(calls)::BIGINT AS calls, sum(calls - miss)::BIGINT AS hits FROM w GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select(G.query_hash(F.concat(F.lit(" "), "event_type", F.lit("  "), F.floor(F.col("user_id") / 10).cast("string"))).alias("query_hash"), "ts")
    return G.cache_reuse(e).groupBy("query_hash").agg(F.sum("calls").alias("calls"), F.sum("hits").alias("hits"))


@query("l09_repeated_calls", """WITH c AS (SELECT 's' || user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS name FROM events),
l AS (SELECT *, lag(name) OVER (PARTITION BY session_id ORDER BY pos) AS prev FROM c) SELECT session_id, pos, name FROM l WHERE name = prev""")
def _(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    c = e.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), pos.alias("pos"), F.col("event_type").alias("name"), F.lit("").alias("args"))
    return G.repeated_calls(c)


@query("l09_sources_first_seen", r"""SELECT conv_id AS session_id, w AS id, min(turn) AS first_pos FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS w FROM conversations) GROUP BY 1, 2""")
def _(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))).alias("id"))
    return G.first_seen_sources(c)


@query("l10_online_scores", """SELECT conv_id, turn, (length(trim(text)) > 50)::INT::DOUBLE AS answer_length, (turn > 1)::INT::DOUBLE AS has_sources, CASE WHEN turn > 1 THEN turn / 10.0 END::DOUBLE AS top_source_score, CASE WHEN turn > 1 THEN least(turn / 5.0, 1.0) END::DOUBLE AS source_count FROM conversations WHERE role = 'assistant'""")
def _(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"), F.when(F.col("turn") > 1, F.col("turn")).otherwise(0).alias("n_sources"), (F.col("turn") / 10).alias("top_score"))
    return G.online_scores(c).select("conv_id", "turn", "answer_length", "has_sources", "top_source_score", "source_count")
