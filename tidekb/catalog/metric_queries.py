"""Metric and time-series operators over event and order series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidekb import rules
from tidekb.catalog import inputs as I
from tidekb.catalog.base import lit, query, s_in, table
from tidekb.operators import metrics as M
from tidekb.operators import timeseries as T

# ---- G1 ----
_CELLS = """cells AS (SELECT p_partkey, CASE p_mfgr WHEN 'x' THEN '' ELSE '' END AS z FROM part)"""


def cells(spark, sf):
    p = table(spark, sf, "part")
    raw = (
        F.when(F.col("p_size") < 5, "#N/A").when(F.col("p_size") < 10, F.concat(F.col("p_size").cast("string"), F.lit(".5%")))
        .when(F.col("p_size") < 14, F.col("p_name")).when(F.col("p_size") < 17, "nan%").when(F.col("p_size") < 20, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("d ")))
        .otherwise(F.format_number("p_retailprice", 2))
    )
    return p.select("p_partkey", raw.alias("raw"))


@query("g01_parse_cell", """WITH c AS (SELECT p_partkey, CASE WHEN p_size < 5 THEN '#N/A' WHEN p_size < 10 THEN p_size || '.5%' WHEN p_size < 14 THEN p_name
  WHEN p_size < 17 THEN 'nan%' WHEN p_size < 20 THEN ' ' || p_size || 'd ' ELSE format('{:,.2f}', p_retailprice) END AS raw FROM part),
d AS (SELECT *, trim(raw) AS v FROM c)
SELECT p_partkey, CASE WHEN v IN ('#N/A','#DIV/0!','#REF!','#VALUE!','') OR v = 'nan%' THEN NULL
  WHEN v LIKE '%\\%' ESCAPE '\\' THEN round(try_cast(rtrim(v, '%') AS DOUBLE) / 100, 6) ELSE round(try_cast(replace(v, ',', '') AS DOUBLE), 6) END AS num,
  CASE WHEN regexp_matches(v, '^[a-z]|d$') AND v <> 'nan%' THEN v END AS txt FROM d""".replace("\\\\", "\\"))
def _(spark, sf):
    return cells(spark, sf).select("p_partkey", F.round(M.parse_cell("raw"), 6).alias("num"), M.parse_cell_text("raw").alias("txt"))


# ---- alerts ----
_FLAG = f"""CASE WHEN {s_in('name', I.CORE)} THEN 'CORE'
  WHEN (abs(coalesce(monthly,0)) >= 0.15 OR abs(coalesce(weekly,0)) >= 0.2) AND coalesce(monthly,0) > 0 THEN 'ALERT_UP'
  WHEN (abs(coalesce(monthly,0)) >= 0.15 OR abs(coalesce(weekly,0)) >= 0.2) THEN 'ALERT_DOWN' END"""
ALERTS = I.CHANGES + f", alerts AS (SELECT * FROM (SELECT *, {_FLAG} AS flag FROM changes) WHERE flag IS NOT NULL)"


def alerts(spark, sf):
    return M.flag_alerts(I.metric_changes(spark, sf), I.CORE)


@query("g02_alert_flags", f"WITH {ALERTS} SELECT snapshot, name, value, weekly, monthly, flag FROM alerts")
def _(spark, sf):
    return alerts(spark, sf).select("snapshot", "name", "value", "weekly", "monthly", "flag")


@query("g02_zero_is_up", f"WITH {ALERTS.replace('coalesce(monthly,0) > 0', 'coalesce(monthly,0) >= 0')} SELECT snapshot, name, flag FROM alerts")
def _(spark, sf):
    return M.flag_alerts(I.metric_changes(spark, sf), I.CORE, zero_is_up=True).select("snapshot", "name", "flag")


_HEALTH = ALERTS + """, h AS (SELECT snapshot, count(*) FILTER (flag='CORE' AND (coalesce(monthly,0) < -0.15 OR coalesce(weekly,0) < -0.2)) AS core_breached,
  count(*) FILTER (flag='ALERT_DOWN') AS other_down, count(*) FILTER (flag='CORE' AND coalesce(monthly,0) > 0) AS core_rising,
  count(*) FILTER (flag='CORE' AND coalesce(monthly,0) < 0) AS core_falling, count(*) FILTER (flag='CORE') AS core_total FROM alerts GROUP BY 1),
hs AS (SELECT *, core_total > 0 AND core_total = core_falling AS all_core_fall FROM h),
hz AS (SELECT *, greatest(0, least(100, 100 - 10*core_breached - 3*other_down - CASE WHEN all_core_fall THEN 15 ELSE 0 END + least(2*core_rising, 20))) AS score FROM hs)"""


@query("g03_health_score", f"""WITH {_HEALTH} SELECT snapshot, core_breached, other_down, core_rising, all_core_fall, score,
  CASE WHEN score >= 80 THEN '良好' WHEN score >= 60 THEN '需關注' ELSE '警示' END AS label FROM hz""")
def _(spark, sf):
    return M.health_scores(alerts(spark, sf)).select("snapshot", "core_breached", "other_down", "core_rising", "all_core_fall", "score", "label")


@query("g03_health_deductions", f"""WITH {_HEALTH}
SELECT snapshot, name AS item, 10 AS points FROM alerts WHERE flag='CORE' AND (coalesce(monthly,0) < -0.15 OR coalesce(weekly,0) < -0.2)
UNION ALL SELECT snapshot, 'non-core', 3*other_down FROM hs WHERE other_down > 0
UNION ALL SELECT snapshot, 'all-core', 15 FROM hs WHERE all_core_fall""")
def _(spark, sf):
    return M.health_deductions(alerts(spark, sf))


# ---- series ----
U = I.s_daily("user_id")


@query("g04_moving_average", f"""WITH {U} SELECT metric, ts, CASE WHEN count(*) OVER w = 4 THEN round(avg(value) OVER w, 4) END AS ma FROM series
WINDOW w AS (PARTITION BY metric ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    return T.moving_average(I.daily_series(spark, sf, "user_id")).select("metric", "ts", F.round("ma", 4).alias("ma"))


PROFILE = U + """, pts AS (SELECT *, row_number() OVER w - 1 AS x, avg(value) OVER (PARTITION BY metric ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS ma_before,
  coalesce(value < lag(value) OVER w, false) AS falls FROM series WINDOW w AS (PARTITION BY metric ORDER BY ts)),
runs AS (SELECT *, x - row_number() OVER (PARTITION BY metric, falls ORDER BY ts) AS island FROM pts),
rl AS (SELECT metric, max(c) AS longest_decline FROM (SELECT metric, island, count(*) FILTER (falls) AS c FROM runs GROUP BY metric, falls, island) GROUP BY metric),
prof AS (SELECT metric, count(*) AS n, max_by(value, x) AS latest, max_by(ma_before, x) AS ma_before, regr_slope(value, x) AS slope, avg(value) AS mean,
  CASE WHEN min(value) = max(value) THEN 0 ELSE greatest(0, regr_r2(value, x)) END AS r2 FROM pts GROUP BY metric),
p AS (SELECT *, CASE WHEN n >= 3 THEN CASE WHEN slope / abs(mean) > 0.05 THEN 'rising' WHEN slope / abs(mean) < -0.05 THEN 'falling' ELSE 'stable' END END AS direction
  FROM prof JOIN rl USING (metric))"""


def profile(spark, sf):
    return T.series_profile(I.daily_series(spark, sf, "user_id"))


@query("g05_ma_deviation", f"""WITH {PROFILE} SELECT metric, round(latest/ma_before, 6) AS ratio, CASE WHEN latest/ma_before < 0.7 THEN 'critical' ELSE 'warning' END AS severity
FROM p WHERE n >= 5 AND ma_before <> 0 AND latest/ma_before < 0.85""")
def _(spark, sf):
    return T.ma_deviation(profile(spark, sf)).select("metric", F.round("ratio", 6).alias("ratio"), "severity")


@query("g06_consecutive_decline", f"""WITH {PROFILE} SELECT metric, longest_decline, CASE WHEN longest_decline >= 5 THEN 'critical' ELSE 'warning' END AS severity
FROM p WHERE longest_decline >= 3""")
def _(spark, sf):
    return T.consecutive_decline(profile(spark, sf)).select("metric", "longest_decline", "severity")


@query("g07_linear_trend", f"WITH {PROFILE} SELECT metric, n, round(slope,5) AS slope, round(r2,6) AS r2, direction FROM p WHERE n >= 3")
def _(spark, sf):
    return profile(spark, sf).filter("n >= 3").select("metric", "n", F.round("slope", 5).alias("slope"), F.round("r2", 6).alias("r2"), "direction")


def half_series(spark, sf):
    """Running totals per user: series with a clear trend."""
    from pyspark.sql import Window

    d = I.daily_series(spark, sf, "user_id")
    w = Window.partitionBy("metric").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("metric").cast("int") < 75, 1).otherwise(-1)
    return d.select("metric", "ts", F.round(sign * F.sum("value").over(w) + F.when(sign < 0, 3000).otherwise(0), 2).alias("value"))


TREND = PROFILE.replace(U, I.s_daily("user_id").replace("series AS", "s0 AS") + """, series AS (SELECT metric, ts, round(CASE WHEN metric::INT < 75 THEN 1 ELSE -1 END
  * sum(value) OVER (PARTITION BY metric ORDER BY ts ROWS UNBOUNDED PRECEDING) + CASE WHEN metric::INT < 75 THEN 0 ELSE 3000 END, 2) AS value FROM s0)""")


@query("g08_trend_anomaly", f"""WITH {TREND} SELECT metric, direction, round(r2,6) AS r2, CASE WHEN direction='rising' THEN 'info' WHEN r2 > 0.8 THEN 'critical' ELSE 'warning' END AS severity
FROM p WHERE direction <> 'stable' AND r2 >= 0.5""")
def _(spark, sf):
    return T.trend_anomaly(T.series_profile(half_series(spark, sf))).select("metric", "direction", F.round("r2", 6).alias("r2"), "severity")


_FINDINGS = """ SELECT metric, 'ma_deviation' AS type, 0 AS pos, CASE WHEN latest/ma_before < 0.7 THEN 'critical' ELSE 'warning' END AS severity, latest/ma_before AS measure FROM p
  WHERE n >= 5 AND ma_before <> 0 AND latest/ma_before < 0.85
UNION ALL SELECT metric, 'consecutive_decline', 1, CASE WHEN longest_decline >= 5 THEN 'critical' ELSE 'warning' END, longest_decline FROM p WHERE n >= 4 AND longest_decline >= 3
UNION ALL SELECT metric, 'trend', 2, CASE WHEN direction='rising' THEN 'info' WHEN r2 > 0.8 THEN 'critical' ELSE 'warning' END, slope FROM p WHERE n >= 4 AND direction <> 'stable' AND r2 >= 0.5"""


@query("g09_all_detectors", f"WITH {TREND}, f AS ({_FINDINGS}) SELECT metric, type, pos, severity, round(measure,4) AS measure FROM f")
def _(spark, sf):
    out = T.analyze_series(half_series(spark, sf)).select("metric", "type", "pos", "severity", F.round("measure", 4).alias("measure"), "severity_rank")
    return out.orderBy("severity_rank", "metric", "pos").drop("severity_rank")


@query("g10_series_from_snapshots", f"""WITH {I.s_daily()}, keep AS (SELECT DISTINCT ts FROM series ORDER BY ts DESC LIMIT 12)
SELECT metric, ts, value FROM series WHERE ts IN (SELECT ts FROM keep) AND value >= 300 AND metric <> 'signup'""")
def _(spark, sf):
    d = I.daily_series(spark, sf)
    v = F.when(F.col("value") >= 300, F.col("value"))
    snap = d.groupBy(F.col("ts").alias("snapshot")).agg(F.map_from_entries(F.collect_list(F.struct("metric", v.alias("v")))).alias("metrics"))
    return T.series_from_snapshots(snap, 12, ["click", "error", "purchase", "view"])


# ---- segments ----
def segments(spark, sf):
    l = table(spark, sf, "lineitem")
    y = F.year("l_shipdate")
    s = l.groupBy(F.col("l_returnflag").alias("site"), F.concat(F.lit("/s"), "l_suppkey", F.lit("/")).alias("segment")).agg(
        F.sum(F.when(y == 1998, F.col("l_quantity"))).alias("before"), F.sum(F.when(y == 1999, F.col("l_quantity"))).alias("after"))
    return M.segment_severity(s.select("site", "segment", F.round(F.col("after") / F.col("before") - 1, 6).alias("change")))


SEG = """seg0 AS (SELECT l_returnflag AS site, '/s' || l_suppkey || '/' AS segment, round(sum(l_quantity) FILTER (year(l_shipdate) = 1999) / sum(l_quantity) FILTER (year(l_shipdate) = 1998) - 1, 6) AS change
  FROM lineitem GROUP BY 1, 2), seg AS (SELECT *, CASE WHEN change >= 0.5 THEN 'critical' WHEN change >= 0.15 THEN 'warning' WHEN change <= -0.1 THEN 'improving' ELSE 'stable' END AS severity FROM seg0)"""


@query("g11_segment_severity", f"WITH {SEG} SELECT site, segment, change, severity FROM seg")
def _(spark, sf):
    return segments(spark, sf)


@query("g11_overall_severity", f"""WITH {SEG} SELECT site, count(*) FILTER (severity='critical') AS n_critical, count(*) FILTER (severity='warning') AS n_warning, count(*) FILTER (severity='improving') AS n_improving,
 count(*) AS n_segments, CASE WHEN bool_or(severity='critical') THEN 'critical' WHEN bool_or(severity='warning') THEN 'warning' WHEN 2*count(*) FILTER (severity='improving') > count(*) THEN 'improving' ELSE 'stable' END AS overall FROM seg GROUP BY site""")
def _(spark, sf):
    return M.overall_severity(segments(spark, sf), "site")


def page_segments(spark, sf):
    p = table(spark, sf, "pages")
    seg = F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://[^/]+/([^/]+)/", 1), F.lit("/"))
    site = F.regexp_extract("url", r"example\.([a-z]+)", 1)
    g = p.groupBy(site.alias("site"), seg.alias("segment")).agg(F.avg(F.length("html")).alias("a"))
    from pyspark.sql import Window

    mean = F.avg("a").over(Window.partitionBy("site"))
    return M.segment_severity(g.select("site", "segment", F.round(F.col("a") / mean - 1, 6).alias("change")))


_ADVICE = " ".join(f"WHEN contains(segment, {lit(k)}) THEN {lit(v)}" for k, v in rules.SEGMENT_ADVICE)


@query("g12_segment_advice", rf"""WITH g AS (SELECT regexp_extract(url, 'example\.([a-z]+)', 1) AS site, '/' || regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1) || '/' AS segment, avg(length(html)) AS a FROM pages GROUP BY 1, 2),
c AS (SELECT site, segment, round(a / avg(a) OVER (PARTITION BY site) - 1, 6) AS change FROM g),
s AS (SELECT *, CASE WHEN change >= 0.5 THEN 'critical' WHEN change >= 0.15 THEN 'warning' WHEN change <= -0.1 THEN 'improving' ELSE 'stable' END AS severity FROM c)
SELECT site, segment, severity, CASE {_ADVICE} WHEN severity = 'critical' THEN {lit(rules.SEGMENT_ADVICE_CRITICAL)} WHEN severity = 'improving' THEN {lit(rules.SEGMENT_ADVICE_IMPROVING)} ELSE {lit(rules.SEGMENT_ADVICE_DEFAULT)} END AS advice FROM s""")
def _(spark, sf):
    return M.segment_advice(page_segments(spark, sf)).select("site", "segment", "severity", "advice")


# ---- maturity trend, as-of, drift over monthly order levels ----
def monthly_levels(spark, sf):
    o = table(spark, sf, "orders")
    lev = lambda s: F.coalesce(F.least(F.lit(4), F.floor(F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))) / 75000)), F.lit(1))
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.date_format("o_orderdate", "yyyy-MM").alias("report_date")).agg(
        lev("F").alias("strategy"), lev("O").alias("process"), lev("P").alias("keywords"))


def _s_lev(s):
    return f"coalesce(least(4, floor(avg(o_totalprice) FILTER (o_orderstatus='{s}') / 75000)), 1)::BIGINT"


LEVELS = f"lv AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m') AS report_date, {_s_lev('F')} AS strategy, {_s_lev('O')} AS process, {_s_lev('P')} AS keywords FROM orders GROUP BY 1, 2)"


@query("g13_maturity_trend", f"""WITH {LEVELS}, u AS (SELECT series || '/' || dim AS dimension, report_date, level FROM (UNPIVOT lv ON strategy, process, keywords INTO NAME dim VALUE level))
SELECT dimension, min_by(level, report_date) AS first_level, max_by(level, report_date) AS last_level,
CASE WHEN max_by(level, report_date) > min_by(level, report_date) THEN 'improved' WHEN max_by(level, report_date) < min_by(level, report_date) THEN 'regressed' ELSE 'stagnant' END AS trend FROM u GROUP BY 1""")
def _(spark, sf):
    long = monthly_levels(spark, sf).unpivot(["series", "report_date"], ["strategy", "process", "keywords"], "dim", "level")
    return T.first_last_trend(long.withColumn("dimension", F.concat_ws("/", "series", "dim")))


@query("g14_prior_report", """SELECT a.o_orderkey AS report_id, max(b.o_orderdate)::DATE::VARCHAR AS prior_date, max_by(b.o_orderkey, (b.o_orderdate, b.o_orderkey)) AS prior_id FROM orders a LEFT JOIN orders b
ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("report_id"), "o_custkey", F.col("o_orderdate").cast("date").alias("report_date"))
    return T.prior_report(o, "o_custkey").select("report_id", F.col("prior_date").cast("string").alias("prior_date"), "prior_id")


@query("g15_score_drift", f"""WITH {LEVELS}, d AS (SELECT series, report_date, abs(strategy - lag(strategy) OVER w) AS a, abs(process - lag(process) OVER w) AS b, abs(keywords - lag(keywords) OVER w) AS c FROM lv
 WINDOW w AS (PARTITION BY series ORDER BY report_date))
SELECT series, report_date, round(least(1.0::DOUBLE, (a+b+c)/4.0::DOUBLE), 6) AS drift, round(CASE WHEN a IS NULL THEN NULL ELSE ((CASE WHEN a<=1 THEN 1 WHEN a<=2 THEN 0.5 ELSE 0 END)+(CASE WHEN b<=1 THEN 1 WHEN b<=2 THEN 0.5 ELSE 0 END)+(CASE WHEN c<=1 THEN 1 WHEN c<=2 THEN 0.5 ELSE 0 END))::DOUBLE/3 END, 6) AS consistency FROM d""".replace("least(1.0::DOUBLE, (a+b+c)/4.0::DOUBLE)", "CASE WHEN a IS NULL THEN NULL ELSE least(1.0::DOUBLE, (a+b+c)/4.0::DOUBLE) END"))
def _(spark, sf):
    d = T.score_drift(monthly_levels(spark, sf), "series", "report_date", ["strategy", "process", "keywords"])
    return d.select("series", "report_date", F.round("drift", 6).alias("drift"), F.round("consistency", 6).alias("consistency"))


# fixed values of this catalogue's own metric names
DIMENSIONS = [("click", "keywords"), ("view", "keywords"), ("purchase", "metrics"), ("error", "process")]


@query("g16_metric_dimension", f"""WITH {I.CHANGES}, n AS (SELECT snapshot, name || CASE WHEN value > 800 THEN ' (total)' ELSE '' END AS name, value FROM changes),
d AS (SELECT *, CASE WHEN contains(name,'click') THEN 'keywords' WHEN contains(name,'view') THEN 'keywords' WHEN contains(name,'purchase') THEN 'metrics' WHEN contains(name,'error') THEN 'process' END AS dimension FROM n)
SELECT snapshot, name, dimension, CASE WHEN dimension IS NOT NULL AND value < 1200 THEN '**[' || dimension || ' L' || (floor(value/300)::INT) || '→L' || (floor(value/300)::INT + 1) || ']**' END AS upgrade FROM d""")
def _(spark, sf):
    c = I.metric_changes(spark, sf).select("snapshot", F.concat("name", F.when(F.col("value") > 800, " (total)").otherwise("")).alias("name"), "value")
    d = M.metric_dimension(c, DIMENSIONS)
    level = F.concat(F.lit("L"), F.floor(F.col("value") / 300).cast("string"))
    return d.select("snapshot", "name", "dimension", M.upgrade_label(F.col("dimension"), level).alias("upgrade"))


_CALL = {"策略": "CASE WHEN value > 300 THEN 'L' || (floor(value / 300)::INT) END", "流程": "CASE WHEN name = 'click' THEN 'l2' WHEN name = 'view' THEN 'L2.5' END"}


@query("g16_maturity_callout", f"""WITH {I.CHANGES}, c AS (SELECT snapshot, name, list_filter([{', '.join(f"CASE WHEN regexp_matches({v}, '^[Ll][0-9]+$') THEN '{k} ' || {v} END" for k, v in _CALL.items())}], lambda x: x IS NOT NULL) AS p FROM changes)
SELECT snapshot, name, CASE WHEN len(p) > 0 THEN '> 成熟度參考：' || array_to_string(p, ' / ') END AS callout FROM c""")
def _(spark, sf):
    levels = [(k, F.expr(v.replace("(floor(value / 300)::INT)", "cast(floor(value / 300) as int)"))) for k, v in _CALL.items()]
    return I.metric_changes(spark, sf).select("snapshot", "name", M.maturity_callout(levels).alias("callout"))


@query("g17_usage_rollup", r"""SELECT event_type AS endpoint, regexp_extract(props, '"k": (\d)', 1) AS model, count(*) AS calls, sum(user_id)::BIGINT AS tokens, round(avg(value), 4) AS avg_latency
FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("endpoint"), F.regexp_extract("props", r'"k": (\d)', 1).alias("model"), F.col("user_id").alias("tokens"), F.col("value").alias("latency"), "ts")
    return M.usage_rollup(e, "2024-01-30", 14).withColumn("avg_latency", F.round("avg_latency", 4))


@query("g19_topic_frequency", f"""WITH {I.KB_DATED}, recent AS (SELECT source_file FROM kb_dated GROUP BY 1 ORDER BY max(source_date) DESC, source_file LIMIT 50)
SELECT keyword, count(*) AS n FROM (SELECT unnest(list_transform(keywords, lambda x: lower(x))) AS keyword FROM kb_dated WHERE source_file IN (SELECT source_file FROM recent)) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 20""")
def _(spark, sf):
    k = I.kb_dated(spark, sf).select(F.col("source_file").alias("source"), "source_date", "keywords")
    return M.topic_frequency(k, 50, 20)


@query("g19_source_topics", f"""WITH {I.KB}, e AS (SELECT source_collection AS source, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) AS pos FROM kb),
c AS (SELECT source, keyword, count(*) AS n, min(pos) AS pos FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, pos, keyword) AS rank FROM c),
t AS (SELECT source, string_agg(keyword, '|' ORDER BY rank) AS k FROM r WHERE rank <= 5 GROUP BY 1)
SELECT source, n AS keyword_count, coalesce(k, '') AS top_keywords FROM (SELECT source_collection AS source, sum(len(keywords))::BIGINT AS n FROM kb GROUP BY 1) LEFT JOIN t USING (source)""")
def _(spark, sf):
    k = I.kb(spark, sf).select(F.col("source_collection").alias("source"), "keywords")
    return M.source_topics(k).withColumn("top_keywords", F.array_join("top_keywords", "|"))


@query("g20_traffic_quadrant", f"""WITH {I.CHANGES}, w AS (SELECT snapshot, coalesce(max(monthly) FILTER (name='view'),0) AS imp, coalesce(max(monthly) FILTER (name='click'),0) AS click, coalesce(max(monthly) FILTER (name='purchase'),0) AS ctr FROM changes GROUP BY 1)
SELECT *, CASE WHEN imp >= 0 AND ctr < -0.05 THEN 'high-low' WHEN imp < -0.1 AND ctr >= 0 THEN 'low-high' WHEN imp < -0.05 AND click < -0.05 THEN 'double-low' ELSE 'neutral' END AS quadrant FROM w""")
def _(spark, sf):
    c = I.metric_changes(spark, sf)
    name = F.when(F.col("name") == "view", "impressions").when(F.col("name") == "click", "clicks").when(F.col("name") == "purchase", "ctr").otherwise(F.col("name"))
    return M.traffic_quadrant(c.withColumn("name", name))


@query("g21_ranked_alerts", f"""WITH {ALERTS}, r AS (SELECT *, row_number() OVER (PARTITION BY snapshot, flag ORDER BY CASE WHEN flag='ALERT_UP' THEN -monthly ELSE monthly END NULLS LAST, name) AS rank FROM alerts)
SELECT snapshot, flag, name, monthly, rank FROM r WHERE rank <= 2""")
def _(spark, sf):
    return M.ranked_alerts(alerts(spark, sf), n=2).select("snapshot", "flag", "name", "monthly", "rank")


@query("g22_step_rollup", """SELECT event_type AS step, sum(user_id)::BIGINT AS tokens, sum(CASE WHEN value > 10 THEN user_id ELSE 0 END)::BIGINT AS saved, count(*) AS runs FROM events GROUP BY ROLLUP (event_type)""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("step"), F.col("user_id").alias("tokens"), F.when(F.col("value") > 10, F.col("user_id")).otherwise(0).alias("saved"))
    return M.step_rollup(e)


ACTIONS = [("click", "check titles"), ("view", "check coverage"), ("err", "check logs")]


@query("g23_metric_action", f"""WITH {ALERTS} SELECT snapshot, name, flag, CASE WHEN contains(name,'click') THEN 'check titles' WHEN contains(name,'view') THEN 'check coverage' WHEN contains(name,'err') THEN 'check logs' ELSE 'review trend' END AS action FROM alerts""")
def _(spark, sf):
    return alerts(spark, sf).select("snapshot", "name", "flag", M.first_match("name", ACTIONS, F.lit("review trend")).alias("action"))
