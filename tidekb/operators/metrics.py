"""Metric rows: cell parsing, alert flags, health score, quadrant signals, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidekb import rules
from tidekb.functions.ranking import top_per_group
from tidekb.functions.text import col

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def parse_cell(raw: Column | str) -> Column:
    """Sheet cell to DOUBLE: error marks are null, ``%`` divides by 100, thousands commas are dropped, text is null."""
    v = F.trim(col(raw))
    pct = F.regexp_replace(v, "%+$", "")
    plain = F.regexp_replace(v, ",", "")
    return (
        F.when(v.isin(*rules.CELL_ERRORS), None)
        .when(v.endswith("%"), F.when(pct.rlike(NUMBER), pct.try_cast("double") / 100))
        .when(plain.rlike(NUMBER), plain.try_cast("double"))
    )


def parse_cell_text(raw: Column | str) -> Column:
    """What a cell holds if it is text rather than a number (null otherwise)."""
    v = F.trim(col(raw))
    is_text = ~v.isin(*rules.CELL_ERRORS) & ~v.endswith("%") & parse_cell(raw).isNull()
    return F.when(is_text, v)


def flag_alerts(df: DataFrame, core: list[str] | None = None, zero_is_up: bool = False,
                monthly: float = rules.ALERT_MONTHLY, weekly: float = rules.ALERT_WEEKLY) -> DataFrame:
    """Keep rows that need attention and add ``flag``: CORE always, else ALERT_UP / ALERT_DOWN past a threshold."""
    m, w = F.coalesce("monthly", F.lit(0.0)), F.coalesce("weekly", F.lit(0.0))
    up = (m >= 0) if zero_is_up else (m > 0)
    moved = (F.abs(m) >= monthly) | (F.abs(w) >= weekly)
    flag = (
        F.when(F.col("name").isin(*(rules.CORE_METRICS if core is None else core)), "CORE")
        .when(moved & up, "ALERT_UP")
        .when(moved, "ALERT_DOWN")
    )
    return df.withColumn("flag", flag).filter(F.col("flag").isNotNull())


def health_scores(alerts: DataFrame, by: str = "snapshot") -> DataFrame:
    """One score per snapshot from its flagged rows."""
    m, w = F.coalesce("monthly", F.lit(0.0)), F.coalesce("weekly", F.lit(0.0))
    core, down = F.col("flag") == "CORE", F.col("flag") == "ALERT_DOWN"
    agg = alerts.groupBy(by).agg(
        F.count_if(core & ((m < -rules.ALERT_MONTHLY) | (w < -rules.ALERT_WEEKLY))).alias("core_breached"),
        F.count_if(down).alias("other_down"),
        F.count_if(core & (m > 0)).alias("core_rising"),
        F.count_if(core & (m < 0)).alias("core_falling"),
        F.count_if(core).alias("core_total"),
    )
    all_fall = (F.col("core_total") > 0) & (F.col("core_falling") == F.col("core_total"))
    good, watch, bad = rules.HEALTH_LABELS
    raw = (
        100 - 10 * F.col("core_breached") - 3 * F.col("other_down") - F.when(all_fall, 15).otherwise(0)
        + F.least(2 * F.col("core_rising"), F.lit(20))
    )
    return (
        agg.withColumn("all_core_fall", all_fall)
        .withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), raw)))
        .withColumn("label", F.when(F.col("score") >= 80, good).when(F.col("score") >= 60, watch).otherwise(bad))
    )


def health_deductions(alerts: DataFrame, by: str = "snapshot") -> DataFrame:
    """Itemised deductions ``(snapshot, item, points)``: breached core rows, the other falls, all-core fall."""
    m, w = F.coalesce("monthly", F.lit(0.0)), F.coalesce("weekly", F.lit(0.0))
    breached = alerts.filter((F.col("flag") == "CORE") & ((m < -rules.ALERT_MONTHLY) | (w < -rules.ALERT_WEEKLY)))
    rows = breached.select(by, F.col("name").alias("item"), F.lit(10).cast("long").alias("points"))
    s = health_scores(alerts, by)
    other = s.filter("other_down > 0").select(by, F.lit("non-core").alias("item"),
                                              (3 * F.col("other_down")).alias("points"))
    fall = s.filter("all_core_fall").select(by, F.lit("all-core").alias("item"), F.lit(15).cast("long").alias("points"))
    return rows.unionByName(other).unionByName(fall)


def segment_severity(df: DataFrame, change: str = "change") -> DataFrame:
    c = F.col(change)
    sev = (
        F.when(c >= 0.5, "critical").when(c >= 0.15, "warning").when(c <= -0.1, "improving").otherwise("stable")
    )
    return df.withColumn("severity", sev)


def overall_severity(segments: DataFrame, by: str) -> DataFrame:
    """Worst severity per group, or improving if more than half of the segments improve."""
    s = F.col("severity")
    agg = segments.groupBy(by).agg(
        F.count_if(s == "critical").alias("n_critical"), F.count_if(s == "warning").alias("n_warning"),
        F.count_if(s == "improving").alias("n_improving"), F.count("*").alias("n_segments"),
    )
    overall = (
        F.when(F.col("n_critical") > 0, "critical").when(F.col("n_warning") > 0, "warning")
        .when(F.col("n_improving") * 2 > F.col("n_segments"), "improving").otherwise("stable")
    )
    return agg.withColumn("overall", overall)


def first_match(text: Column | str, table: list[tuple[str, str]], default: Column | None = None) -> Column:
    """Value of the first (pattern, value) whose pattern is contained in the text."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pat, val in table:
        out = out.when(F.contains(col(text), F.lit(pat)), F.lit(val))
    return out if default is None else out.otherwise(default)


def segment_advice(df: DataFrame, advice: list[tuple[str, str]] | None = None) -> DataFrame:
    by_sev = (
        F.when(F.col("severity") == "critical", rules.SEGMENT_ADVICE_CRITICAL)
        .when(F.col("severity") == "improving", rules.SEGMENT_ADVICE_IMPROVING)
        .otherwise(rules.SEGMENT_ADVICE_DEFAULT)
    )
    return df.withColumn("advice", first_match("segment", advice or rules.SEGMENT_ADVICE, by_sev))


def metric_dimension(df: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    """Metric to dimension: exact key first, else the first key contained in the name."""
    exact = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, dim in table:
        exact = exact.when(F.col("name") == key, dim)
    return df.withColumn("dimension", F.coalesce(exact, first_match("name", table)))


def upgrade_label(dimension: Column, level: Column) -> Column:
    """``**[dimension L2→L3]**``; null for a missing or malformed level and at the top level."""
    n = F.regexp_extract(level, "^[Ll]([0-9]+)$", 1).try_cast("int")
    text = F.concat(F.lit("**["), dimension, F.lit(" "), level, F.lit("→L"), (n + 1).cast("string"), F.lit("]**"))
    return F.when(n < 4, text)


def maturity_callout(levels: list[tuple[str, Column]]) -> Column:
    """One line naming every dimension with a valid level; null if there is none."""
    parts = F.array_compact(F.array(*[F.when(c.rlike("^[Ll][0-9]+$"), F.concat(F.lit(f"{lab} "), c)) for lab, c in levels]))
    return F.when(F.size(parts) > 0, F.concat(F.lit("> 成熟度參考："), F.array_join(parts, " / ")))


def traffic_quadrant(df: DataFrame, by: str = "snapshot") -> DataFrame:
    """Impression / click-rate quadrant per snapshot from long rows ``(snapshot, name, monthly)``."""
    pick = lambda n: F.coalesce(F.max(F.when(F.col("name") == n, F.col("monthly"))), F.lit(0.0))
    wide = df.groupBy(by).agg(pick("impressions").alias("imp"), pick("clicks").alias("click"), pick("ctr").alias("ctr"))
    imp, click, ctr = F.col("imp"), F.col("click"), F.col("ctr")
    quadrant = (
        F.when((imp >= 0) & (ctr < -0.05), "high-low").when((imp < -0.1) & (ctr >= 0), "low-high")
        .when((imp < -0.05) & (click < -0.05), "double-low").otherwise("neutral")
    )
    return wide.withColumn("quadrant", quadrant)


def ranked_alerts(alerts: DataFrame, by: str = "snapshot", n: int = 5) -> DataFrame:
    """Core rows, falls by monthly ascending and rises descending, ``n`` of each per snapshot."""
    key = F.when(F.col("flag") == "ALERT_UP", -F.col("monthly")).otherwise(F.col("monthly"))
    return top_per_group(alerts, [by, "flag"], [key.asc_nulls_last(), F.col("name").asc()], n)


def usage_rollup(df: DataFrame, ref_date: str, days: int) -> DataFrame:
    """Calls, tokens and mean latency per endpoint and model over the last ``days`` days."""
    recent = df.filter(F.col("ts") >= F.date_sub(F.lit(ref_date).cast("date"), days).cast("timestamp"))
    return recent.groupBy("endpoint", "model").agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.avg("latency").alias("avg_latency"))


def step_rollup(df: DataFrame) -> DataFrame:
    """Token usage and savings per step, with the total as the null step."""
    return df.rollup("step").agg(F.sum("tokens").alias("tokens"), F.sum("saved").alias("saved"), F.count("*").alias("runs"))


def topic_frequency(df: DataFrame, n_recent: int, top: int) -> DataFrame:
    """Keyword counts over the ``n_recent`` newest sources ``(source, source_date, keywords)``."""
    newest = (
        df.groupBy("source").agg(F.max("source_date").alias("d"))
        .orderBy(F.desc("d"), F.asc("source")).limit(n_recent).select("source")
    )
    counts = (
        df.join(newest, "source", "left_semi").select(F.explode(F.transform("keywords", lambda k: F.lower(k))).alias("keyword"))
        .groupBy("keyword").agg(F.count("*").alias("n"))
    )
    return counts.orderBy(F.desc("n"), F.asc("keyword")).limit(top)


def source_topics(df: DataFrame, top: int = 5) -> DataFrame:
    """``(source, keyword_count, top_keywords)``: keywords per source and its ``top`` most frequent ones, ties by first place."""
    each = df.select("source", F.posexplode("keywords").alias("pos", "keyword"))
    counted = each.groupBy("source", "keyword").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    best = top_per_group(counted, "source", [F.desc("n"), F.asc("pos"), F.asc("keyword")], top)
    packed = best.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("k")).select("source", F.col("k.keyword").alias("top_keywords"))
    sizes = df.groupBy("source").agg(F.sum(F.size("keywords")).alias("keyword_count"))
    return sizes.join(packed, "source", "left").withColumn("top_keywords", F.coalesce("top_keywords", F.array().cast("array<string>")))


def previous_by_step(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(f"prev_{value}", F.lag(value).over(w))
