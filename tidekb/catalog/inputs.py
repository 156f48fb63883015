"""Driver tables shaped as the operators' inputs, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekb import rules
from tidekb.catalog.base import lit, s_any, s_count, table
from tidekb.functions.layout import spread
from tidekb.operators import enrich

REF_DATE = "2002-01-01"


#: Keywords of a stand-in row: all words of its whole text.
KEYWORD = r"[\p{L}]{3,}"


def keyword_set(text: str):
    """A stand-in row's keywords, lower-cased, in the order of the text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(0)))


def kb(spark, sf) -> DataFrame:
    return _kb(spread(table(spark, sf, "documents"), "doc_id"))


def _kb(d: DataFrame, *more: str) -> DataFrame:
    q = F.substring_index("text", ".", 1)
    toks = keyword_set("text")
    ranked = F.sort_array(F.transform(toks, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return d.select(
        F.col("doc_id").alias("seq"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"),
        F.col("source").alias("source_collection"), "lang", q.alias("question"), F.col("text").alias("answer"),
        F.transform(ranked, lambda s: s["t"]).alias("keywords"), *more)


KB = r"""kb AS (SELECT doc_id AS seq, source || '/' || doc_id || '.md' AS source_file, source AS source_collection, lang,
  split_part(text, '.', 1) AS question, text AS answer,
  list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[\p{L}]{3,}')),
    lambda t: {'n': -length(t), 't': t})), lambda s: s.t) AS keywords FROM documents)"""


def kb_dated(spark, sf, *sides: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The rows with their date, and the columns of ``sides``, narrow tables by ``seq``; if ``only`` is given, those with its ``seq``.

    All meet the documents while these are ids and texts: each document is shuffled once, before anything is derived from it,
    and narrow sides are hashed, so that documents aren't sorted.
    """
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("source_date"))
    d, more = table(spark, sf, "documents"), []
    if only is not None:
        d = d.join(only.withColumnRenamed("seq", "doc_id"), "doc_id", "left_semi")
    for side in (o, *[s.withColumnRenamed("seq", "doc_id") for s in sides]):
        d = d.join(side.hint("shuffle_hash"), "doc_id", "left")
        more += [c for c in side.columns if c != "doc_id"]
    return _kb(d, *more)


KB_DATED = KB + """, kb_dated AS (SELECT kb.*, strftime(o_orderdate, '%Y-%m-%d') AS source_date FROM kb LEFT JOIN orders ON o_orderkey = seq)"""


def kb_classified(spark, sf, *sides: DataFrame) -> DataFrame:
    return enrich.classify(kb_dated(spark, sf, *sides))


def sql_classified(src: str) -> str:
    scores = ", ".join(f"{s_count('t', ms)} AS s{i}" for i, ms in enumerate(rules.CATEGORY_MARKERS.values()))
    n = len(rules.CATEGORY_MARKERS)
    best = "greatest(" + ", ".join(f"s{i}" for i in range(n)) + ")"
    whens = " ".join(f"WHEN s{i} = {best} THEN {lit(c)}" for i, c in enumerate(rules.CATEGORY_MARKERS))
    return f"""_c0 AS (SELECT *, lower(question || chr(10) || answer) AS t FROM {src}), _c1 AS (SELECT *, {scores} FROM _c0),
kbc AS (SELECT * EXCLUDE (t, {', '.join(f's{i}' for i in range(n))}),
  CASE WHEN {best} = 0 THEN {lit(rules.CATEGORY_OTHER)} {whens} END AS category,
  CASE WHEN length(answer) >= {rules.ADVANCED_MIN_CHARS} OR {s_any('t', rules.ADVANCED_MARKERS)} THEN {lit(rules.DIFFICULTY_ADVANCED)} ELSE {lit(rules.DIFFICULTY_BASIC)} END AS difficulty,
  NOT regexp_matches(t, {lit(rules.YEAR_PATTERN)}) AND NOT {s_any('t', rules.TIME_SENSITIVE_MARKERS)} AS evergreen FROM _c1)"""


KBC = KB_DATED + ", " + sql_classified("kb_dated")


def base_synonyms(spark, sf) -> DataFrame:
    """Term → related words: the first word of each passage against all other words of the passage."""
    b = table(spark, sf, "benchmark")
    toks = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{2,}"), F.lit(0))
    one = b.select(F.get(toks, F.lit(0)).alias("term"), F.explode(toks).alias("syn")).filter("term <> syn")
    return one.groupBy("term").agg(F.array_sort(F.collect_set("syn")).alias("synonyms"))


SYN = r"""_bt AS (SELECT regexp_extract_all(lower(text), '[\p{L}]{2,}') AS toks FROM benchmark),
_bs AS (SELECT toks[1] AS term, unnest(toks) AS syn FROM _bt),
syn AS (SELECT term, list_sort(list(DISTINCT syn)) AS synonyms FROM _bs WHERE term <> syn GROUP BY term)"""


def access_log(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long")
    return e.select("event_id", "ts", F.col("event_type").alias("event"), F.col("user_id").alias("client"), F.array(k).alias("returned_ids"),
                    F.when(F.col("value") >= 5, F.col("value")).alias("top_score"))


LOG = r"""log AS (SELECT event_id, ts, event_type AS event, user_id AS client, regexp_extract(props, '"k": (\d+)', 1)::BIGINT AS rid,
  CASE WHEN value >= 5 THEN value END AS top_score FROM events)"""


def daily_series(spark, sf, key: str = "event_type") -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col(key).cast("string").alias("metric"), F.date_format("ts", "yyyy-MM-dd").alias("ts")).agg(F.round(F.sum("value"), 2).alias("value"))


def s_daily(key: str = "event_type") -> str:
    return f"series AS (SELECT {key}::VARCHAR AS metric, strftime(ts, '%Y-%m-%d') AS ts, round(sum(value), 2) AS value FROM events GROUP BY 1, 2)"


def metric_changes(spark, sf) -> DataFrame:
    """Daily metric rows with one-step and four-step relative change, as sheets of weekly and monthly trends."""
    from pyspark.sql import Window

    d = daily_series(spark, sf).select(F.col("ts").alias("snapshot"), F.col("metric").alias("name"), "value")
    w = Window.partitionBy("name").orderBy("snapshot")
    return d.withColumn("weekly", F.round(F.col("value") / F.lag("value", 1).over(w) - 1, 6)).withColumn(
        "monthly", F.round(F.col("value") / F.lag("value", 4).over(w) - 1, 6))


CHANGES = s_daily() + """, changes AS (SELECT ts AS snapshot, metric AS name, value, round(value / lag(value, 1) OVER w - 1, 6) AS weekly,
  round(value / lag(value, 4) OVER w - 1, 6) AS monthly FROM series WINDOW w AS (PARTITION BY metric ORDER BY ts))"""
CORE = ["click", "view"]


def queries(spark, sf) -> DataFrame:
    """Query batch: every benchmark passage with the vector and label stored under its id."""
    b, e = table(spark, sf, "benchmark"), table(spark, sf, "embeddings")
    return b.join(e, b["item_id"] == e["vec_id"], "left").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("query_vector"),
        F.array(F.col("label").cast("string")).alias("expected_categories"))


QUERIES_SQL = """queries AS (SELECT item_id AS query_id, text AS query, embedding AS query_vector, [label::VARCHAR] AS expected_categories
  FROM benchmark LEFT JOIN embeddings ON item_id = vec_id)"""


def markdown_docs(spark, sf) -> DataFrame:
    """Documents as Markdown files: title, header list, rule, and one paragraph per line of the text."""
    k = kb_dated(spark, sf)
    head = F.concat(F.lit("# "), "question", F.lit("\n\n- **發佈日期**: "), F.coalesce("source_date", F.lit("")), F.lit("\n- **來源 URL**: https://docs.example.org/"),
                    F.col("seq").cast("string"), F.lit("\n- **來源類型**: article\n- **來源集合**: "), "source_collection", F.lit("\n\n---\n"))
    return k.select("seq", "source_file", "source_collection", F.col("question").alias("title"), "source_date", "lang", F.col("answer").alias("raw"),
                    F.concat(head, F.replace("answer", F.lit("\n"), F.lit("\n\n"))).alias("text"))


MD = KB_DATED + """, md AS (SELECT seq, source_file, source_collection, question AS title, source_date, lang, answer AS raw, '# ' || question || chr(10) || chr(10) || '- **發佈日期**: ' || coalesce(source_date, '')
 || chr(10) || '- **來源 URL**: https://docs.example.org/' || seq || chr(10) || '- **來源類型**: article' || chr(10) || '- **來源集合**: ' || source_collection || chr(10) || chr(10) || '---' || chr(10)
 || replace(answer, chr(10), chr(10) || chr(10)) AS text FROM kb_dated)"""
