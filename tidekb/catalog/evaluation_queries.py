"""Evaluation as aggregation: per-user top events as results, customers as golden cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidekb.catalog import inputs as I
from tidekb.catalog.base import lit, query, table
from tidekb.functions.ranking import top_per_group
from tidekb.operators import enrich as E
from tidekb.operators import evaluation as V


def results(spark, sf, order="value"):
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", r'"k": (\d)', 1)
    r = top_per_group(e, "user_id", [F.desc(order), F.asc("event_id")], 5)
    tier = F.when(k.isin("1", "2"), "booster").when(k == "3", "supporting").otherwise("canonical")
    return r.select(F.col("user_id").alias("query_id"), "rank", F.col("event_id").alias("id"), F.array("event_type", F.concat(F.lit("d"), k)).alias("categories"), F.array("event_type", F.concat(F.lit("key"), k)).alias("keywords"),
                    F.array(F.concat(F.lit("i"), k)).alias("intent_labels"), tier.alias("serving_tier"), F.concat("event_type", F.lit(" "), k).alias("question"), F.col("props").alias("answer"))


def golden(spark, sf):
    c = table(spark, sf, "customer")
    s = F.col("c_mktsegment")
    exp = F.when(s == "BUILDING", F.array(F.lit("click"), F.lit("d3"))).when(s == "MACHINERY", F.array(F.lit("view"))).when(s == "HOUSEHOLD", F.array(F.lit("purchase"), F.lit("error"))).when(s == "AUTOMOBILE", F.array(F.lit("d4"))).otherwise(F.array().cast("array<string>"))
    return c.select(F.col("c_custkey").alias("query_id"), exp.alias("expected_categories"), F.array(F.lit("Click"), F.lit("key4"), F.lit('"k": 7')).alias("expected_keywords"),
                    F.array(F.lit("i1"), F.lit("i2")).alias("expected_intents"), (F.col("c_nationkey") < 8).alias("booster_sensitive"))


BASE = r"""r0 AS (SELECT *, regexp_extract(props, '"k": (\d)', 1) AS k, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
res AS (SELECT user_id AS query_id, rank, event_id AS id, [event_type, 'd' || k] AS categories, [event_type, 'key' || k] AS keywords, 'i' || k AS intent, CASE WHEN k IN ('1','2') THEN 'booster' WHEN k = '3' THEN 'supporting' ELSE 'canonical' END AS tier, event_type || ' ' || k AS question, props AS answer FROM r0 WHERE rank <= 5),
gold AS (SELECT c_custkey AS query_id, CASE c_mktsegment WHEN 'BUILDING' THEN ['click','d3'] WHEN 'MACHINERY' THEN ['view'] WHEN 'HOUSEHOLD' THEN ['purchase','error'] WHEN 'AUTOMOBILE' THEN ['d4'] ELSE []::VARCHAR[] END AS exp, c_nationkey < 8 AS bs FROM customer),
j AS (SELECT g.query_id, exp, bs, r.* EXCLUDE (query_id), len(list_intersect(categories, exp)) > 0 AS rel FROM gold g LEFT JOIN res r USING (query_id)),
nd AS (SELECT query_id, sum(1 / log2(fr + 1)) AS dcg FROM (SELECT DISTINCT query_id, fr FROM (SELECT query_id, c, min(rank) AS fr FROM (SELECT query_id, rank, unnest(list_intersect(categories, exp)) AS c FROM j) GROUP BY 1, 2)) GROUP BY 1),
ag AS (SELECT query_id, any_value(exp) AS exp, any_value(bs) AS booster_sensitive, count(rank) AS n, count(*) FILTER (rel) AS relevant, min(rank) FILTER (rel) AS fr, count(*) FILTER (tier <> 'booster') AS n_plain, count(*) FILTER (tier <> 'booster' AND rel) AS rel_plain, count(*) FILTER (tier = 'booster') AS n_booster,
 coalesce(bool_or(rel) FILTER (rank = 1), false) AS t1, coalesce(bool_or(tier = 'booster') FILTER (rank = 1), false) AS t1b, coalesce(bool_or(tier = 'canonical') FILTER (rank = 1), false) AS t1c, count(DISTINCT question) AS n_sig,
 coalesce(bool_or(contains(lower(question || ' ' || answer || ' ' || array_to_string(keywords, ' ')), 'click')), false)::INT + coalesce(bool_or(list_contains(keywords, 'key4')), false)::INT + coalesce(bool_or(contains(answer, '"k": 7')), false)::INT AS kwh,
 coalesce(bool_or(list_contains(keywords, 'click')), false)::INT + coalesce(bool_or(list_contains(keywords, 'key4')), false)::INT AS kwf, coalesce(bool_or(intent = 'i1'), false)::INT + coalesce(bool_or(intent = 'i2'), false)::INT AS ih FROM j GROUP BY 1),
cov AS (SELECT query_id, count(DISTINCT c) AS cov FROM (SELECT query_id, unnest(list_intersect(categories, exp)) AS c FROM j) GROUP BY 1),
m0 AS (SELECT ag.*, len(exp) AS n_expected, coalesce(cov, 0) AS cov, coalesce(dcg, 0) AS dcg FROM ag LEFT JOIN cov USING (query_id) LEFT JOIN nd USING (query_id))"""


def metrics_sql(cli: bool) -> str:
    prec = "relevant / 5.0" if cli else "CASE WHEN n = 0 THEN 0 ELSE relevant / n END"
    none = "0" if cli else "1"
    return f"""{BASE}, m1 AS (SELECT *, (relevant > 0)::INT::DOUBLE AS hit_rate, coalesce(1.0 / fr, 0)::DOUBLE AS mrr, t1::INT::DOUBLE AS top1_category_match, CASE WHEN n = 0 THEN 0 ELSE relevant / n END::DOUBLE AS top5_category_coverage, ({prec})::DOUBLE AS precision_at_k,
 CASE WHEN n_expected = 0 THEN {none} ELSE cov / n_expected END::DOUBLE AS recall_at_k, CASE WHEN n_plain = 0 THEN 0 ELSE rel_plain / n_plain END::DOUBLE AS boosterless_precision_at_k,
 CASE WHEN n_expected = 0 THEN 1 WHEN n = 0 THEN 0 ELSE dcg / CASE least(n_expected, n) WHEN 1 THEN 1 ELSE 1 + 1 / log2(3) END END::DOUBLE AS ndcg_at_k, ({'kwf' if cli else 'kwh'} / 3.0)::DOUBLE AS keyword_hit_rate, (ih / 2.0)::DOUBLE AS intent_coverage_at_k,
 CASE WHEN n = 0 THEN 0 ELSE 1 - n_sig / n END::DOUBLE AS duplicate_rate_at_k, t1b::INT::DOUBLE AS booster_top1_share, CASE WHEN n = 0 THEN 0 ELSE n_booster / n END::DOUBLE AS booster_topk_share, t1c::INT::DOUBLE AS canonical_top1_rate FROM m0),
m2 AS (SELECT *, CASE WHEN precision_at_k + recall_at_k > 0 THEN 2 * precision_at_k * recall_at_k / (precision_at_k + recall_at_k) ELSE 0 END AS f1_score FROM m1),
cm AS (SELECT *, {'CASE WHEN n_expected >= 2 THEN f1_score END' if cli else 'f1_score'} AS multi_label_f1_at_k, CASE WHEN n_expected >= 2 THEN recall_at_k {'' if cli else 'ELSE 1'} END AS dual_category_recall_at_k FROM m2)"""


def cases(spark, sf, cli=False):
    return V.case_metrics(results(spark, sf), golden(spark, sf), 5, cli)


def _register(name, cols, cli=False):
    sql = f"WITH {metrics_sql(cli)} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in cols)} FROM cm"

    @query(name, sql)
    def _(spark, sf):
        return cases(spark, sf, cli).select("query_id", *[F.round(c, 6).alias(c) for c in cols])


_register("v01_hit_and_top1", ["hit_rate", "top1_category_match", "top5_category_coverage"])
_register("v02_mrr", ["mrr"])
_register("v03_precision", ["precision_at_k"])
_register("v03_precision_over_k", ["precision_at_k"], True)
_register("v04_recall", ["recall_at_k", "dual_category_recall_at_k"])
_register("v05_multi_label_f1", ["multi_label_f1_at_k", "f1_score"])
_register("v06_boosterless_precision", ["boosterless_precision_at_k"])
_register("v07_ndcg", ["ndcg_at_k"])
_register("v08_keyword_hit_rate", ["keyword_hit_rate"])
_register("v08_keyword_fuzzy", ["keyword_hit_rate"], True)
_register("v11_noise_and_tiers", ["intent_coverage_at_k", "duplicate_rate_at_k", "booster_top1_share", "booster_topk_share", "canonical_top1_rate"], True)

V9 = ["precision_at_k", "recall_at_k", "f1_score", "hit_rate", "mrr", "ndcg_at_k", "top1_category_match"]


@query("v09_single_label", f"WITH {metrics_sql(False).replace('''[event_type, 'd' || k] AS categories''', '''[event_type] AS categories''')} SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in V9)} FROM cm")
def _(spark, sf):
    r = results(spark, sf).withColumn("categories", F.slice("categories", 1, 1))
    return V.case_metrics(r, golden(spark, sf)).agg(*[F.round(F.avg(c), 6).alias(c) for c in V9])


@query("v10_synonym_metrics", f"""WITH {I.SYN}, r AS (SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY o_orderkey) AS rank, o_orderstatus <> 'F' AS evergreen, o_totalprice / 500000 AS fresh, string_split(o_orderpriority, '-') AS syns FROM benchmark JOIN orders ON o_custkey = item_id),
w AS (SELECT lower(term) AS w FROM syn UNION SELECT lower(unnest(synonyms)) FROM syn), kw AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS k FROM benchmark),
c AS (SELECT query_id, avg((k IN (SELECT w FROM w))::INT) AS cov FROM kw GROUP BY 1), p AS (SELECT query_id, count(*) FILTER (rank <= 3 AND NOT evergreen AND fresh < 0.7) AS st, avg(len(syns)) AS sy FROM r WHERE rank <= 5 GROUP BY 1)
SELECT b.item_id AS query_id, round(coalesce(cov, 1), 6) AS synonym_coverage, round(1 - coalesce(st, 0) / 3, 6) AS freshness_rank_quality, round(least(1, coalesce(sy, 0) / 10), 6) AS synonym_count_score FROM benchmark b LEFT JOIN c ON c.query_id = b.item_id LEFT JOIN p ON p.query_id = b.item_id""")
def _(spark, sf):
    b, o = table(spark, sf, "benchmark"), table(spark, sf, "orders")
    r = b.join(o, F.col("o_custkey") == F.col("item_id")).select(F.col("item_id").alias("query_id"), "o_orderkey", (F.col("o_orderstatus") != "F").alias("evergreen"), (F.col("o_totalprice") / 500000).alias("freshness_score"), F.split("o_orderpriority", "-").alias("synonyms"))
    r = top_per_group(r, "query_id", [F.asc("o_orderkey")], 5)
    g = b.select(F.col("item_id").alias("query_id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("expected_keywords"))
    m = V.synonym_metrics(r, g, I.base_synonyms(spark, sf))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query("v10_keyword_hit_rate", """WITH r AS (SELECT item_id AS query_id, row_number() OVER (PARTITION BY item_id ORDER BY o_orderkey) AS rank, string_split(o_orderpriority, '-') AS syns, ['Clerk#' || (o_orderkey % 7)] AS kws FROM benchmark JOIN orders ON o_custkey = item_id),
t AS (SELECT query_id, list_transform(list_distinct(flatten(list(list_concat(kws, syns)))), lambda x: lower(x)) AS terms FROM r WHERE rank <= 5 GROUP BY 1),
g AS (SELECT item_id AS query_id, list_concat(['HIGH', 'none'], CASE WHEN item_id % 3 = 0 THEN ['clerk#'] ELSE [] END) AS want, item_id % 5 = 0 AS empty FROM benchmark), w AS (SELECT query_id, CASE WHEN empty THEN [] ELSE want END AS want FROM g)
SELECT w.query_id, round(CASE WHEN len(want) = 0 THEN 1 WHEN terms IS NULL THEN 0 ELSE len(list_filter(want, lambda k: len(list_filter(terms, lambda x: contains(x, lower(k)) OR contains(lower(k), x))) > 0)) / len(want)::DOUBLE END, 6)::DOUBLE AS keyword_hit_rate FROM w LEFT JOIN t USING (query_id)""")
def _(spark, sf):
    b, o = table(spark, sf, "benchmark"), table(spark, sf, "orders")
    r = b.join(o, F.col("o_custkey") == F.col("item_id")).select(F.col("item_id").alias("query_id"), "o_orderkey", F.array(F.concat(F.lit("Clerk#"), F.col("o_orderkey") % 7)).alias("keywords"), F.split("o_orderpriority", "-").alias("synonyms"))
    r = top_per_group(r, "query_id", [F.asc("o_orderkey")], 5)
    want = F.concat(F.array(F.lit("HIGH"), F.lit("none")), F.when(F.col("item_id") % 3 == 0, F.array(F.lit("clerk#"))).otherwise(F.array().cast("array<string>")))
    g = b.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 5 != 0, want).alias("expected_keywords"))
    return V.keyword_hit_rate(r, g).select("query_id", F.round("keyword_hit_rate", 6).alias("keyword_hit_rate"))


_BUCKET = """bk AS (SELECT *, CASE WHEN duplicate_rate_at_k > 0.3 THEN 'duplicate_noise' WHEN booster_sensitive AND booster_topk_share >= 0.6 AND precision_at_k < 0.6 THEN 'booster_leakage' WHEN n_expected >= 2 AND recall_at_k < 1 THEN 'dual_intent_miss'
 WHEN recall_at_k = 0 THEN 'category_miss' WHEN keyword_hit_rate < 0.6 THEN 'keyword_surface_miss' WHEN mrr < 1 THEN 'ranking_miss' ELSE 'pass' END AS failure_bucket FROM cm)"""


@query("v12_failure_buckets", f"WITH {metrics_sql(True)}, {_BUCKET} SELECT failure_bucket, count(*) AS n FROM bk GROUP BY 1")
def _(spark, sf):
    return V.failure_bucket(cases(spark, sf, True)).groupBy("failure_bucket").agg(F.count("*").alias("n"))


@query("v12_worst_cases", f"WITH {metrics_sql(True)}, {_BUCKET} SELECT query_id, failure_bucket, round(precision_at_k, 6) AS precision_at_k FROM bk WHERE failure_bucket <> 'pass' ORDER BY bk.precision_at_k, query_id LIMIT 12")
def _(spark, sf):
    return V.worst_cases(V.failure_bucket(cases(spark, sf, True))).select("query_id", "failure_bucket", F.round("precision_at_k", 6).alias("precision_at_k"))


_SL = ["precision_at_k", "mrr", "recall_at_k", "f1_score", "boosterless_precision_at_k"]


@query("v13_slices", f"""WITH {metrics_sql(True)}, s AS (SELECT 'all' AS slice, * FROM cm UNION ALL SELECT CASE WHEN n_expected >= 2 THEN 'dual_label' ELSE 'single_label' END, * FROM cm UNION ALL SELECT 'booster_sensitive', * FROM cm WHERE booster_sensitive)
SELECT slice, count(*) AS cases, {', '.join(f'round(avg(round_even({c}, 2)), 6) AS {c}' for c in _SL)} FROM s GROUP BY 1""")
def _(spark, sf):
    return V.slice_averages(cases(spark, sf, True), _SL)


def _mode_sql(order):
    return f"SELECT * FROM (WITH {metrics_sql(False).replace('ORDER BY value DESC', f'ORDER BY {order} DESC')} SELECT avg(precision_at_k) AS precision_at_k, avg(recall_at_k) AS recall_at_k, avg(f1_score) AS f1_score, avg(hit_rate) AS hit_rate, avg(mrr) AS mrr FROM cm)"


@query("v14_modes", f"""WITH a AS (UNPIVOT ({_mode_sql('value')}) ON precision_at_k, recall_at_k, f1_score, hit_rate, mrr INTO NAME metric VALUE hybrid), b AS (UNPIVOT ({_mode_sql('ts')}) ON precision_at_k, recall_at_k, f1_score, hit_rate, mrr INTO NAME metric VALUE keyword)
SELECT metric, round(hybrid, 6) AS hybrid, round(keyword, 6) AS keyword FROM a JOIN b USING (metric)""")
def _(spark, sf):
    r = results(spark, sf).withColumn("mode", F.lit("hybrid")).unionByName(results(spark, sf, "ts").withColumn("mode", F.lit("keyword")))
    m = V.modes_side_by_side(r, golden(spark, sf), ["hybrid", "keyword"])
    return m.select("metric", F.round("hybrid", 6).alias("hybrid"), F.round("keyword", 6).alias("keyword"))


_AVG = ", ".join(f"avg({m}) AS {m}" for m in V.COMPOSITE_WEIGHTS)


@query("v15_composite", f"WITH {metrics_sql(False)}, a AS (SELECT {_AVG} FROM cm) SELECT round({' + '.join(f'{w} * {m}' for m, w in V.COMPOSITE_WEIGHTS.items())}, 6) AS composite FROM a")
def _(spark, sf):
    avg = cases(spark, sf).agg(*[F.avg(m).alias(m) for m in V.COMPOSITE_WEIGHTS])
    return V.composite(avg).select(F.round("composite", 6).alias("composite"))


# fixed values: retrieval gate
GATE = {"hit_rate": .95, "mrr": .90, "keyword_hit_rate": .70, "precision_at_k": .65, "dual_category_recall_at_k": .75, "multi_label_f1_at_k": .68, "boosterless_precision_at_k": .60, "ndcg_at_k": .75}


@query("v16_threshold_gate", f"""WITH {metrics_sql(False)}, a AS (UNPIVOT (SELECT {_AVG} FROM cm) ON {', '.join(V.COMPOSITE_WEIGHTS)} INTO NAME metric VALUE value), t AS (SELECT * FROM (VALUES {', '.join(f"('retrieval', {lit(m)}, {v})" for m, v in GATE.items())}) AS t(grp, metric, minimum))
SELECT grp AS "group", metric, round(value, 6) AS value, minimum::DOUBLE AS minimum, value >= minimum AS passed FROM t JOIN a USING (metric)""")
def _(spark, sf):
    avgs = V.run_scorers(cases(spark, sf), [*GATE, "unknown_metric"])
    t = spark.createDataFrame([("retrieval", m, float(v)) for m, v in [*GATE.items(), ("unknown_metric", 1.0)]], "group string, metric string, minimum double")
    return V.threshold_gate(avgs, t).select("group", "metric", F.round("value", 6).alias("value"), "minimum", "passed")


@query("v16_gate_verdict", """WITH g AS (SELECT o_orderpriority AS "group", o_orderstatus AS metric, avg(o_totalprice) AS value, CASE o_orderstatus WHEN 'F' THEN 149000 ELSE 150000 END AS minimum FROM orders GROUP BY 1, 2)
SELECT "group", count(*) AS checks, count(*) FILTER (value < minimum) AS failed, bool_and(value >= minimum) AS passed FROM g GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    averages = o.groupBy(F.col("o_orderpriority").alias("group"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    minima = averages.select("group", "metric", F.when(F.col("metric").endswith("/F"), 149000.0).otherwise(150000.0).alias("minimum"))
    return V.gate_verdict(V.threshold_gate(averages.drop("group"), minima))


@query("v17_latest_metrics", """WITH r AS (SELECT o_orderkey AS run_id, o_orderdate AS made, o_orderstatus AS metric, o_totalprice AS value FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10)
SELECT metric, max_by(value, (made, run_id)) AS value, min_by(value, (made, run_id)) AS oldest FROM r GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.create_map("o_orderstatus", "o_totalprice").alias("metrics"))
    return V.latest_metrics(o).join(V.latest_metrics(o, oldest_wins=True).withColumnRenamed("value", "oldest"), "metric")


@query("v17_compare_baseline", """WITH a AS (SELECT o_orderpriority AS metric, avg(o_totalprice) / 300000 AS value FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1), b AS (SELECT o_orderpriority AS metric, avg(o_totalprice) / 320000 AS value FROM orders WHERE year(o_orderdate) < 1998 AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT coalesce(a.metric, b.metric) AS metric, round(a.value, 6) AS value, round(b.value, 6) AS baseline, round(a.value - b.value, 6) AS delta, b.value IS NULL OR coalesce(a.value - b.value >= 0.05, false) AS replace FROM a FULL JOIN b ON a.metric = b.metric""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    a = o.filter("year(o_orderdate) >= 1998").groupBy(F.col("o_orderpriority").alias("metric")).agg((F.avg("o_totalprice") / 300000).alias("value"))
    b = o.filter("year(o_orderdate) < 1998 AND o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("metric")).agg((F.avg("o_totalprice") / 320000).alias("value"))
    c = V.compare_to_baseline(a, b)
    return c.select("metric", *[F.round(x, 6).alias(x) for x in ("value", "baseline", "delta")], "replace")


@query("v18_data_quality", f"""WITH {I.KB}, q AS (SELECT kb.*, CASE WHEN quality = 1 THEN 0.9 WHEN quality = 0 THEN 0.6 END AS confidence FROM kb LEFT JOIN labels ON doc_id = seq)
SELECT count(*) AS total, CASE WHEN count(*) BETWEEN 100 AND 2000 THEN 1 ELSE 0 END::DOUBLE AS qa_count_in_range, round_even(avg(confidence)::DOUBLE, 4) AS avg_confidence, round_even(avg((len(keywords) >= 3)::INT), 4) AS keyword_coverage,
 round_even(1 - avg((contains(lower(question || ' ' || answer), 'eauen') OR contains(lower(question || ' ' || answer), 'thhaen'))::INT), 4) AS no_admin_content FROM q""")
def _(spark, sf):
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("seq"), F.when(F.col("quality") == 1, 0.9).otherwise(0.6).alias("confidence"))
    return V.data_quality(I.kb(spark, sf).join(l, "seq", "left"), 100, 2000, ["Eauen", "thhaen"])


@query("v19_extraction_quality", f"""WITH {I.KB}, g AS (SELECT DISTINCT source AS sf FROM documents UNION ALL SELECT 'none'), r AS (SELECT source_collection AS sf, lower(question || ' ' || answer) AS qa, lower(question || ' ' || answer || ' ' || array_to_string(keywords, ' ')) AS pool, CASE lang WHEN 'en' THEN 0.9 ELSE 0.5 END AS c FROM kb)
SELECT g.sf AS source_file, count(qa) AS n, (count(qa) BETWEEN 40 AND 60)::INT::DOUBLE AS qa_count_in_range, round(CASE WHEN count(qa) = 0 THEN 0 ELSE (bool_or(contains(pool, 'shthti'))::INT + bool_or(contains(pool, 'ondndsh'))::INT + bool_or(contains(pool, 'zzz'))::INT) / 3 END, 6) AS keyword_coverage,
 CASE WHEN coalesce(bool_or(contains(qa, 'ieriereau')), false) THEN 0 ELSE 1 END::DOUBLE AS no_admin_content, round(coalesce(avg(c), 0)::DOUBLE, 6) AS avg_confidence FROM g LEFT JOIN r USING (sf) GROUP BY 1""")
def _(spark, sf):
    k = I.kb(spark, sf).withColumn("source_file", F.col("source_collection")).withColumn("confidence", F.when(F.col("lang") == "en", 0.9).otherwise(0.5))
    d = table(spark, sf, "documents")
    g = d.select(F.col("source").alias("source_file")).distinct().unionByName(d.select(F.lit("none").alias("source_file")).distinct())
    g = g.select("source_file", F.lit(40).alias("min_qa_count"), F.lit(60).alias("max_qa_count"), F.array(F.lit("Shthti"), F.lit("ondndsh"), F.lit("zzz")).alias("must_extract_keywords"), F.array(F.lit("ieriereau")).alias("should_not_extract"))
    e = V.extraction_quality(k, g)
    return e.select("source_file", "n", "qa_count_in_range", F.round("keyword_coverage", 6).alias("keyword_coverage"), "no_admin_content", F.round("avg_confidence", 6).alias("avg_confidence"))


@query("v20_label_accuracy", """WITH p AS (SELECT CASE WHEN quality = 1 THEN 2 WHEN toxic = 1 THEN 0 ELSE 4 END AS p, CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 3 WHEN 'de' THEN 1 ELSE 0 END AS e FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS n, round(avg((p = e)::INT), 6) AS accuracy, round(avg((abs(p - e) <= 1)::INT), 6) AS adjacent_accuracy, round(avg((p <> 0)::INT), 6) AS not_none FROM p""")
def _(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    p = F.when(F.col("quality") == 1, "L2").when(F.col("toxic") == 1, None).otherwise("L4")
    e = F.when(F.col("lang") == "en", "L2").when(F.col("lang") == "fr", "L3").when(F.col("lang") == "de", "L1")
    a = V.label_accuracy(j.select(p.alias("predicted"), e.alias("expected")))
    return a.select("n", *[F.round(c, 6).alias(c) for c in a.columns[1:]])


@query("v21_classification_agreement", f"""WITH {I.KBC}, t AS (SELECT seq, category, difficulty, evergreen FROM kbc), g AS (SELECT doc_id AS seq, '其他' AS ec, CASE WHEN quality = 1 THEN '進階' ELSE '' END AS ed, CASE WHEN toxic = 1 THEN true END AS ee FROM labels UNION ALL SELECT -1, '其他', '進階', true)
SELECT round(avg(coalesce(category = ec, false)::INT), 6) AS category_match, round(avg(CASE WHEN ed = '' THEN 1 ELSE coalesce(difficulty = ed, false)::INT END), 6) AS difficulty_match, round(avg(CASE WHEN ee IS NULL THEN 1 ELSE coalesce(evergreen = ee, false)::INT END), 6) AS evergreen_match, round(avg((category IS NOT NULL)::INT), 6) AS has_result FROM g LEFT JOIN t USING (seq)""")
def _(spark, sf):
    t = I.kb_classified(spark, sf).select(F.col("seq").alias("query_id"), "category", "difficulty", "evergreen")
    l = table(spark, sf, "labels")
    g = l.select(F.col("doc_id").alias("query_id"), F.lit("其他").alias("expected_category"), F.when(F.col("quality") == 1, "進階").otherwise("").alias("expected_difficulty"), F.when(F.col("toxic") == 1, True).alias("expected_evergreen"))
    g = g.unionByName(l.select(F.lit(-1).cast("long").alias("query_id"), F.lit("其他").alias("expected_category"), F.lit("進階").alias("expected_difficulty"), F.lit(True).alias("expected_evergreen")).distinct())
    a = V.classification_agreement(t, g)
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


@query("v22_segment_recall", """WITH s AS (SELECT l_returnflag AS id, '/s' || l_suppkey || '/' AS seg, sum(l_quantity) FILTER (year(l_shipdate) = 1999) / sum(l_quantity) FILTER (year(l_shipdate) = 1998) - 1 AS c, sum(l_tax) AS t FROM lineitem GROUP BY 1, 2),
a AS (SELECT id, bool_or(round(c,6) >= 0.5) AS crit, list(seg) FILTER (round(c,6) >= 0.15) AS w, list(seg) FILTER (round(c,6) <= -0.1) AS i, list(seg) FILTER (round(t,2) > 8) AS ew, list(seg) FILTER (round(t,2) <= 7) AS ei, list(seg) AS al FROM s GROUP BY 1)
SELECT id, coalesce(crit, false)::INT::DOUBLE AS severity_accuracy, CASE WHEN ew IS NULL THEN 1 ELSE round(len(list_intersect(ew, coalesce(w, []))) / len(ew), 6) END AS worsening_recall, CASE WHEN ei IS NULL THEN 1 ELSE round(len(list_intersect(ei, coalesce(i, []))) / len(ei), 6) END AS improving_recall, round(len(list_intersect(al, coalesce(w, []))) / len(al), 6) AS path_coverage FROM a""")
def _(spark, sf):
    from tidekb.catalog.metric_queries import segments
    from tidekb.operators import metrics as M

    s = segments(spark, sf)
    pick = lambda cond: F.collect_set(F.when(cond, F.col("segment")))
    worse = F.col("severity").isin("critical", "warning")
    ins = s.groupBy(F.col("site").alias("id")).agg(pick(worse).alias("worsening"), pick(F.col("severity") == "improving").alias("improving"), pick(worse).alias("mentioned"))
    ins = ins.join(M.overall_severity(s, "site").select(F.col("site").alias("id"), "overall"), "id")
    t = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("id"), F.concat(F.lit("/s"), "l_suppkey", F.lit("/")).alias("segment")).agg(F.round(F.sum("l_tax"), 2).alias("t"))
    g = t.groupBy("id").agg(F.lit("critical").alias("expected_severity"), pick(F.col("t") > 8).alias("expected_worsening"), pick(F.col("t") <= 7).alias("expected_improving"), F.collect_set("segment").alias("segments"))
    r = V.segment_recall(ins, g)
    return r.select("id", *[F.round(c, 6).alias(c) for c in ("severity_accuracy", "worsening_recall", "improving_recall", "path_coverage")])


@query("v23_answer_metrics", """WITH a AS (SELECT conv_id, turn, lower(text) AS t, text FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, (length(trim(text)) > 50)::INT::DOUBLE AS has_answer, (turn > 1)::INT::DOUBLE AS has_sources,
 round((contains(t || ' thea', 'onthe')::INT + contains(t || ' thea', 'thea')::INT) / 2.0, 6)::DOUBLE AS answer_keyword_coverage, (turn = 3)::INT::DOUBLE AS top_source_in_category, round(CASE WHEN t = '' THEN 0 ELSE 0.7 * (contains(t, 'ation')::INT + contains(t, 'eaux')::INT) / 2.0 + 0.3 * (1 - contains(t, 'schen')::INT) END, 6)::DOUBLE AS appropriateness FROM a""")
def _(spark, sf):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    c = table(spark, sf, "conversations").filter("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("answer"), F.when(F.col("turn") > 1, 2).otherwise(0).alias("source_count"), F.lit("Thea").alias("source_text"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("top_category"),
        arr("Onthe", "thea").alias("expected_keywords"), arr("c3").alias("expected_categories"), arr("ation", "Eaux").alias("should_contain"), arr("schen").alias("should_not_contain"))
    m = V.answer_metrics(c)
    return m.select("conv_id", "turn", "has_answer", "has_sources", F.round("answer_keyword_coverage", 6).alias("answer_keyword_coverage"), "top_source_in_category", F.round("appropriateness", 6).alias("appropriateness"))


@query("v24_seeded_sample", f"WITH {I.KB}, s AS (SELECT seq, question FROM kb ORDER BY md5('42|' || seq), seq LIMIT 30) SELECT s.*, quality FROM s LEFT JOIN labels ON doc_id = seq")
def _(spark, sf):
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("seq"), "quality")
    return V.seeded_sample(I.kb(spark, sf).select("seq", "question"), "seq", 30, 42, l)


@query("u01_scorer_registry", f"WITH {metrics_sql(False)}, a AS (UNPIVOT (SELECT avg(mrr) AS mrr, avg(ndcg_at_k) AS ndcg_at_k, avg(n) AS mean_results FROM cm) ON mrr, ndcg_at_k, mean_results INTO NAME metric VALUE value) SELECT metric, round(value, 6) AS value FROM a")
def _(spark, sf):
    V.scorer("mean_results")(lambda df: F.avg("n"))
    return V.run_scorers(cases(spark, sf), ["mrr", "ndcg_at_k", "mean_results"]).withColumn("value", F.round("value", 6))
