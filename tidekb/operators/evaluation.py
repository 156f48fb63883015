"""Retrieval, data, extraction and answer quality as aggregations (V1-V24) and the scorer registry.

``results``: ``(query_id, rank, id, categories, keywords, intent_labels, serving_tier, question, answer, freshness_score,
evergreen, synonyms)`` — any of the optional columns may be absent. ``golden``: ``(query_id, expected_categories,
expected_keywords, expected_intents, booster_sensitive)``. Golden cases without results count everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekb.functions.text import signature

NONE = "array<string>"


def _arr(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(NONE))


def _share(hit: Column, total: Column, empty: float) -> Column:
    return F.when(total == 0, F.lit(empty)).otherwise(hit / total)


def case_metrics(results: DataFrame, golden: DataFrame, k: int = 5, cli: bool = False) -> DataFrame:
    """One row per golden case with every retrieval metric. ``cli``: the command-line conventions (precision over k,
    recall 0 instead of 1 without expectations, null dual metrics for single-label cases)."""
    g = golden.withColumn("_exp", F.array_distinct(_arr("expected_categories")))
    opt = {"keywords": NONE, "intent_labels": NONE, "serving_tier": "string", "question": "string", "answer": "string"}
    r = results.filter(F.col("rank") <= k)
    if "category" in r.columns:  # a result without categories counts by its primary one
        r = r.withColumn("categories", F.when(F.size(_arr("categories")) > 0, F.col("categories")).when(F.col("category").isNotNull(), F.array("category")).otherwise(F.col("categories")))
    r = r.select("query_id", "rank", "categories", *[F.col(c) if c in r.columns else F.lit(None).cast(t).alias(c) for c, t in opt.items()])
    j = g.join(r, "query_id", "left")
    rel = F.coalesce(F.arrays_overlap("categories", "_exp"), F.lit(False))
    seen, booster = F.col("rank").isNotNull(), F.lower(F.coalesce("serving_tier", F.lit("canonical"))) == "booster"
    canonical = F.lower(F.coalesce("serving_tier", F.lit("canonical"))) == "canonical"
    first_new = F.array_intersect("categories", "_exp")
    pool = F.lower(F.concat_ws(" ", "question", "answer", F.array_join("keywords", " ")))
    agg = j.groupBy("query_id").agg(
        F.first("_exp").alias("exp"), F.first(_arr("expected_keywords")).alias("exp_kw"), F.first(_arr("expected_intents")).alias("exp_int"),
        F.first(F.coalesce("booster_sensitive", F.lit(False))).alias("booster_sensitive"),
        F.count("rank").alias("n"), F.count_if(rel & seen).alias("relevant"), F.min(F.when(rel, F.col("rank"))).alias("first_rank"),
        F.count_if(seen & ~booster).alias("n_plain"), F.count_if(seen & ~booster & rel).alias("rel_plain"), F.count_if(seen & booster).alias("n_booster"),
        F.coalesce(F.max(F.when(F.col("rank") == 1, rel)), F.lit(False)).alias("top1_hit"), F.coalesce(F.max(F.when(F.col("rank") == 1, booster)), F.lit(False)).alias("top1_booster"),
        F.coalesce(F.max(F.when(F.col("rank") == 1, canonical)), F.lit(False)).alias("top1_canonical"),
        F.array_distinct(F.flatten(F.collect_list("categories"))).alias("got"), F.array_distinct(F.flatten(F.collect_list("intent_labels"))).alias("got_int"),
        F.array_distinct(F.transform(F.flatten(F.collect_list("keywords")), lambda x: F.lower(x))).alias("got_kw"),
        F.count_distinct(F.when(seen, signature("question", 80))).alias("n_sig"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(seen, F.struct("rank", pool.alias("p"))))), lambda x: x["p"]), " ").alias("pool"),
        F.array_sort(F.collect_list(F.when(seen, F.struct("rank", first_new.alias("c"))))).alias("cats_by_rank"),
    )
    n_exp = F.size("exp")
    covered = F.size(F.array_intersect("got", "exp"))
    # a rank gains once if it brings an expected category that no earlier rank brought
    start = F.struct(F.array().cast(NONE).alias("seen"), F.lit(0.0).alias("dcg"))
    dcg = F.aggregate(
        "cats_by_rank", start,
        lambda a, x: F.struct(F.array_union(a["seen"], x["c"]).alias("seen"),
                              (a["dcg"] + F.when(F.size(F.array_except(x["c"], a["seen"])) > 0, 1.0 / F.log2(x["rank"] + 1.0)).otherwise(0.0)).alias("dcg")),
        lambda a: a["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n_exp, F.col("n").cast("int")))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    precision = F.col("relevant") / k if cli else _share(F.col("relevant"), F.col("n"), 0.0)
    recall = _share(covered, n_exp, 0.0 if cli else 1.0)
    kw_hit = F.size(F.filter("exp_kw", lambda e: F.contains(F.col("pool"), F.lower(e))))
    fuzzy = F.size(F.filter("exp_kw", lambda e: F.exists("got_kw", lambda r: F.contains(r, F.lower(e)) | ((F.length(r) >= 2) & F.contains(F.lower(e), r)))))
    out = agg.select(
        "query_id", "n", n_exp.alias("n_expected"), "booster_sensitive",
        (F.col("relevant") > 0).cast("double").alias("hit_rate"), F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        F.col("top1_hit").cast("double").alias("top1_category_match"), F.when(n_exp == 0, 0.0).otherwise(_share(F.col("relevant"), F.col("n"), 0.0)).alias("top5_category_coverage"),
        precision.alias("precision_at_k"), recall.alias("recall_at_k"), _share(F.col("rel_plain"), F.col("n_plain"), 0.0).alias("boosterless_precision_at_k"),
        F.when(n_exp == 0, 1.0).when(F.col("n") == 0, 0.0).otherwise(dcg / ideal).alias("ndcg_at_k"),
        F.when(F.size("exp_kw") == 0, 0.0 if cli else 1.0).otherwise((fuzzy if cli else kw_hit) / F.size("exp_kw")).alias("keyword_hit_rate"),
        _share(F.size(F.array_intersect("got_int", "exp_int")), F.size("exp_int"), 0.0).alias("intent_coverage_at_k"),
        F.when(F.col("n") > 0, 1 - F.col("n_sig") / F.col("n")).otherwise(0.0).alias("duplicate_rate_at_k"),
        F.col("top1_booster").cast("double").alias("booster_top1_share"), _share(F.col("n_booster"), F.col("n"), 0.0).alias("booster_topk_share"),
        F.col("top1_canonical").cast("double").alias("canonical_top1_rate"),
    )
    p, r_ = F.col("precision_at_k"), F.col("recall_at_k")
    f1 = F.when(p + r_ > 0, 2 * p * r_ / (p + r_)).otherwise(0.0)
    single = None if cli else F.lit(1.0)
    dual = F.when(F.col("n_expected") >= 2, r_) if single is None else F.when(F.col("n_expected") >= 2, r_).otherwise(single)
    return out.withColumns({"f1_score": f1, "multi_label_f1_at_k": F.when(F.col("n_expected") >= 2, f1) if cli else f1, "dual_category_recall_at_k": dual})


def failure_bucket(cases: DataFrame) -> DataFrame:
    """First matching rule per case of the command-line metrics, else pass."""
    c = F.col
    bucket = (
        F.when(c("duplicate_rate_at_k") > 0.30, "duplicate_noise")
        .when(c("booster_sensitive") & (c("booster_topk_share") >= 0.6) & (c("precision_at_k") < 0.6), "booster_leakage")
        .when((c("n_expected") >= 2) & (c("recall_at_k") < 1.0), "dual_intent_miss").when(c("recall_at_k") == 0, "category_miss")
        .when(c("keyword_hit_rate") < 0.6, "keyword_surface_miss").when(c("mrr") < 1.0, "ranking_miss").otherwise("pass")
    )
    return cases.withColumn("failure_bucket", bucket)


def worst_cases(bucketed: DataFrame, n: int = 12) -> DataFrame:
    return bucketed.filter("failure_bucket <> 'pass'").orderBy("precision_at_k", "query_id").limit(n)


def slice_averages(cases: DataFrame, metrics: list[str]) -> DataFrame:
    """Averages of the per-case values rounded to 2 digits: overall, single-label, dual-label and booster-sensitive."""
    tags = F.array_compact(F.array(F.lit("all"), F.when(F.col("n_expected") >= 2, "dual_label").otherwise("single_label"), F.when(F.col("booster_sensitive"), "booster_sensitive")))
    return cases.withColumn("slice", F.explode(tags)).groupBy("slice").agg(
        F.count("*").alias("cases"), *[F.round(F.avg(F.bround(m, 2)), 6).alias(m) for m in metrics])


def modes_side_by_side(results: DataFrame, golden: DataFrame, modes: list[str], k: int = 5) -> DataFrame:
    """Averages per search mode in one row per metric; ``results`` carries a ``mode`` column."""
    m = golden.withColumn("mode", F.explode(F.array(*[F.lit(x) for x in modes])))
    key = F.to_json(F.struct("mode", "query_id"))
    c = case_metrics(results.withColumn("query_id", key), m.withColumn("query_id", key), k).withColumn("mode", F.get_json_object("query_id", "$.mode"))
    names = ["precision_at_k", "recall_at_k", "f1_score", "hit_rate", "mrr"]
    avg = c.groupBy("mode").agg(*[F.avg(x).alias(x) for x in names])
    return avg.unpivot("mode", names, "metric", "value").groupBy("metric").pivot("mode", modes).agg(F.first("value"))


# fixed values: weights of the retrieval composite
COMPOSITE_WEIGHTS = {"hit_rate": 0.20, "mrr": 0.20, "precision_at_k": 0.15, "ndcg_at_k": 0.15, "keyword_hit_rate": 0.15,
                     "multi_label_f1_at_k": 0.10, "dual_category_recall_at_k": 0.03, "boosterless_precision_at_k": 0.02}


def composite(averages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    total = F.lit(0.0)
    for m, w in (weights or COMPOSITE_WEIGHTS).items():
        total = total + F.col(m) * w
    return averages.withColumn("composite", total)


# ---- U1: named scorers ----
SCORERS: dict[str, Callable[[DataFrame], Column]] = {}
GROUP_SCORERS: dict[str, tuple[Callable, str]] = {}


def scorer(name: str):
    """Register ``fn(cases) -> Column`` (an aggregate) under a name."""

    def add(fn):
        SCORERS[name] = fn
        return fn

    return add


def group_scorer(name: str, schema: str):
    """Register a grouped Arrow scorer ``fn(table) -> table`` run per query."""

    def add(fn):
        GROUP_SCORERS[name] = (fn, schema)
        return fn

    return add


for _m in ("keyword_hit_rate", "top1_category_match", "top5_category_coverage", "hit_rate", "mrr", "precision_at_k", "recall_at_k",
           "dual_category_recall_at_k", "multi_label_f1_at_k", "boosterless_precision_at_k", "ndcg_at_k"):
    scorer(_m)(lambda df, m=_m: F.avg(m))


def run_scorers(cases: DataFrame, names: list[str]) -> DataFrame:
    """``(metric, value)``: all named scorers in a single aggregation; unknown names are skipped."""
    known = [n for n in names if n in SCORERS]
    row = cases.agg(*[SCORERS[n](cases).cast("double").alias(n) for n in known])
    return row.unpivot([], known, "metric", "value") if len(known) > 1 else row.select(F.lit(known[0]).alias("metric"), F.col(known[0]).alias("value"))


def run_group_scorer(results: DataFrame, name: str) -> DataFrame:
    fn, schema = GROUP_SCORERS[name]
    return results.groupBy("query_id").applyInArrow(fn, schema)


def threshold_gate(averages: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``(group, metric, value, minimum, passed)``; metrics without an average are skipped."""
    return thresholds.join(averages, "metric").withColumn("passed", F.col("value") >= F.col("minimum"))


def gate_verdict(gated: DataFrame) -> DataFrame:
    return gated.groupBy("group").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("passed"))


# ---- runs ----
def latest_metrics(runs: DataFrame, last: int = 10, oldest_wins: bool = False) -> DataFrame:
    """Value per metric over the ``last`` newest runs ``(run_id, created_at, metrics MAP)``. ``oldest_wins`` reproduces
    an update loop that overwrites newer values by older ones."""
    recent = runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(last)
    long = recent.select("created_at", "run_id", F.explode("metrics").alias("metric", "value"))
    at = F.struct("created_at", "run_id")
    return long.groupBy("metric").agg((F.min_by("value", at) if oldest_wins else F.max_by("value", at)).alias("value"))


def compare_to_baseline(current: DataFrame, baseline: DataFrame, better: float = 0.05) -> DataFrame:
    j = current.join(baseline.withColumnRenamed("value", "baseline"), "metric", "full_outer")
    delta = F.col("value") - F.col("baseline")
    return j.withColumn("delta", delta).withColumn("replace", F.col("baseline").isNull() | F.coalesce(delta >= better, F.lit(False)))


# ---- data and extraction ----
def data_quality(df: DataFrame, lo: int, hi: int, admin: list[str], min_keywords: int = 3) -> DataFrame:
    from tidekb.functions.terms import find_terms

    text = F.lower(F.concat_ws(" ", "question", "answer"))
    t = df.withColumn("_adm", F.size(find_terms(text, [a.lower() for a in admin])) > 0)
    n = F.count("*")
    return t.agg(
        n.alias("total"), F.when((n >= lo) & (n <= hi), 1.0).otherwise(0.0).alias("qa_count_in_range"),
        F.bround(F.coalesce(F.avg(F.col("confidence").cast("double")), F.lit(0.0)), 4).alias("avg_confidence"),
        F.bround(F.coalesce(F.avg((F.size("keywords") >= min_keywords).cast("double")), F.lit(0.0)), 4).alias("keyword_coverage"),
        F.bround(1 - F.coalesce(F.avg(F.col("_adm").cast("double")), F.lit(0.0)), 4).alias("no_admin_content"))


def extraction_quality(rows: DataFrame, golden: DataFrame) -> DataFrame:
    """Per golden source: count in range, must-have keyword coverage, no forbidden term, mean confidence.

    Terms are looked up per row and only hit flags are aggregated, so a source of any size needs no pooled text.
    """
    g = golden.select("source_file", "min_qa_count", "max_qa_count", F.coalesce("must_extract_keywords", F.array().cast(NONE)).alias("must"),
                      F.coalesce("should_not_extract", F.array().cast(NONE)).alias("bad"))
    r = rows.select("source_file", "confidence", F.lower(F.concat_ws(" ", "question", "answer")).alias("_qa"),
                    F.lower(F.concat_ws(" ", "question", "answer", F.array_join("keywords", " "))).alias("_pool"))
    j = g.join(r, "source_file", "left")
    found = F.filter("must", lambda k: F.contains(F.col("_pool"), F.lower(k)))
    foul = F.coalesce(F.exists("bad", lambda k: F.contains(F.col("_qa"), F.lower(k))), F.lit(False))
    per = j.withColumn("_hits", found).withColumn("_foul", foul)
    hits = per.select("source_file", F.explode("_hits").alias("k")).groupBy("source_file").agg(F.count_distinct("k").alias("hits"))
    base = per.groupBy("source_file").agg(
        F.count("_qa").alias("n"), F.first("min_qa_count").alias("lo"), F.first("max_qa_count").alias("hi"), F.first(F.size(F.array_distinct("must"))).alias("n_must"),
        F.max("_foul").alias("foul"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"))
    out = base.join(hits, "source_file", "left")
    return out.select(
        "source_file", "n", ((F.col("n") >= F.col("lo")) & (F.col("n") <= F.col("hi"))).cast("double").alias("qa_count_in_range"),
        F.when(F.col("n_must") == 0, 1.0).when(F.col("n") == 0, 0.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n_must")).alias("keyword_coverage"),
        F.when(F.col("foul"), 0.0).otherwise(1.0).alias("no_admin_content"), "avg_confidence")


LEVELS = ["NONE", "L1", "L2", "L3", "L4"]


def label_accuracy(df: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    at = lambda c: F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.coalesce(F.col(c), F.lit("NONE")))
    p, e = at(predicted), at(expected)
    return df.agg(
        F.count("*").alias("n"), F.avg((p == e).cast("double")).alias("accuracy"),
        F.avg(((p > 0) & (e > 0) & (F.abs(p - e) <= 1)).cast("double")).alias("adjacent_accuracy"), F.avg((p != 1).cast("double")).alias("not_none"))


def classification_agreement(top1: DataFrame, golden: DataFrame) -> DataFrame:
    """Top-1 category / difficulty / evergreen agreement; a missing expectation counts 1."""
    j = golden.join(top1, "query_id", "left")
    same = lambda got, exp: F.when(F.coalesce(F.col(exp).cast("string"), F.lit("")) == "", 1.0).otherwise(F.col(exp).eqNullSafe(F.col(got)).cast("double"))
    return j.agg(
        F.avg(F.col("category").eqNullSafe(F.col("expected_category")).cast("double")).alias("category_match"), F.avg(same("difficulty", "expected_difficulty")).alias("difficulty_match"),
        F.avg(same("evergreen", "expected_evergreen")).alias("evergreen_match"), F.avg(F.col("category").isNotNull().cast("double")).alias("has_result"))


def segment_recall(insight: DataFrame, golden: DataFrame) -> DataFrame:
    """``insight``: ``(id, overall, worsening, improving, mentioned)`` arrays; ``golden``: expected severity and paths, ``segments``."""
    j = golden.join(insight, "id", "left")
    rec = lambda exp, got: F.when(F.size(_arr(exp)) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_distinct(_arr(exp)), _arr(got))) / F.size(F.array_distinct(_arr(exp))))
    s = j.select(
        "id", F.coalesce(F.col("overall") == F.col("expected_severity"), F.lit(False)).cast("double").alias("severity_accuracy"),
        rec("expected_worsening", "worsening").alias("worsening_recall"), rec("expected_improving", "improving").alias("improving_recall"), rec("segments", "mentioned").alias("path_coverage"))
    return s.withColumn("overall_score", (F.col("severity_accuracy") + F.col("worsening_recall") + F.col("improving_recall") + F.col("path_coverage")) / 4)


def answer_metrics(df: DataFrame) -> DataFrame:
    """Per answer ``(answer, source_count, source_text, top_category, expected_keywords, expected_categories, should_contain, should_not_contain)``."""
    a = F.lower(F.coalesce("answer", F.lit("")))
    pool = F.concat_ws(" ", a, F.lower(F.coalesce("source_text", F.lit(""))))
    part = lambda c, text, empty: F.when(F.size(_arr(c)) == 0, F.lit(empty)).otherwise(F.size(F.filter(_arr(c), lambda k: F.contains(text, F.lower(k)))) / F.size(_arr(c)))
    wanted, unwanted = part("should_contain", a, 1.0), part("should_not_contain", a, 0.0)
    return df.withColumns({
        "has_answer": (F.length(F.trim(F.coalesce("answer", F.lit("")))) > 50).cast("double"), "has_sources": (F.col("source_count") > 0).cast("double"),
        "answer_keyword_coverage": part("expected_keywords", pool, 1.0),
        "top_source_in_category": F.coalesce(F.array_contains(_arr("expected_categories"), F.col("top_category")), F.lit(False)).cast("double"),
        "appropriateness": F.when(a == "", 0.0).otherwise(wanted * 0.7 + (1 - unwanted) * 0.3)})


def synonym_metrics(results: DataFrame, golden: DataFrame, synonyms: DataFrame, k: int = 5) -> DataFrame:
    """Synonym coverage of expected keywords, freshness rank quality of the first three, synonym count / 10."""
    words = synonyms.select(F.explode(F.array_union(F.array("term"), "synonyms")).alias("w")).select(F.lower("w").alias("w")).distinct()
    kw = golden.select("query_id", F.explode("expected_keywords").alias("w")).withColumn("w", F.lower("w"))
    cov = kw.join(words.withColumn("_in", F.lit(1)), "w", "left").groupBy("query_id").agg((F.count("_in") / F.count("*")).alias("synonym_coverage"))
    stale = (F.col("rank") <= 3) & ~F.coalesce("evergreen", F.lit(True)) & (F.coalesce("freshness_score", F.lit(1.0)) < 0.7)
    per = results.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count_if(stale).alias("stale"), F.avg(F.size(_arr("synonyms"))).alias("syn"))
    j = golden.select("query_id").join(cov, "query_id", "left").join(per, "query_id", "left")
    return j.select("query_id", F.coalesce("synonym_coverage", F.lit(1.0)).alias("synonym_coverage"), (1 - F.coalesce("stale", F.lit(0)) / 3).alias("freshness_rank_quality"),
                    F.least(F.lit(1.0), F.coalesce("syn", F.lit(0.0)) / 10).alias("synonym_count_score"))


def keyword_hit_rate(results: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, keyword_hit_rate)``: share of expected keywords that contain, or lie in, a keyword or synonym of the
    first ``k`` results, whatever their case. 1 without expected keywords, 0 without results."""
    terms = results.filter(F.col("rank") <= k).groupBy("query_id").agg(
        F.transform(F.array_distinct(F.flatten(F.collect_list(F.concat(_arr("keywords"), _arr("synonyms"))))), F.lower).alias("terms"))  # of k rows
    j = golden.select("query_id", _arr("expected_keywords").alias("want")).join(terms, "query_id", "left")
    hit = F.filter("want", lambda w: F.exists("terms", lambda t: F.contains(t, F.lower(w)) | F.contains(F.lower(w), t)))
    rate = F.when(F.size("want") == 0, 1.0).when(F.col("terms").isNull(), 0.0).otherwise(F.size(hit) / F.size("want"))
    return j.select("query_id", rate.alias("keyword_hit_rate"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int, golden: DataFrame | None = None) -> DataFrame:
    """``n`` rows in the order of ``md5(seed|key)``: the same rows for any partitioning; golden labels attached where known."""
    s = df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)
    return s if golden is None else s.join(golden, key, "left")
